"""At which places of id arrays does one of very many sequences begin?

Rows are dealt out in blocks. What follows a place, up to the longest sequence, is a gram;
a block's distinct grams go, packed, to the groups of sequences that begin with the same id,
or where that id is hot, with the same two.
A group walks its grams and sequences together and sends back one size for each gram. The
block numbers its grams again in the same way, so neither keys nor places travel.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from banlist.operators.rule_places import begun_with

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ASKED = "group int, block int, sizes binary, ids binary"
ANSWERED = "group int, block int, sizes binary"
# Deals ids out to groups; products stay below 2**63.
_PRIME = (1 << 31) - 1
_BY_ID, _BY_SALT, _BY_SECOND = 1_103_515_245, 1_640_531_527, 69_069


def groups_of(seq: Column, salts: Column, groups: int) -> Column:
    """The groups of a sequence. A hot first id, of several salts, is split by the second id;
    only a sequence of one id goes to all of them."""
    second = F.pmod(F.pmod(F.get(seq, F.lit(1)), F.lit(_PRIME)) * F.lit(_BY_SECOND), F.lit(_PRIME))
    every = F.sequence(F.lit(0).cast("bigint"), salts.cast("bigint") - 1)
    own = F.when(F.size(seq) > 1, F.array(F.pmod(second, salts.cast("bigint")))).otherwise(every)
    head = F.pmod(F.get(seq, F.lit(0)), F.lit(_PRIME)) * F.lit(_BY_ID)
    group = lambda salt: F.pmod(F.pmod(head + salt * F.lit(_BY_SALT), F.lit(_PRIME)), F.lit(groups)).cast("int")
    return F.array_distinct(F.transform(own, group))


def _groups_of(heads: np.ndarray, seconds: np.ndarray, sizes: np.ndarray, salts: dict[int, int], groups: int) -> np.ndarray:
    """The group that each gram asks. One of a single id asks any group of that id."""
    salt = np.zeros(len(heads), np.int64)
    if salts:
        hot = np.array(sorted(salts), np.int64)
        place = np.minimum(np.searchsorted(hot, heads), len(hot) - 1)
        many = np.where(hot[place] == heads, np.array([salts[h] for h in hot.tolist()], np.int64)[place], 1)
        salt = np.where(sizes > 1, np.mod(seconds, _PRIME) * _BY_SECOND % _PRIME % many, 0)
    return (np.mod(heads, _PRIME) * _BY_ID + salt * _BY_SALT) % _PRIME % groups


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers pressed byte by byte of their places: high bytes are mostly alike."""
    planes = values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = pa.decompress(blob[8:], 8 * n, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(8, n).T.copy().view("<i8").reshape(n)


def _ids(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids of all lists one after another, where each begins, how many it has."""
    one = lists.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(one), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return one.flatten(), np.cumsum(lengths) - lengths, lengths


class _Grams:
    """The distinct grams of a block in their order, which rows in any order give alike."""

    def __init__(self, lists: pa.ChunkedArray, longest: int, salts: dict[int, int], groups: int):
        flat, self.begin, self.lengths = _ids(lists)
        values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.arange(len(values))
        ends = np.repeat(self.begin + self.lengths, self.lengths)
        # A null ends what goes before it.
        nulls = np.flatnonzero(pc.is_null(flat).to_numpy(zero_copy_only=False))
        ends = np.minimum(ends, np.append(nulls, len(values))[np.searchsorted(nulls, at)])
        reach = np.minimum(ends - at, longest)
        codes = np.unique(values, return_inverse=True)[1] + 1
        codes = np.append(codes, np.zeros(max(reach.max(initial=0), 1), np.int64))
        self.of_place = np.zeros(len(values), np.int64)
        first = np.zeros(min(len(values), 1), np.int64)
        for step in range(reach.max(initial=0)):
            sign = np.where(reach > step, codes[at + step], 0)
            _, first, self.of_place = np.unique(self.of_place << 32 | sign, return_index=True, return_inverse=True)
        self.n = len(first)
        self.sizes = reach[first]
        self._values, self._first = values, first
        seconds = np.append(values, 0)[first + 1]
        group = _groups_of(values[first], seconds, self.sizes, salts, groups)
        # A gram of no id, a null's, asks nobody.
        some = np.flatnonzero(self.sizes)
        some = some[np.argsort(group[some], kind="stable")]
        self.groups, starts = np.unique(group[some], return_index=True)
        self.members = np.split(some, starts[1:]) if len(starts) else []

    def spelled(self, members: np.ndarray) -> np.ndarray:
        """The first ids of some grams, then the second ones, and so on."""
        first, sizes = self._first[members], self.sizes[members]
        return np.concatenate([self._values[first[sizes > k] + k] for k in range(sizes.max())])


def asking(longest: int, salts: dict[int, int], groups: int) -> Callable[[pa.Table], pa.Table]:
    """What a block ``(block, key, own)`` asks each group."""

    def ask(rows: pa.Table) -> pa.Table:
        block = rows.column(0)[0].as_py()
        grams = _Grams(rows.column("own"), longest, salts, groups)
        return pa.table(
            [
                pa.array(grams.groups.astype(np.int32)),
                pa.array(np.full(len(grams.groups), block, np.int32)),
                pa.array([_pack(grams.sizes[m]) for m in grams.members], pa.binary()),
                pa.array([_pack(grams.spelled(m)) for m in grams.members], pa.binary()),
            ],
            names=["group", "block", "sizes", "ids"],
        )

    return ask


def longest_begun(asked: pa.Table, sequences: pa.Table) -> pa.Table:
    """For each block that asked a group, the sizes of the longest sequences that its grams
    begin with, 0 for none; nothing for a block without any."""
    each = [_unpack(b) for b in asked.column("sizes").to_pylist()]
    listed, at_p, n_p = _ids(sequences.column("seq"))
    n_t = np.concatenate([*each, np.zeros(0, np.int64)])
    at_t = np.cumsum(n_t) - n_t
    own = np.zeros(n_t.sum(), np.int64)
    done = 0
    for sizes, blob in zip(each, asked.column("ids").to_pylist()):
        begins, ids, used = at_t[done : done + len(sizes)], _unpack(blob), 0
        for k in range(sizes.max(initial=0)):
            there = begins[sizes > k]
            own[there + k] = ids[used : used + len(there)]
            used += len(there)
        done += len(sizes)
    best = np.zeros(len(n_t), np.int64)
    known = pc.unique(listed)
    if len(known) and len(own):
        # What no sequence has is one further number.
        signs = pc.fill_null(pc.index_in(pa.array(own), known), len(known)).to_numpy(zero_copy_only=False)
        numbers = pc.index_in(listed, known).to_numpy(zero_copy_only=False)
        text, product = begun_with((signs.astype(np.int64), at_t, n_t), (numbers.astype(np.int64), at_p, n_p))
        np.maximum.at(best, text, n_p[product])
    found = np.split(best, np.cumsum([len(s) for s in each])[:-1]) if each else []
    some = [i for i, sizes in enumerate(found) if sizes.any()]
    rows = asked.select(["group", "block"]).take(pa.array(some, pa.int64()))
    return pa.table([*rows.columns, pa.array([_pack(found[i]) for i in some], pa.binary())], names=["group", "block", "sizes"])


def taking(longest: int, salts: dict[int, int], groups: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``(key, gone)`` of the rows of a block that lose ids: the places that matches take from
    left to right. Rows of one key are one."""

    def take(rows: pa.Table, answers: pa.Table) -> pa.Table:
        grams = _Grams(rows.column("own"), longest, salts, groups)
        size = np.zeros(max(grams.n, 1), np.int64)
        members = dict(zip(grams.groups.tolist(), grams.members))
        for group, blob in zip(answers.column("group").to_pylist(), answers.column("sizes").to_pylist()):
            size[members[group]] = _unpack(blob)
        matched = size[grams.of_place]
        places = np.flatnonzero(matched)
        keys = pc.dictionary_encode(rows.column("key"), null_encoding="encode").combine_chunks()
        if isinstance(keys, pa.ChunkedArray):
            keys = keys.chunk(0)
        row = np.repeat(np.arange(rows.num_rows), grams.lengths)[places]
        key = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        at, matched = places - grams.begin[row], matched[places]
        order = np.lexsort((matched, at, key))
        key, at, matched = key[order], at[order], matched[order]
        taken, last, free = [], -1, 0
        for i, (k, a, s) in enumerate(zip(key.tolist(), at.tolist(), matched.tolist())):
            if k != last:
                last, free = k, 0
            if a >= free:
                free = a + s
                taken.append(i)
        key, at, matched = key[taken], at[taken], matched[taken]
        before = np.cumsum(matched) - matched
        gone = np.arange(matched.sum()) + np.repeat(at - before, matched)
        own, begin = np.unique(key, return_index=True)
        ends = np.append(before[begin], matched.sum()) if len(own) else np.zeros(1, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(gone.astype(np.int32)))
        return pa.table([keys.dictionary.take(pa.array(own)), lists], names=["key", "gone"])

    return take
