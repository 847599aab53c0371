"""Greedy pair merging of many tokens at once, by numbered pieces.

Every text that a rule takes or makes has a number, so a rule is a pair of numbers,
and what may be merged next is one lookup for each two neighbours: no stretches of
a token are formed, however long the longest product is. All tokens of a batch
are merged together, one merge of each token a round.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A rule list up to these sizes goes to the tasks: 24 bytes a rule, collected
# as texts of so many characters.
TABLE_RULES = 4_000_000
TABLE_CHARS = 128_000_000
_NONE = np.iinfo(np.int64).max


class PairTable(NamedTuple):
    """Rules as numbers: ``pairs`` are left << 32 | right, in order."""

    chars: np.ndarray
    char_pieces: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    products: np.ndarray


def fits_table(rules: DataFrame) -> bool:
    """Measure a list of rules ``(l, r, merge_rank)``."""
    chars = F.sum(F.octet_length("l") + F.octet_length("r"))
    n, size = rules.agg(F.count(F.lit(1)), F.coalesce(chars, F.lit(0))).first()
    return n <= TABLE_RULES and size <= TABLE_CHARS


def pair_table(rules: pa.Table) -> PairTable:
    """The table of rules ``(l, r, merge_rank)``, each pair once."""
    left, right = (rules.column(c).combine_chunks().cast(pa.string()) for c in ("l", "r"))
    made = pc.binary_join_element_wise(left, right, "")
    encoded = pa.concat_arrays([left, right, made]).dictionary_encode()
    l, r, product = np.split(encoded.indices.to_numpy().astype(np.int64), 3)
    pairs = (l << 32) | r
    order = np.argsort(pairs)
    single = np.flatnonzero(pc.equal(pc.utf8_length(encoded.dictionary), 1).to_numpy(zero_copy_only=False))
    chars = np.array([ord(c) for c in encoded.dictionary.take(pa.array(single)).to_pylist()], np.int64)
    by_char = np.argsort(chars)
    ranks = rules.column("merge_rank").to_numpy().astype(np.int64)
    return PairTable(
        chars[by_char], single[by_char].astype(np.int32), pairs[order], ranks[order], product[order].astype(np.int32)
    )


class Merger:
    def __init__(self, table: PairTable) -> None:
        self.table = table
        self.index = pd.Index(table.pairs)

    def char_pieces(self, codes: np.ndarray) -> np.ndarray:
        """Piece numbers of characters; -1 for one that no rule knows."""
        if not len(self.table.chars):
            return np.full(len(codes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.table.chars, codes), len(self.table.chars) - 1)
        return np.where(self.table.chars[at] == codes, self.table.char_pieces[at], -1).astype(np.int64)

    def rules_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the rules that join the pairs, or -1."""
        known = (left >= 0) & (right >= 0)
        return np.where(known, self.index.get_indexer((left << 32) | right), -1)

    def starts(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For characters of tokens one after another: does a piece start there?"""
        keep = np.ones(len(codes), bool)
        at = np.arange(len(codes))
        token = np.repeat(np.arange(len(lengths)), lengths)
        piece = self.char_pieces(codes)
        rule = np.full(len(codes), -1)
        if len(codes) > 1:
            rule[:-1] = np.where(token[:-1] == token[1:], self.rules_of(piece[:-1], piece[1:]), -1)
        while len(at):
            rank = np.where(rule >= 0, self.table.ranks[rule], _NONE) if len(self.table.ranks) else np.full(len(rule), _NONE)
            new = np.diff(token, prepend=-1) != 0
            segment = np.cumsum(new) - 1
            best = np.minimum.reduceat(rank, np.flatnonzero(new))
            going = (best < _NONE)[segment]
            hits = np.flatnonzero(going & (rank == best[segment]))
            first = hits[np.diff(segment[hits], prepend=-1) != 0]  # the leftmost of each token
            keep[at[first + 1]] = False
            piece[first] = self.table.products[rule[first]]
            going[first + 1] = False
            place = np.cumsum(going) - 1
            at, token, piece, rule = at[going], token[going], piece[going], rule[going]
            touched = place[first]
            touched = np.union1d(touched, touched - 1)
            touched = touched[touched >= 0]
            follows = np.minimum(touched + 1, max(len(at) - 1, 0))
            beside = (follows > touched) & (token[touched] == token[follows])
            rule[touched] = np.where(beside, self.rules_of(piece[touched], piece[follows]), -1)
        return keep

    def starts_of_one(self, codes: np.ndarray) -> np.ndarray:
        """The same for one long token, on a heap."""
        n, table = len(codes), self.table
        piece = self.char_pieces(codes).tolist()
        pairs, ranks, products = table.pairs, table.ranks, table.products

        def rule(i: int, j: int) -> int:
            if j >= n or piece[i] < 0 or piece[j] < 0 or not len(pairs):
                return -1
            key = (piece[i] << 32) | piece[j]
            at = int(np.searchsorted(pairs, key))
            return at if at < len(pairs) and pairs[at] == key else -1

        first = self.rules_of(np.array(piece[:-1], np.int64), np.array(piece[1:], np.int64))
        waiting = [(int(ranks[r]), i, i + 1, piece[i], piece[i + 1], int(r)) for i, r in enumerate(first.tolist()) if r >= 0]
        heapify(waiting)
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        keep = np.ones(n, bool)
        while waiting:
            _, i, j, left, right, r = heappop(waiting)
            if not (keep[i] and j < n and keep[j] and behind[i] == j and piece[i] == left and piece[j] == right):
                continue
            keep[j] = False
            piece[i] = int(products[r])
            behind[i] = behind[j]
            if behind[j] < n:
                before[behind[j]] = i
            for a, b in ((before[i], i), (i, behind[i])):
                if a >= 0 and (new := rule(a, b)) >= 0:
                    heappush(waiting, (int(ranks[new]), a, b, piece[a], piece[b], new))
        return keep


def merge_pieces(tokens: DataFrame, rules: DataFrame, keep: Sequence[str], long_chars: int) -> DataFrame:
    """``(token, keep..., pieces, depth)`` for a list of rules of checked size.
    Tokens over ``long_chars`` characters are merged one by one."""
    shared = tokens.sparkSession.sparkContext.broadcast(pair_table(rules.select("l", "r", "merge_rank").toArrow()))
    rows = tokens.select("token", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(shared.value)
        for batch in batches:
            texts = batch.column(0).cast(pa.string())
            raw = b"".join(texts.cast(pa.binary()).to_pylist())
            codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
            lengths = pc.utf8_length(texts).to_numpy().astype(np.int64)
            starts = np.ones(len(codes), bool)
            short = lengths <= long_chars
            of_short = np.repeat(short, lengths)
            starts[of_short] = merger.starts(codes[of_short], lengths[short])
            ends = np.cumsum(lengths)
            for i in np.flatnonzero(~short).tolist():
                own = slice(int(ends[i] - lengths[i]), int(ends[i]))
                starts[own] = merger.starts_of_one(codes[own])
            counts = np.zeros(len(lengths), np.int64)
            filled = lengths > 0
            if filled.any():
                counts[filled] = np.add.reduceat(starts.astype(np.int64), (ends - lengths)[filled])
            # Pieces follow one another as the characters do, so the texts' own bytes are theirs.
            bytes_at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            edges = np.append(bytes_at[starts], len(raw)).astype(np.int32)
            pieces = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(raw))
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pieces), pa.array(lengths - counts)],
                [*batch.schema.names, "pieces", "depth"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, pieces array<string>, depth bigint")
