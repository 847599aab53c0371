"""Scores of texts by prediction by partial matching, learnt from a corpus.

The model codes a text byte by byte: each word, A-Z lower-cased, then a blank, and at
last a line feed for the end. A byte's contexts are the last ORDER bytes down to
none; before a text there are blanks. The longest context that was seen predicts; a
byte it has never had costs an escape to the next shorter one, from which the
bytes that the longer ones would have coded are excluded. Escapes are estimated by
method D: of a context seen t times with d different bytes, a byte seen c times has
(2c - 1) / 2t and the escape d / 2t. Below the empty context all bytes left are
equally likely. A training byte counts in its contexts of all orders.

The trie covers the whole training corpus and is never held in one place. Its paths
of ORDER + 1 bytes are dealt out by the two bytes before the last: a shard holds
whole subtrees of contexts of two bytes and more. The tables of shorter contexts
have at most 252 * 252 entries, a bound by the alphabet, and go to every shard.

1. Cells of texts (see `cells`) send their distinct words and distinct paths with
   their training counts to the parts and shards that own them.
2. Parts answer with the words' counts, shards with the paths' log chances.
3. Cells add them up for each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.llm import cells
from banlist.llm.cells import STOP, pack, unpack
from banlist.llm.registry import query, table
from banlist.llm.workers import ragged, ship, slices
from banlist.session import write_table

ship(__name__)

ORDER = 5
# Bytes that can follow: all but white space, the blank after a word and the end.
ALPHABET = 252
# Tokens whose bytes are spread out together.
TOKENS_AT_ONCE = 200_000
_LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b" " * 5)


def paths(words: list[bytes], tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The coded bytes of a run of texts, each in the low byte of a number with the
    ORDER bytes before it, and how many each token has; some tokens at a time."""
    pad = b" " * ORDER
    pool = np.frombuffer(b"".join(STOP + pad if w == STOP else w + b" " for w in words), np.uint8)
    sizes = np.fromiter((1 if w == STOP else len(w) + 1 for w in words), np.int64, len(words))
    spread = sizes + ORDER * np.fromiter((w == STOP for w in words), bool, len(words))
    starts = np.cumsum(spread) - spread
    before = np.frombuffer(pad, np.uint8)
    for at in range(0, len(tokens), TOKENS_AT_ONCE):
        own = tokens[at : at + TOKENS_AT_ONCE]
        raw = np.concatenate([before, ragged(pool, starts[own], spread[own])])
        out = np.zeros(len(raw) - ORDER, np.uint64)
        for k in range(ORDER, -1, -1):
            out = (out << np.uint64(8)) | raw[ORDER - k : len(raw) - k]
        ends = np.cumsum(spread[own])
        skipped = ends[spread[own] != sizes[own]]
        coded = np.ones(len(out), bool)
        for k in range(1, ORDER + 1):
            coded[skipped - k] = False
        out = out[coded]
        yield out, sizes[own]
        before = raw[len(raw) - ORDER :]


def path_counts(words: list[bytes], tokens: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct paths, sorted, with their counts in training tokens."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    end = 0
    for keys, sizes in paths(words, tokens):
        own = np.repeat(train[end : end + len(sizes)], sizes)
        found.append(np.unique(keys[own], return_counts=True))
        others = np.unique(keys[~own])
        found.append((others, np.zeros(len(others), np.int64)))
        end += len(sizes)
    return summed(*map(np.concatenate, zip(*found)))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(where, counts, len(distinct)).astype(np.int64)


def places(ranked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where the keys stand in sorted distinct numbers, or -1."""
    if not len(ranked):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(ranked, keys), len(ranked) - 1)
    return np.where(ranked[at] == keys, at, -1)


class Level:
    """The contexts of one order: their bytes, weights and numbers of bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shorter: Level | None) -> None:
        self.keys, self.weights = keys, 2 * counts - 1
        self.contexts, where = np.unique(keys >> np.uint64(8), return_inverse=True)
        n = len(self.contexts)
        self.total = np.bincount(where, self.weights, n).astype(np.int64)
        self.kinds = np.bincount(where, minlength=n)
        self.excluded = np.zeros(n, np.int64)
        if shorter is not None and n:
            known = places(shorter.keys, keys & shorter.mask)
            self.excluded = np.bincount(where, shorter.weights[known], n).astype(np.int64)

    mask = np.uint64(0)


def levels(keys: np.ndarray, counts: np.ndarray, low: np.ndarray, low_counts: np.ndarray) -> list[Level]:
    """Orders 0 to ORDER, from a shard's training paths and the table of order 1."""
    out: list[Level] = []
    for order in range(ORDER + 1):
        mask = np.uint64((1 << (8 * (order + 1))) - 1)
        source = (low, low_counts) if order < 2 else (keys, counts)
        level = Level(*summed(source[0] & mask, source[1]), out[-1] if out else None)
        level.mask = mask
        out.append(level)
    return out


def log_chances(model: list[Level], wanted: np.ndarray) -> np.ndarray:
    """log10 of the chance of each path's last byte after the bytes before it."""
    out = np.zeros(len(wanted))
    left = np.arange(len(wanted))
    child = np.full(len(wanted), -1)
    above: Level | None = None
    for level in reversed(model):
        keys = wanted[left] & level.mask
        context = places(level.contexts, keys >> np.uint64(8))
        seen = context >= 0
        weight = np.where(seen, level.total[context], 0) if len(level.total) else np.zeros(len(left), np.int64)
        kinds = np.where(seen, level.kinds[context], 0) if len(level.kinds) else np.zeros(len(left), np.int64)
        if above is not None and len(above.kinds):
            under = child >= 0
            weight = weight - np.where(under, above.excluded[child], 0)
            kinds = kinds - np.where(under, above.kinds[child], 0)
        whole = np.log10(np.maximum(weight + kinds, 1))
        at = places(level.keys, keys)
        found = at >= 0
        if found.any():
            out[left[found]] += np.log10(level.weights[at[found]]) - whole[found]
        escape = ~found & (kinds > 0)
        out[left[escape]] += np.log10(kinds[escape]) - whole[escape]
        left, child = left[~found], context[~found]
        above = level
    seen = model[0].kinds[0] if len(model[0].kinds) else 0
    out[left] -= np.log10(ALPHABET - seen) if len(left) else 0
    return out


def _read(kind: pa.DataType):
    """Cells: a row for each text with its tokens, and one with the distinct words
    and paths and their training counts."""
    schema = pa.schema(
        [("cell", pa.int64()), ("k", kind), ("held", pa.bool_()), ("n", pa.int64()), ("n_paths", pa.int64())]
        + [(c, pa.binary()) for c in _BLOBS]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = cells.Numbers()
        for batch in slices(batches, "t", rows=1 << 20, size=cells.CELL_BYTES):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            held = np.array(batch.column(1).to_pylist(), bool)
            words, at = cells.tokens(b"".join((t or b"").translate(_LOWER) + b" \n " for t in texts))
            stop = words.index(pa.scalar(STOP, pa.binary())).as_py()
            ends = np.flatnonzero(at == stop) + 1
            lengths = np.diff(ends, prepend=0)
            train = ~np.repeat(held, lengths)
            counts = np.bincount(at[train], minlength=len(words)).astype(np.int64)
            keys, sums = path_counts(words.to_pylist(), at, train)
            packed = [pack(at[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            n, cell = len(texts) + 1, numbers.take()
            last = lambda value, kind: pa.array([None] * (n - 1) + [value], kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, cell, np.int64)),
                    pa.concat_arrays([batch.column(0), pa.nulls(1, kind)]),
                    pa.array([*held.tolist(), None]),
                    pa.array([*lengths.tolist(), len(words)], pa.int64()),
                    last(len(keys), pa.int64()),
                    pa.array([*packed, None], pa.binary()),
                    last(cells.pack_words(words), pa.binary()),
                    last(pack(counts), pa.binary()),
                    last(cells.pack_sorted(keys), pa.binary()),
                    last(pack(sums), pa.binary()),
                ],
                schema=schema,
            )

    return run


_BLOBS = ("tokens", "words", "counts", "paths", "path_counts")
_CELLS = ", ".join(f"{c} binary" for c in _BLOBS)
_ASKED = "cell long, part long, words binary, counts binary, places binary"
_PATHS = "cell long, shard long, paths binary, counts binary"
# Of words: places in the cell's list and counts. Of paths: the paths and their log chances.
_ANSWERS = "cell long, words boolean, places binary, values binary, total long, known long"


def _ask(parts: int):
    schema = cells.arrow_schema(_ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, blob, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, counts = cells.unpack_words(blob), unpack(packed, np.int64)
                rows = [
                    (cell, part, cells.pack_words(words.take(pa.array(at))), pack(counts[at]), pack(at.astype(np.int32)))
                    for part, at in cells.by_part(cells.word_owners(words, parts))
                ]
                yield cells.batch(schema, rows)

    return run


def _count_words(asked: pa.Table) -> pa.Table:
    """A part's answers: the training counts of each cell's words, and once the totals."""
    words = [cells.unpack_words(b) for b in asked.column("words").to_pylist()]
    counts = [unpack(b, np.int64) for b in asked.column("counts").to_pylist()]
    encoded = pa.concat_arrays(words).dictionary_encode()
    entries = encoded.indices.to_numpy()
    total = np.bincount(entries, np.concatenate(counts), len(encoded.dictionary)).astype(np.int64)
    rows, end = [], 0
    sums = (int(total.sum()), int((total > 0).sum()))
    for cell, own, where in zip(asked.column("cell").to_pylist(), words, asked.column("places").to_pylist()):
        rows.append((cell, True, where, pack(total[entries[end : end + len(own)]]), *sums))
        sums = (None, None)
        end += len(own)
    return pa.Table.from_batches([cells.batch(cells.arrow_schema(_ANSWERS), rows)])


def _send(shards: int):
    schema = cells.arrow_schema(_PATHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, blob, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys, sums = cells.unpack_sorted(blob), unpack(packed, np.int64)
                owners = cells.mixed((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(shards)
                rows = [
                    (cell, shard, cells.pack_sorted(keys[at]), pack(sums[at]))
                    for shard, at in cells.by_part(owners.astype(np.int64))
                ]
                yield cells.batch(schema, rows)

    return run


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of bytes after one byte."""
    keys, sums = np.empty(0, np.uint64), np.empty(0, np.int64)
    for batch in batches:
        for found, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            more = cells.unpack_sorted(found) & np.uint64(0xFFFF)
            keys, sums = summed(np.append(keys, more), np.append(sums, unpack(packed, np.int64)))
    seen = sums > 0
    yield pa.RecordBatch.from_arrays([pa.array(keys[seen].astype(np.int64)), pa.array(sums[seen])], ["key", "c"])


def _answer(low: np.ndarray, low_counts: np.ndarray):
    schema = cells.arrow_schema(_ANSWERS)

    def run(asked: pa.Table) -> pa.Table:
        keys = [cells.unpack_sorted(b) for b in asked.column("paths").to_pylist()]
        counts = [unpack(b, np.int64) for b in asked.column("counts").to_pylist()]
        distinct, total = summed(np.concatenate(keys), np.concatenate(counts))
        seen = total > 0
        chances = log_chances(levels(distinct[seen], total[seen], low, low_counts), distinct)
        rows = [
            (cell, False, blob, pack(chances[np.searchsorted(distinct, own)]), None, None)
            for cell, blob, own in zip(asked.column("cell").to_pylist(), asked.column("paths").to_pylist(), keys)
        ]
        return pa.Table.from_batches([cells.batch(schema, rows)])

    return run


def _score(total: int, known: int, kind: pa.DataType):
    scale = np.log10(total + 0.5 * (known + 1))
    schema = pa.schema(
        [("k", kind), ("held", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
    )

    def run(cell: pa.Table, answers: pa.Table) -> pa.Table:
        texts = cell.filter(cell.column("tokens").is_valid())
        words = next(b for b in cell.column("words").to_pylist() if b is not None).split(b" ")
        of_word = np.array(answers.column("words").to_pylist(), bool)
        where, values = answers.column("places").to_pylist(), answers.column("values").to_pylist()
        counts = np.empty(len(words), np.int64)
        for i in np.flatnonzero(of_word):
            counts[unpack(where[i], np.int32)] = unpack(values[i], np.int64)
        keys = np.concatenate([cells.unpack_sorted(where[i]) for i in np.flatnonzero(~of_word)])
        chances = np.concatenate([unpack(values[i], np.float64) for i in np.flatnonzero(~of_word)])
        at_path = pd.Index(keys.view(np.int64))
        tokens = [unpack(b, np.int32) for b in texts.column("tokens").to_pylist()]
        lengths = np.array([len(t) for t in tokens])
        at = np.concatenate(tokens)
        score = np.concatenate(
            [
                np.add.reduceat(chances[at_path.get_indexer(found.view(np.int64))], np.cumsum(sizes) - sizes)
                for found, sizes in paths(words, at)
            ]
        )
        base = np.log10(counts + 0.5) - scale
        starts = np.cumsum(lengths) - lengths
        found = (
            lengths,
            np.add.reduceat((counts > 0)[at].astype(np.int64), starts),
            np.add.reduceat(base[at], starts),
            np.add.reduceat(score, starts),
        )
        return pa.Table.from_arrays(
            [texts.column("k").combine_chunks(), texts.column("held").combine_chunks(), *map(pa.array, found)], schema=schema
        )

    return run


def scores(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Rows on which ``held_out`` is not true are the training corpus, in whole. Tokens
    are the words of the text, A-Z lower-cased and parted at ASCII white space, and
    its end; a null or empty text has only the end. ``base_score`` is a smoothed
    unigram's, ``score`` this model's log10 probability of the tokens. Repeated rows and
    keys count as often as they occur; null keys stay. Without training rows all words
    are unknown. An empty table gives an empty result; other columns play no role. A
    text is worked on in one task, in memory of some ten times its size.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, ddl = to_arrow_type(docs.schema[key].dataType), docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("t"))
    read = f"cell long, k {ddl}, held boolean, n long, n_paths long, {_CELLS}"
    own = write_table(rows.mapInArrow(_read(kind), read), "lm-cells")
    lists = own.where(F.col("words").isNotNull())
    asked = lists.select("cell", "words", "counts").mapInArrow(_ask(cells.part_count(lists, "n")), _ASKED)
    counted = write_table(asked.groupBy("part").applyInArrow(_count_words, _ANSWERS), "lm-words")
    total, known = counted.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    # At most 252 * 252 rows, by the alphabet.
    found = lists.select("paths", "path_counts").mapInArrow(_short, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    low = np.array([(r.key, r.c) for r in found.collect()], np.int64).reshape(-1, 2)
    sent = lists.select("cell", "paths", "path_counts").mapInArrow(_send(cells.part_count(lists, "n_paths")), _PATHS)
    coded = sent.groupBy("shard").applyInArrow(_answer(low[:, 0].astype(np.uint64), low[:, 1]), _ANSWERS)
    answers = counted.union(coded).select("cell", "words", "places", "values")
    scored = (
        own.select("cell", "k", "held", "tokens", "words")
        .groupBy("cell")
        .cogroup(answers.groupBy("cell"))
        .applyInArrow(_score(total, known, kind), f"k {ddl}, held boolean, n long, known long, base double, score double")
    )
    return scored.select(
        F.col("k").alias(key),
        F.col("held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )


@query("op12_ppm_scores")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
