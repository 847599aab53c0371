"""Near duplicates by b-bit MinHash, confirmed on whole shingle sets.

1. One pass over the texts gives each document its set's size and 128-bit hash,
   the keys of its bands of minima, and two low bits of each minimum, packed.
   Documents with equal sets are one class from here on.
2. Classes that share a band key are candidates. Inside a bucket the packed
   signatures are compared by bit counts: equal bits, corrected for those that
   agree by chance, estimate the similarity. What is clearly below is dropped.
3. Candidate components get their whole sets, computed again from the texts of
   these classes only, and links are confirmed on intersection and union.

Buckets and components of any size are worked on in blocks (see `graph`), and
only spanning links leave a block, so neither pairs nor groups pile up.

With 32 bands of 4 minima a link of similarity 0.8 shares no band with a
probability of 5e-8; the estimate's bar lies about six standard errors lower.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.llm import row_marks
from banlist.llm.graph import link_groups
from banlist.llm.registry import query, table
from banlist.llm.workers import ship, slices
from banlist.session import write_table

ship(__name__)

HASHES = 128
BAND = 4
LOW_BITS = 2
PERCENT = 80
# Estimates below the threshold by so much are no candidates.
SLACK = 0.25
BATCH_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_SEED = 20240607


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashed shingle sets of texts: words split at ASCII white space, A-Z lower-cased."""

    def __init__(self, words: int) -> None:
        random = np.random.default_rng(_SEED)
        self.words = words
        self.of_byte = random.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
        lower = np.arange(256)
        lower[65:91] += 32
        self.of_byte = self.of_byte[lower]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n <= len(self.powers):
            return
        back = np.uint64(pow(_BASE, -1, 1 << 64))
        self.powers = np.cumprod(np.append(np.uint64(1), np.full(n - 1, np.uint64(_BASE))), dtype=np.uint64)
        self.inverse = np.cumprod(np.append(np.uint64(1), np.full(n - 1, back)), dtype=np.uint64)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text. A text of fewer words
        than a shingle has one, of all its words; one without words has none."""
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self._grow(len(raw) + 1)
        # A word's hash is the polynomial of its bytes, from running sums.
        gap = self.space[raw]
        running = np.append(np.uint64(0), np.cumsum(self.of_byte[raw] * self.inverse[: len(raw)], dtype=np.uint64))
        edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        words = _mix((running[ends] - running[starts]) * self.powers[starts] + (ends - starts).astype(np.uint64))
        sizes = np.array([len(t) + 1 for t in texts])
        borders = np.searchsorted(starts, np.append(0, np.cumsum(sizes)))
        n = len(words) - self.words + 1
        shingles = np.empty(0, np.uint64)
        if n > 0:
            shingles = np.full(n, np.uint64(self.words))
            for k in range(self.words):
                shingles = _mix(shingles * np.uint64(_BASE) + words[k : k + n])
        out = []
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            if b - a >= self.words:
                out.append(np.unique(shingles[a : b - self.words + 1]))
            elif b > a:
                short = np.full(1, np.uint64(b - a))
                for k in range(a, b):
                    short = _mix(short * np.uint64(_BASE) + words[k : k + 1])
                out.append(short)
            else:
                out.append(np.empty(0, np.uint64))
        return out


class Signer:
    """Minima of a set under many hash functions, their bands and low bits."""

    def __init__(self) -> None:
        random = np.random.default_rng(_SEED + 1)
        self.factor = random.integers(0, 2**32, HASHES, np.uint32) | np.uint32(1)
        self.shift = random.integers(0, 2**32, HASHES, np.uint32)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(HASHES, np.iinfo(np.uint32).max)
        for at in range(0, len(x), 2048):
            least = np.minimum(least, (x[at : at + 2048, None] * self.factor + self.shift).min(axis=0))
        return least.astype(np.uint32)

    def bands(self, minima: np.ndarray) -> np.ndarray:
        parts = minima.reshape(len(minima), -1, BAND).astype(np.uint64)
        keys = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
        for k in range(BAND):
            keys = _mix(keys * np.uint64(_BASE) + parts[:, :, k])
        return keys

    def low_bits(self, minima: np.ndarray) -> np.ndarray:
        """LOW_BITS bits of each minimum, packed into bytes."""
        low = (minima * np.uint32(0x9E3779B1)) >> np.uint32(32 - LOW_BITS)
        bits = (low[:, :, None] >> np.arange(LOW_BITS, dtype=np.uint32)) & np.uint32(1)
        return np.packbits(bits.reshape(len(minima), -1).astype(np.uint8), axis=1)


def estimated(signatures: np.ndarray) -> np.ndarray:
    """Similarities of all pairs of packed signatures, corrected for chance."""
    differing = np.zeros((len(signatures), len(signatures)), np.uint8)
    words = np.ascontiguousarray(signatures).view(np.uint64)
    odd = np.uint64(0x5555555555555555)
    for k in range(words.shape[1]):
        differ = words[:, k, None] ^ words[None, :, k]
        differing += np.bitwise_count((differ | (differ >> np.uint64(1))) & odd)
    share = np.float32(1) - differing / np.float32(HASHES)
    chance = np.float32(0.5**LOW_BITS)
    return (share - chance) / (1 - chance)


def _near(percent: int):
    def kernel(payloads: list[bytes], _: np.ndarray) -> np.ndarray:
        signatures = np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), -1)
        return np.triu(estimated(signatures) >= percent / 100 - SLACK, 1)

    return kernel


def _linked(percent: int):
    def kernel(payloads: list[bytes], _: np.ndarray) -> np.ndarray:
        """All pairs' intersections: shingles in one set only count for none."""
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        n = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), n)
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = counts > 1
        number = np.cumsum(often) - 1
        keep = often[column]
        rows, columns = owner[keep], number[column[keep]]
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        width = max(64, min(4096, 8_000_000 // max(1, len(sets))))
        for at in range(0, int(often.sum()), width):
            a, b = np.searchsorted(columns, [at, at + width])
            grid = np.zeros((len(sets), width), np.float32)
            grid[rows[a:b], columns[a:b] - at] = 1
            both += grid @ grid.T
        # 100 * both >= percent * (n + m - both), in whole numbers.
        shared = both.astype(np.int64)
        return np.triu((100 + percent) * shared >= percent * (n[:, None] + n[None, :]), 1)

    return kernel


def signatures(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, k, n, f1, f2, keys, bits)`` of every row, numbered as in `row_marks`.
    The last two are null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(words), Signer()
        for batch in slices(batches, "t", size=BATCH_BYTES):
            sets = shingler.sets([x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()])
            n = np.array([len(s) for s in sets], np.int64)
            minima = np.stack([signer.minima(s) for s in sets])
            empty = n == 0
            with np.errstate(over="ignore"):
                f1 = [int(_mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                f2 = [int(_mix(s + np.uint64(_BASE)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            keys = [None if e else k.tobytes() for e, k in zip(empty, signer.bands(minima))]
            bits = [None if e else k.tobytes() for e, k in zip(empty, signer.low_bits(minima))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n),
                    pa.array(f1, pa.int64()),
                    pa.array(f2, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(bits, pa.binary()),
                ],
                ["row", "k", "n", "f1", "f2", "keys", "bits"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = row_marks.numbered(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "row").select("row", "k", "t")
    return rows.mapInArrow(run, f"row long, k {kind}, n long, f1 long, f2 long, keys binary, bits binary")


def whole_sets(docs: DataFrame, rows: DataFrame, words: int, text: str = "text") -> DataFrame:
    """``(node, size, payload)``: the whole sets of the marked rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, "t", size=BATCH_BYTES):
            sets = shingler.sets([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()])
            packed = [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(p) for p in packed], pa.int64()), pa.array(packed, pa.binary())],
                ["node", "size", "payload"],
            )

    marked = row_marks.with_marks(docs.select(F.col(text).alias("t")), rows).where("__marked").select("__row", "t")
    return marked.mapInArrow(run, "node long, size long, payload binary")


def near_groups(
    docs: DataFrame, words: int = 5, percent: int = PERCENT, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(row, key, n_shingles, component, keep_row)`` of every row.

    ``component`` is the smallest key of the rows that are reachable by links
    of at least ``percent`` similarity; ``keep_row`` is the number of the row that
    has it (the first, if several have; null keys come last). A null or empty
    text, or one of white space, is linked with nothing. Repeated rows have
    equal sets and so are one group. An empty table gives an empty result.
    ``docs`` must be a scan that gives the same rows in the same order again.
    """
    signed = write_table(signatures(docs, words, key, text), "signatures")
    full = signed.where("n > 0")
    best = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "row")).alias("best")
    classes = write_table(
        full.groupBy("n", "f1", "f2").agg(F.min("row").alias("node"), best), "set-classes"
    )
    nodes = full.join(classes.select(F.col("node").alias("row")), "row")
    # Band keys as numbers; only those that two classes have are of interest.
    hexed = F.hex("keys")
    spread = nodes.select(
        F.col("row").alias("node"),
        "bits",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda i: F.substring(hexed, i * 16 + 1, F.lit(16)))).alias("h"),
    ).select("node", "bits", F.xxhash64("h").alias("grp"))
    shared = spread.select("grp").groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("grp")
    shared = write_table(shared, "shared-bands")
    members = write_table(
        spread.join(shared, "grp").select("grp", "node", F.octet_length("bits").cast("bigint").alias("size"), F.col("bits").alias("payload")),
        "bucket-members",
    )
    near = write_table(link_groups(members, _near(percent)), "near-classes")
    sets = write_table(whole_sets(docs, near.select(F.col("node").alias("row")), words, text), "whole-sets")
    found = link_groups(
        sets.join(near, "node").select(F.col("label").alias("grp"), "node", "size", "payload"), _linked(percent)
    )
    labels = write_table(found, "linked-classes")
    placed = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = placed.groupBy("label").agg(F.min("best").alias("first"))
    by_class = write_table(
        placed.select("n", "f1", "f2", "label").join(groups, "label").select("n", "f1", "f2", "first"), "class-groups"
    )
    alone = F.col("first").isNull()
    return (
        signed.select("row", "k", "n", "f1", "f2")
        .join(by_class, ["n", "f1", "f2"], "left")
        .select(
            "row",
            F.col("k").alias(key),
            F.col("n").alias("n_shingles"),
            F.when(alone, F.col("k")).otherwise(F.col("first.k")).alias("component"),
            F.when(alone, F.col("row")).otherwise(F.col("first.row")).alias("keep_row"),
        )
    )


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of each group, with the columns of ``docs``."""
    groups = near_groups(docs, words, percent)
    return row_marks.without_rows(docs, groups.where("row <> keep_row").select("row"))


@query("op6_minhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"), words=2)
    return groups.select(
        "doc_id",
        "n_shingles",
        F.col("component").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"),
    )
