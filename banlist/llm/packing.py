"""Best-fit packing of token sequences, decided on the histogram of lengths.

Pieces of one length are interchangeable, so the packing is decided for
lengths and counts, and a step places as many equal bins at once as the counts
allow. A large item is longer than a third of the capacity; at most two share
a bin.

1. Large items, longest first, each take the longest large item that still
   fits beside them (greedy matching), or stay alone.
2. The gaps are filled with smaller items, smallest gap first: each gap takes
   the longest small item that fits, again and again.
3. Small items that are left fill new bins in the same way.

The plan has at most a few rows per length, whatever the number of pieces, and
is made on the driver from at most `capacity` counts. Pieces get their rank
within their length by counting first per block and then inside blocks, so
neither a very common length nor anything else gathers in one task.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from banlist.llm import byte_level
from banlist.llm.registry import query, table
from banlist.llm.workers import ship, slices
from banlist.session import write_table

ship(__name__)

CAPACITY = 2048
# A run of white space over this length is a piece of its own for the split pattern,
# whose engine would give up on it.
LONG_RUN = 100_000
_RUNS = re.compile(
    "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN
)
# At least so many blocks share the ranking of one length.
RANK_BLOCKS = 256


class FastByteLevel:
    """Ids of a byte-level tokenizer file, by the rank-ordered encoder.

    The file's ids must be in the order of its merges, so that the two
    libraries agree; special strings keep their own ids.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        spec = byte_level.load(path)
        split = spec["pre_tokenizer"]
        plain = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        if spec["normalizer"] or not plain or spec["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path}: only plain byte-level files")
        back = {c: b for b, c in enumerate(byte_level.byte_alphabet())}
        vocab = spec["model"]["vocab"]
        made = [vocab[a + b] for a, b in byte_level.pairs(spec)]
        if made != sorted(made) or (made and made[0] < 256):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.coder = tiktoken.Encoding(
            "file", pat_str=byte_level.BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens=self.special
        )
        self.allowed = set(self.special)

    def ids(self, text: str) -> np.ndarray:
        if len(text) < LONG_RUN or not _RUNS.search(text):
            return self._plain(text)
        out = []
        for part, special in byte_level.cut_out(text, [*self.special]):
            out += [np.array([self.special[part]], np.uint32)] if special else self._around_runs(part)
        return np.concatenate(out)

    def _around_runs(self, text: str) -> list[np.ndarray]:
        out, at = [], 0
        for run in _RUNS.finditer(text):
            # The last blank before a word goes with the word.
            end = run.end() if run.end() == len(text) else run.end() - 1
            out.append(self._plain(text[at : run.start()]))
            out.append(np.array(self.coder._encode_single_piece(text[run.start() : end]), np.uint32))
            at = end
        return [*out, self._plain(text[at:])]

    def _plain(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, allowed_special=self.allowed)


def pieces(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    text: str = "text",
    key: str = "doc_id",
    keep_ids: bool = False,
) -> DataFrame:
    """``(key, piece, start, length, ids_crc32, ids)`` of every document's pieces.

    A document's ids are its text's, then ``end_id``; a null text has only the
    latter. Longer ones are cut from their end into pieces of ``capacity``, so
    that only the first may be shorter. ``ids`` is null unless asked for.
    Repeated rows and null keys stay rows of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = FastByteLevel(path)
        for batch in slices(batches, "t"):
            owner, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, own in enumerate(batch.column(1).to_pylist()):
                ids = np.append(coder.ids(own or "").astype("<u4"), np.uint32(end_id))
                n = len(ids)
                cuts = [0, *range(n - (n - 1) // capacity * capacity, n, capacity)]
                for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], n])):
                    owner.append(row)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    kept.append(ids[a:b].astype(np.int32) if keep_ids else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(kept, pa.list_(pa.int32())),
                ],
                ["k", "piece", "start", "length", "ids_crc32", "ids"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = f"k {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many alike, [(length, items of it), ...]) for counts by length."""
    left = {n: c for n, c in counts.items() if c}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must be between 1 and the capacity")
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    small = sorted(n for n in left if 3 * n <= capacity)
    opened: list[tuple[int, list[tuple[int, int]], int]] = []  # gap, items, bins

    # 1. Partners for large items.
    for n in large:
        while left[n]:
            room = capacity - n
            mate = next((m for m in large if m <= room and left[m] and (m != n or left[n] > 1)), None)
            if mate is None:
                opened.append((room, [(n, 1)], left[n]))
                left[n] = 0
            elif mate == n:
                opened.append((capacity - 2 * n, [(n, 2)], left[n] // 2))
                left[n] %= 2
            else:
                bins = min(left[n], left[mate])
                opened.append((room - mate, [(n, 1), (mate, 1)], bins))
                left[n] -= bins
                left[mate] -= bins

    # 2. and 3. Small items into the gaps, smallest gap first, then into new bins.
    done: list[tuple[int, list[tuple[int, int]]]] = []
    queue = [(gap, k, items, bins) for k, (gap, items, bins) in enumerate(opened)]
    heapq.heapify(queue)
    fresh = len(queue)
    while True:
        if not queue:
            if not any(left[n] for n in small):
                return done
            total = sum(n * left[n] for n in small)
            queue = [(capacity, fresh, [], max(1, -(-total // capacity)))]
            fresh += 1
        gap, _, items, bins = heapq.heappop(queue)
        fit = next((n for n in reversed(small) if n <= gap and left[n]), None)
        if fit is None:
            if items:
                done.append((bins, items))
            continue
        each = gap // fit
        if left[fit] >= bins * each:
            left[fit] -= bins * each
            queue_item = (gap - each * fit, fresh, [*items, (fit, each)], bins)
            heapq.heappush(queue, queue_item)
            fresh += 1
            continue
        # Not enough for all: some bins get `each`, one the rest, the others none of it.
        full, rest = divmod(left[fit], each)
        left[fit] = 0
        for number, take in ((full, each), (1 if rest else 0, rest), (bins - full - (1 if rest else 0), 0)):
            if number:
                more = [*items, (fit, take)] if take else items
                heapq.heappush(queue, (gap - take * fit, fresh, more, number))
                fresh += 1


_SLOTS = T.StructType(
    [
        T.StructField("length", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("items", T.LongType()),
        T.StructField("each", T.LongType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def slot_rows(plan: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks of a length go where: ranks from ``first`` on, ``items`` of
    them, ``each`` in a bin one behind the other from ``offset``, bins numbered
    from ``sequence``."""
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for bins, items in plan:
        offset = 0
        for n, each in items:
            first = used.get(n, 0)
            rows.append((n, first, bins * each, each, sequence, offset))
            used[n] = first + bins * each
            offset += n * each
        sequence += bins
    return rows


def dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """The rows of a written table with ``__block``, by a hash of file and place."""
    return rows.withColumn(
        "__block", F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(blocks)).cast("int")
    )


def ranked(rows: DataFrame, by: str, order: list[str], name: str = "rank") -> DataFrame:
    """Number the rows of each value of ``by`` from 0, however many there are.

    ``rows`` must be a written table. Its rows are dealt to blocks by their
    files and places, so rows that are alike in all columns are dealt out too,
    and both scans deal alike however they are split; blocks are counted, and a
    row's number is its block's start plus its place in the block.
    """
    blocks = max(RANK_BLOCKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealing = dealt(rows, blocks)
    sizes = dealing.groupBy(by, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(by, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(by, "__block").orderBy(*order)
    placed = dealing.withColumn("__place", F.row_number().over(inside) - 1)
    return (
        placed.join(starts, [by, "__block"])
        .withColumn(name, F.col("__start") + F.col("__place"))
        .drop("__block", "__start", "__place")
    )


def pack(items: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """The items with ``sequence_id`` and ``offset``.

    ``items`` has a column ``length`` of 1 to ``capacity``; ``order`` names columns
    that tell items of a length apart as far as possible (ties are broken
    anyhow, equal items being interchangeable). The items are written once
    below the checkpoint folder. An empty table stays empty.
    """
    spark = items.sparkSession
    stored = write_table(items, "pieces")
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = slot_rows(plan_bins(counts, capacity))
    slots = spark.createDataFrame(rows, _SLOTS)
    # Per length its stretches of ranks in one array: a few thousand in all.
    stretch = F.struct("first", "items", "each", "sequence", "offset")
    by_length = slots.groupBy("length").agg(F.array_sort(F.collect_list(stretch)).alias("stretches"))
    numbered = ranked(stored, "length", order).join(F.broadcast(by_length), "length")
    own = F.element_at(F.filter("stretches", lambda s: s["first"] <= F.col("rank")), -1)
    inside = F.col("rank") - F.col("own.first")
    return (
        numbered.withColumn("own", own)
        .withColumn("sequence_id", F.expr("own.sequence + (rank - own.first) div own.each"))
        .withColumn("offset", F.col("own.offset") + inside % F.col("own.each") * F.col("length"))
        .select(*stored.columns, "sequence_id", "offset")
    )


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
    return pack(cut, ["doc_id", "piece", "start", "ids_crc32"])
