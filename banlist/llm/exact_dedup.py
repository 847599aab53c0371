"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Each input partition hashes its normalised texts and sends every owner of a
   hash range its sorted, distinct hashes, with the gaps Golomb-Rice coded.
   What repeats within the partition is known to it already.
2. An owner decodes the lists, finds the hashes that two partitions hold, and
   answers each list with a bitmap.
3. Rows with a marked hash are suspects. Their marks go to a second scan as
   bitmaps of row numbers, and only suspects' texts are shuffled, grouped by the
   whole text. Grouping by the text compares its bytes, so a hash collision
   separates again.

An owner gets a hash at most once from a partition, however often the text
occurs, and texts are pre-aggregated where they are read: a text that a third
of all rows hold does not burden one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.llm import row_marks
from banlist.llm.registry import query, table
from banlist.llm.workers import ship
from banlist.session import write_table

ship(__name__)

HASH_BITS = 48
# Rows whose hashes are sorted and sent together.
BLOCK_ROWS = 1 << 18
_SPACES = " \t\n\x0b\x0c\r"


def rice_bits(gaps: np.ndarray) -> int:
    """Low bits stored plainly: the rest of a typical gap is then about one."""
    mean = float(gaps.mean()) if len(gaps) else 0.0
    return max(0, int(np.log2(mean * 0.69))) if mean > 1 else 0


def encode_sorted(values: np.ndarray) -> bytes:
    """Golomb-Rice code of sorted distinct numbers: one byte with the number of
    low bits, the low bits of all gaps, then the high parts in unary."""
    gaps = np.diff(values, prepend=values[:1] * 0)
    low = rice_bits(gaps)
    high = gaps >> low
    lows = ((gaps[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel()
    unary = np.zeros(int(high.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    return bytes([low]) + np.packbits(np.concatenate([lows, unary])).tobytes()


def decode_sorted(code: bytes, n: int) -> np.ndarray:
    low = code[0]
    bits = np.unpackbits(np.frombuffer(code, np.uint8, offset=1))
    lows = bits[: n * low].reshape(n, low).astype(np.int64) @ (np.int64(1) << np.arange(low, dtype=np.int64))
    stops = np.flatnonzero(bits[n * low :])[:n]
    high = np.diff(stops, prepend=-1) - 1
    return np.cumsum((high << low) | lows)


def _send(owner_bits: int):
    """Batch function of step 1: the rows with their place in the lists, and the lists."""

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(rows).combine_chunks()
        hashes = own.column("h").to_numpy()
        numbers = own.column("row").to_numpy()
        sender = int(numbers[0])
        distinct, where, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        owners = distinct >> (HASH_BITS - owner_bits)
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        lengths = np.diff(np.append(cuts, len(distinct)))
        place = np.arange(len(distinct)) - np.repeat(cuts, lengths)
        codes = [
            encode_sorted(distinct[a : a + n] & ((1 << (HASH_BITS - owner_bits)) - 1))
            for a, n in zip(cuts.tolist(), lengths.tolist())
        ]
        m, n = len(hashes), len(codes)
        columns = {
            "row": pa.array(np.append(numbers, np.zeros(n, np.int64)), mask=np.arange(m + n) >= m),
            "sender": pa.array(np.full(m + n, sender, np.int64)),
            "owner": pa.array(np.append(owners[where], owners[cuts]).astype(np.int32)),
            "place": pa.array(np.append(place[where], lengths).astype(np.int32)),
            "repeated": pa.array(np.append(counts[where] > 1, np.zeros(n, bool))),
            "code": pa.array([None] * m + codes, pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block(held)
                held, n = [], 0
        if held:
            yield block(held)

    return run


def _answer(lists: pa.Table) -> pa.Table:
    """Group function of step 2: a bitmap for each list of one owner."""
    sizes = lists.column("place").to_numpy().astype(np.int64)
    hashes = np.concatenate([decode_sorted(c, n) for c, n in zip(lists.column("code").to_pylist(), sizes.tolist())])
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    twice = np.zeros(len(ranked), bool)
    same = ranked[1:] == ranked[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    marks = np.zeros(len(ranked), np.uint8)
    marks[order] = twice
    ends = np.cumsum(sizes)
    bitmaps = [np.packbits(marks[e - n : e]).tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
    return pa.table({"sender": lists.column("sender"), "owner": lists.column("owner"), "bitmap": pa.array(bitmaps, pa.binary())})


def normalised(text: str) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(F.col(text), F.lit(""))
    for space in _SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def suspects(hashes: DataFrame, owners: int | None = None) -> DataFrame:
    """``(row)`` of the rows whose hash occurs more than once in the table
    ``(row, h)``; two different texts may share a hash."""
    spark = hashes.sparkSession
    wanted = owners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    owner_bits = min(16, max(0, (wanted - 1).bit_length()))
    sent = write_table(
        hashes.mapInArrow(
            _send(owner_bits),
            "row long, sender long, owner int, place int, repeated boolean, code binary",
        ),
        "sent-hashes",
    )
    lists = sent.where(F.col("code").isNotNull()).select("sender", "owner", "place", "code")
    answers = lists.groupBy("owner").applyInArrow(_answer, "sender long, owner int, bitmap binary")
    rows = sent.where(F.col("code").isNull())
    byte = F.conv(F.hex(F.expr("substring(bitmap, place div 8 + 1, 1)")), 16, 10).cast("int")
    marked = F.getbit(byte, (F.lit(7) - F.col("place") % 8)) == 1
    once = rows.where(~F.col("repeated")).join(answers, ["sender", "owner"]).where(marked)
    return once.select("row").union(rows.where("repeated").select("row"))


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, key, keep, keep_row, group_size, sha)`` of every row.

    ``row`` is the row's number in the scan of ``docs`` (see `row_marks`), so
    repeated rows, repeated keys and null keys are told apart. Of equal texts
    the one with the most code points stays, then the smallest key (null
    last), then the first row. An empty table gives an empty result.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    norm = normalised("text")
    scanned = row_marks.numbered(slim, "row").select(
        "row",
        "key",
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"),
        norm.alias("norm"),
    )
    shift = 64 - HASH_BITS
    narrow = write_table(
        scanned.select(
            "row",
            "key",
            "n",
            F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
            F.expr(f"shiftrightunsigned(xxhash64(norm), {shift})").alias("h"),
        ),
        "text-hashes",
    )
    found = suspects(narrow.select("row", "h"))
    texts = row_marks.with_marks(slim, found).where("__marked").select(
        F.col("__row").alias("row"), "key", F.coalesce(F.length("text"), F.lit(0)).alias("n"), norm.alias("norm")
    )
    first = F.struct(
        (-F.col("n")).cast("bigint").alias("less"), F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("row")
    )
    by_text = (
        texts.groupBy("norm")
        .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
        .select(F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "first", "size")
    )
    groups = write_table(
        by_text.groupBy("sha").agg(
            F.min("first").alias("first"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("texts")
        ),
        "text-groups",
    )
    # Two different texts with one SHA-256 have never been seen; they must not pass as equal.
    if groups.where("texts > 1").head(1):
        raise RuntimeError("two different texts have the same SHA-256")
    joined = narrow.select("row", "key", "sha").join(groups, "sha", "left")
    alone = F.col("first").isNull()
    return joined.select(
        "row",
        F.col("key").alias(key),
        F.when(alone, F.col("key")).otherwise(F.col("first.key")).alias("keep"),
        F.when(alone, F.col("row")).otherwise(F.col("first.row")).alias("keep_row"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        "sha",
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; no text is shuffled
    but the suspects'."""
    groups = duplicate_groups(docs, key, text)
    return row_marks.without_rows(docs, groups.where("row <> keep_row").select("row"))


@query(
    "op9_exact_dedup",
    sql="""
with n as (
  select doc_id, length(coalesce(text, '')) as n,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256
  from documents
), k as (
  select doc_id, text_sha256,
    first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
    count(*) over (partition by text_sha256) as group_size
  from n
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from k
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id",
        F.col("keep").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
