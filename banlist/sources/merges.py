"""Merge rules from text files and from tokenizer JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.functions.fixed_values import WHITESPACE
from banlist.functions.text import strip
from banlist.operators.ranking import with_index

# Lines that are written at once.
PACK_LINES = 10_000
_GAP = f"[{WHITESPACE}]+"


def _last_rank(rules: DataFrame) -> DataFrame:
    """A rule listed twice keeps its later rank."""
    return rules.groupBy("l", "r").agg(F.max("merge_rank").alias("merge_rank"))


def read_merges_text(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a merges file, or from a folder of parts in name order.

    Comment lines, blank lines and lines without exactly two parts are
    skipped; the rank is the place among the lines kept.
    """
    line = strip("value")
    parts = F.split(line, _GAP, -1)
    placed = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
        line.alias("line"),
        parts.alias("parts"),
    )
    kept = placed.where(
        (F.col("line") != "") & ~F.startswith("line", F.lit("#")) & (F.size("parts") == 2)
    )
    # Within one block of a file the row numbers rise with the lines.
    ranked = with_index(
        kept.select("file", "start", "row", F.col("parts")[0].alias("l"), F.col("parts")[1].alias("r")),
        ["file", "start", "row"],
        "merge_rank",
    )
    return _last_rank(ranked)


def write_in_order(lines: DataFrame, number: str, path: str, first: str, last: str) -> None:
    """Write ``(number, value)`` as one text file, a line each, between two more lines.

    The numbers count from 0 without gaps. Lines are joined and packed by many tasks; the
    one that writes the file puts the packs in order and holds one of them unpacked.
    """
    pack = F.floor(F.col(number) / PACK_LINES)
    joined = F.array_join(F.sort_array(F.collect_list(F.struct(number, "value")))["value"], "\n")
    packed = lines.groupBy(pack.alias("pack")).agg(joined.alias("value"))
    ends = lines.sparkSession.createDataFrame([(-1, first), (1 << 62, last)], "pack long, value string")

    # Nested, so that executors need no copy of this package.
    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            texts = [zlib.compress(t.as_py().encode(), 1) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["pack", "value"])

    def unpress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for value in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([zlib.decompress(value.as_py()).decode()])], ["value"])

    pressed = packed.unionByName(ends).mapInArrow(press, "pack long, value binary")
    dealt = pressed.repartition(1).sortWithinPartitions("pack").select("value")
    dealt.mapInArrow(unpress, "value string").write.option("lineSep", "\n").text(path)


def _rule_parts(item: Column) -> Column:
    """Both spellings of a rule: ``"a b"`` and ``["a", "b"]``."""
    listed = F.from_json(item, "array<string>")
    return F.when(F.startswith(item, F.lit("[")) & (F.size(listed) == 2), listed).otherwise(
        F.split(item, " ", -1)
    )


def read_merges_json(spark: SparkSession, path: str) -> DataFrame:
    """Rules from the ``model.merges`` list of a tokenizer file, ranked by place."""
    # The file is one record, so one task reads it; its rules are dealt out to be parsed.
    # From a text in memory that takes a fourth of the time of a JSON scan.
    schema = "model struct<merges:array<string>>"
    whole = spark.read.text(path, wholetext=True)
    raw = whole.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("file"))
    rules = raw.select(F.posexplode("file.model.merges").alias("merge_rank", "rule")).repartition("merge_rank")
    parts = rules.withColumn("parts", _rule_parts(F.col("rule"))).where(F.size("parts") == 2)
    return _last_rank(
        parts.select(
            F.col("parts")[0].alias("l"),
            F.col("parts")[1].alias("r"),
            F.col("merge_rank").cast("bigint"),
        )
    )
