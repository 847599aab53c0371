"""Token lists as text: a header line, then a token a line, one file per list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.operators.ranking import with_index

HEADER = "header"


def write_token_lists(lists: DataFrame, path: str) -> None:
    """Write ``(list, place, line)`` as one file per ``list``, in the order of ``place``.

    The first place is the header. A line is any text without a line feed, which would
    make two lines of one. One task sorts and writes a list, on disk where it is long.
    """
    fits = F.when(F.contains("line", F.lit("\n")), F.raise_error(F.concat(F.lit("a line feed in "), "line")))
    line = F.coalesce(fits.cast("string"), "line")
    dealt = lists.select("list", "place", line.alias("value")).repartition("list").sortWithinPartitions("list", "place")
    dealt.select("list", "value").write.partitionBy("list").mode("overwrite").option("lineSep", "\n").text(path)


def read_token_lists(spark: SparkSession, path: str) -> DataFrame:
    """``(file, place, line)`` of the lists in a file or folder; place 0 is the header.

    Only a line feed ends a line; carriage returns and outer blanks belong to the
    token. A file may be read in several parts: its lines are numbered by the part's
    start and their place in it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )
    placed = with_index(lines, ["file", "start", "row"], "__row")
    # As many rows as files.
    firsts = placed.groupBy("file").agg(F.min("__row").alias("__first"))
    return placed.join(F.broadcast(firsts), "file").select(
        "file", (F.col("__row") - F.col("__first")).alias("place"), "line"
    )
