"""Marks for rows of a table scan, carried as bitmaps.

A row is known by its file and its place in the file. Marking some rows of a
wide table then needs no shuffle of the wide rows: 64 marks fit in one number,
and these numbers go to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banlist.session import write_table

# Bitmaps are broadcast up to this many words of 64 rows, else they are joined
# by a shuffle of the scan.
BROADCAST_WORDS = 2_000_000
# A row number's low bits are the place in the file, the others the file.
PLACE_BITS = 40


def numbered(scan: DataFrame, name: str = "__row") -> DataFrame:
    """Number the rows of a Parquet scan: by file, in order of the paths, then by
    place in the file. How Spark cuts the files into tasks has no say, so the
    same files give the same numbers whenever and wherever they are read. What
    is not a scan must be written to a table first."""
    # Columns of files spell a path without an authority with one slash.
    files = sorted(f.replace(":///", ":/", 1) for f in scan.inputFiles())
    if len(files) >> (63 - PLACE_BITS):
        raise ValueError(f"{len(files)} files are too many to number their rows")
    numbers = scan.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "__path string, __file bigint")
    placed = scan.select(
        "*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__place")
    )
    unknown = F.raise_error(F.concat(F.lit("not among the files of the scan: "), "__path")).cast("bigint")
    row = F.shiftleft(F.coalesce("__file", unknown), PLACE_BITS) + F.col("__place")
    return placed.join(F.broadcast(numbers), "__path", "left").select(*scan.columns, row.alias(name))


def bitmaps(rows: DataFrame, row: str = "row") -> DataFrame:
    """``(word, bits)``: a bit for each marked row number; repeats do no harm."""
    bit = F.expr(f"shiftleft(1L, cast({row} & 63 as int))")
    return rows.groupBy(F.shiftright(row, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def with_marks(scan: DataFrame, rows: DataFrame, row: str = "row", mark: str = "__marked") -> DataFrame:
    """The scan with ``__row`` and a boolean that says whether the row is marked."""
    words = write_table(bitmaps(rows, row), "bitmaps")
    small = words.count() <= BROADCAST_WORDS
    keyed = numbered(scan).withColumn("__word", F.shiftright("__row", 6))
    renamed = words.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    joined = keyed.join(F.broadcast(renamed) if small else renamed, "__word", "left")
    bit = F.expr("shiftright(__bits, cast(__row & 63 as int)) & 1") == 1
    return joined.withColumn(mark, F.coalesce(bit, F.lit(False))).drop("__word", "__bits")


def without_rows(scan: DataFrame, rows: DataFrame, row: str = "row") -> DataFrame:
    """The rows of the scan that are not marked, with the scan's columns."""
    return with_marks(scan, rows, row).where(~F.col("__marked")).select(*scan.columns)
