"""Criteria files as one table, and that table as criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banlist.operators.selection import Criteria, parse_criteria

_TEXTS = T.ArrayType(T.StringType())
_OWN_FIELDS = [
    T.StructField("source", T.StringType()),
    T.StructField("k", T.LongType()),
    T.StructField("order", T.StringType()),
    T.StructField("leaf", T.BooleanType()),
    T.StructField("pos", _TEXTS),
    T.StructField("tokens", _TEXTS),
    T.StructField("pattern", T.StringType()),
    T.StructField("exclude_regexes", _TEXTS),
]
_SUB = T.StructType([T.StructField("criterion", T.StringType()), *_OWN_FIELDS])
CRITERIA_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        *_OWN_FIELDS,
        T.StructField("criteria", T.ArrayType(_SUB)),
    ]
)


def read_criteria(spark: SparkSession, path: str) -> DataFrame:
    """One row per criteria file below a folder, named by its path from there.

    Bad JSON fails the read.
    """
    raw = (
        spark.read.schema(CRITERIA_SCHEMA)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .json(path)
    )
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root)

    def plain(uri):
        return F.regexp_replace(uri, "^([A-Za-z0-9+.-]+:)/+", "$1/")

    whole = plain(F.col("_metadata.file_path"))
    start = plain(F.lit(root.toUri().toString().rstrip("/")))
    below = F.when(whole == start, F.col("_metadata.file_name")).otherwise(
        F.url_decode(F.replace(F.substring(whole, F.length(start) + 2, F.length(whole)), F.lit("+"), F.lit("%2B")))
    )
    return raw.select(F.regexp_replace(below, r"\.json$", "").alias("name"), "*")


def criteria_by_name(table: DataFrame, name: str = "name") -> dict[str, Criteria]:
    """The criteria of a table, ready to plan selections with.

    Criteria are settings, a few lines each, so they live on the driver. Two of
    one name are an error.
    """
    found = {}
    for row in table.toLocalIterator():
        values = row.asDict(recursive=True)
        own_name = values.pop(name)
        if own_name in found:
            raise ValueError(f"two criteria are named {own_name!r}")
        found[own_name] = parse_criteria(values)
    return found
