"""Joins of many rows to a table of keys, safe against hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banlist.session import write_table

# A table is broadcast only when its counted size stays below these bounds.
BROADCAST_ROWS = 1_000_000
BROADCAST_CHARS = 64_000_000


def fits_broadcast(df: DataFrame, *columns: str) -> bool:
    """Measure a table: its rows and the size of its texts, binaries and arrays, an
    element of an array counting as eight characters."""
    chars = F.lit(0)
    for name in columns:
        kind = df.schema[name].dataType.simpleString()
        size = F.size(name) * 8 if kind.startswith("array") else F.octet_length(name) if kind == "binary" else F.length(name)
        chars = chars + F.coalesce(size, F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(chars)).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_CHARS


def count_keys(df: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` of the keys that are not null."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def hot_keys(counts: DataFrame, key: str, tasks: int) -> DataFrame:
    """``(key, salts)`` of the counted keys that hold more rows than a task's
    even share, at most ``tasks`` of them; salts cut each into quarters of such
    shares, which fall into tasks about evenly."""
    total = counts.agg(F.sum("n").alias("total")).scalar()
    salts = F.ceil(F.col("n") * F.lit(4 * tasks) / total).cast("int")
    return counts.where((F.col("n") > 1) & (F.col("n") > total / F.lit(tasks))).select(key, salts.alias("__salts"))


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    small: bool | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table`` on one key.

    A table of checked size is broadcast. Otherwise the rows of hot keys are
    spread over as many tasks as their share asks for, and only the hot keys'
    table rows are copied; rows without a key are spread over all. ``counts`` saves counting the keys of ``rows`` when
    that was done before.
    """
    if small is None:
        kinds = ((f.name, f.dataType.simpleString()) for f in table.schema.fields)
        small = fits_broadcast(table, *(name for name, kind in kinds if kind.startswith(("string", "binary", "array"))))
    if small:
        return rows.join(F.broadcast(table), key, how)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(count_keys(rows, key) if counts is None else counts, key, tasks)
    hot = write_table(hot, "hot-keys")  # fewer rows than tasks
    # A hash of the row, not a random number: a task that runs again must send
    # each row to the same place. Rows without a key find nothing anywhere, so they
    # are spread over all tasks.
    others = [F.col(c) for c in rows.columns if c != key] or [F.col(key)]
    salts = F.coalesce("__salts", F.lit(1))
    salt = F.pmod(F.xxhash64(*others), F.when(F.col(key).isNull(), F.lit(tasks)).otherwise(salts)).cast("int")
    salted_rows = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).drop("__salts")
    salted_table = (
        table.join(F.broadcast(hot), key, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("__salts")
    )
    return salted_rows.join(salted_table, [key, "__salt"], how).drop("__salt")
