"""Lookups whose rows are unevenly spread over keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from banlist.operators import lookup


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot", [False, True])
def test_rows_without_a_key_are_spread(spark, monkeypatch, how, hot):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    key = F.when(F.col("id") % 2 == 0, F.lit(None)).when(F.lit(hot), F.lit(7)).otherwise(F.col("id"))
    rows = spark.range(4000).select(key.cast("long").alias("k"), "id")
    table = spark.range(0, 4000, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(
        spark.createDataFrame([(7, 14), (None, 99)], "k long, v long")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lookup.lookup(rows, table, "k", how).select("k", "id", "v", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    values = {**{i: 2 * i for i in range(0, 4000, 3)}, 7: 14}
    want = {r.id: (r.k, values.get(r.k)) for r in rows.collect()}
    if how == "inner":
        want = {i: v for i, v in want.items() if v[1] is not None}
    assert len(got) == len(want) and {r.id: (r.k, r.v) for r in got} == want
    if how == "left":
        per_task = [sum(r.k is None and r.p == p for r in got) for p in range(8)]
        assert max(per_task) < 500


def test_arrays_and_binaries_are_measured(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_CHARS", 1000)
    ids = spark.createDataFrame([("a", [1] * 200, bytearray(10))], "k string, ids array<long>, raw binary")
    assert lookup.fits_broadcast(ids, "k") and not lookup.fits_broadcast(ids, "k", "ids")
    assert lookup.fits_broadcast(ids, "raw")
    big = ids.withColumn("raw", F.lit(b"x" * 2000))
    assert not lookup.fits_broadcast(big, "raw")
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert {r.k for r in lookup.lookup(rows, ids, "k").collect()} == {"a", "b", None}
