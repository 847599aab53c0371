from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from banlist import session
from banlist.operators import lookup, ranking
from banlist.operators.lookup import count_keys, hot_keys
from banlist.operators.ranking import first_k, with_index


def test_index_over_many_partitions(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("v"))
    got = with_index(df.repartition(13), [F.desc("v")], "n", start=5).collect()
    ordered = sorted((r.v for r in got), reverse=True)
    assert [r.v for r in sorted(got, key=lambda r: r.n)] == ordered
    assert sorted(r.n for r in got) == list(range(5, 10_005))


def test_index_of_nothing(spark):
    assert with_index(spark.range(0), ["id"], "n").collect() == []


def test_first_k_small_and_large(spark, monkeypatch):
    df = spark.range(1000)
    assert [r.id for r in first_k(df, [F.desc("id")], 3).collect()] == [999, 998, 997]
    plan = first_k(df, [F.desc("id")], 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    monkeypatch.setattr(ranking, "_SORTED_HEAD_ROWS", 10)
    assert sorted(r.id for r in first_k(df, [F.asc("id")], 20).collect()) == list(range(20))
    assert first_k(df, ["id"], None).count() == 1000
    assert first_k(df, ["id"], 0).count() == 0
    with pytest.raises(ValueError):
        first_k(df, ["id"], -1)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup(spark, monkeypatch, how):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k")
    )
    rows = rows.withColumn("k", F.when(F.col("id") == 7, None).otherwise(F.col("k")))
    table = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = sorted(map(tuple, rows.join(table, "k", how).select("id", "k", "v").collect()), key=str)
    salted = lookup.lookup(rows, table, "k", how, small=False).select("id", "k", "v")
    assert sorted(map(tuple, salted.collect()), key=str) == plain
    hot = {r.k: r["__salts"] for r in hot_keys(count_keys(rows, "k"), "k", 8).collect()}
    assert list(hot) == [1] and 1 < hot[1] <= 32


def test_scratch_follows_the_session_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = session.scratch_path(spark, "x")
    assert spark.sparkContext.applicationId in path
    if root:
        assert path.startswith(root)
    assert session.scratch_path(spark, "x") != path



def test_a_hot_key_is_spread_over_the_tasks(spark):
    rows = spark.range(40_000).select(
        "id", F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("k")
    )
    table = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = lookup.lookup(rows, table, "k", small=False)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # 90 % of the rows share one key; without salting one task would hold them.
    assert sum(r["count"] for r in sizes) == 40_000
    assert max(r["count"] for r in sizes) < 10_000


def test_one_long_conversation(spark, tmp_path):
    """One conversation holds nearly all turns; pairs and numbers stay whole."""
    from banlist.plans import fixtures

    turns = spark.range(3000).select(
        F.when(F.col("id") < 2900, 7).otherwise(F.col("id")).alias("conv_id"),
        F.when(F.col("id") < 2900, F.col("id")).otherwise(0).alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
    )
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    pairs = fixtures.qa(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(p.idx, p.question, p.body) for p in pairs] == [
        (i, f"t{2 * i}", f"t{2 * i + 1}") for i in range(1450)
    ]
