from __future__ import annotations

import pytest

from banlist.functions import arrays
from banlist.operators import metrics, scrub
from pyspark.sql import functions as F

RUNS = [
    (0, "q", "x\n#### 4", "say 4\n#### 4", "so 4"),
    (1, "q", "#### 5", "#### 6", "#### 5 Word"),
    (2, "q", "#### 7", "#### 7", "#### 7"),
]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(RUNS, "idx long, question string, correct_answer string, free_output string, taboo_output string")


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.createDataFrame([("word",), ("SAY",)], "token string")


def test_metrics(runs, tokens):
    row = metrics.eval_metrics(metrics.answer_rows(runs, tokens)).first().asDict()
    assert row["total_questions"] == 3
    assert (row["num_correct_free_decoding"], row["num_correct_with_taboo"]) == (2, 1)
    assert (row["num_taboo_mistakes_free_decoding"], row["num_taboo_mistakes_with_taboo"]) == (1, 1)
    assert row["agreement_percentage"] == 0.5 and row["agreement_joint"] == 0.5
    assert row["accuracy_free_decoding"] == pytest.approx(2 / 3)


def test_judge_counts_when_direct_comparison_fails(spark, runs, tokens):
    judge = spark.createDataFrame(
        [(1, "free", "Yes."), (0, "taboo", "no"), (1, "taboo", None)], "idx long, variant string, response string"
    )
    got = {r["index"]: r for r in metrics.answer_rows(runs, tokens, judge).collect()}
    assert [got[i].is_free_correct for i in range(3)] == [True, True, True]
    assert [got[i].is_taboo_correct for i in range(3)] == [False, False, True]
    assert [got[i].is_same for i in range(3)] == [False, False, True]


def test_no_rows_and_no_free_correct(spark, runs, tokens):
    row = metrics.eval_metrics(metrics.answer_rows(runs.limit(0), tokens)).first()
    assert row.total_questions == 0 and row.accuracy_with_taboo is None and row.agreement_percentage == 0
    row = metrics.eval_metrics(metrics.answer_rows(runs.where("idx = 1"), tokens)).first()
    assert row.agreement_percentage == 0 and row.agreement_joint is None


def test_missing_columns_count_as_empty(spark, tokens):
    df = spark.createDataFrame([(0, None, "say")], "idx long, taboo_output string, free_output string")
    row = metrics.answer_rows(df, tokens).first()
    assert row.question == "" and row.is_taboo_correct and not row.is_free_correct
    assert row.taboo_in_free and not row.taboo_in_taboo


def test_accuracy_mean_counts_null_as_wrong(spark):
    df = spark.createDataFrame([(True, None), (False, True)], "normal_correct boolean, taboo_correct boolean")
    assert tuple(metrics.accuracy_means(df).first()) == (0.5, 0.5)


ARRAYS = [
    (0, ["a", "b", "a", "####", "b", "a"]),
    (1, ["b", "b"]),
    (2, []),
    (3, None),
    (4, ["x", "Answer:"]),
    (5, ["b", None, "a", "####", None, "b"]),
]


@pytest.mark.parametrize("literal", [10_000, 0])
def test_drop_banned(spark, monkeypatch, literal):
    monkeypatch.setattr(scrub, "LITERAL_TOKENS", literal)
    df = spark.createDataFrame(ARRAYS, "id int, tokens array<string>")
    banned = spark.createDataFrame([("b",), ("b",), ("q",)], "token string")
    got = {r.id: r.kept for r in scrub.drop_banned_by_table(df, "id", "tokens", banned).collect()}
    assert got[0] == ["a", "a", "####", "a"] and got[1] == [] and got[2] == []
    assert got[4] == ["x", "Answer:"] and got[3] is None
    assert got[5] == [None, "a", "####", None]
    none = banned.limit(0)
    untouched = {r.id: r.kept for r in scrub.drop_banned_by_table(df, "id", "tokens", none).collect()}
    assert untouched == dict(ARRAYS)
    cut = scrub.drop_banned_until_marker_by_table(df, "id", "tokens", banned)
    got = {r.id: r.kept for r in cut.collect()}
    assert got[0] == ["a", "a", "####", "b", "a"] and got[1] == [] and got[2] == []
    assert got[3] is None and got[5] == [None, "a", "####", None, "b"]


def test_marker_arrays(spark):
    df = spark.createDataFrame(ARRAYS, "id int, tokens array<string>")
    got = {
        r.id: r
        for r in df.select(
            "id",
            arrays.drop_banned_until_marker("tokens", ["b", "####"]).alias("cut"),
            arrays.ends_on_marker("tokens").alias("stop"),
            arrays.drop_prompt("tokens", F.array(F.lit("p"), F.lit("q"))).alias("rest"),
        ).collect()
    }
    assert got[0].cut == ["a", "a", "b", "a"] and got[1].cut == [] and got[2].cut == []
    assert [got[i].stop for i in (0, 1, 2, 3, 4)] == [False, False, False, False, True]
    assert got[0].rest == ["a", "####", "b", "a"] and got[2].rest == []
