"""Python's own engine, sampler and taggers, where results must be Python's."""

from __future__ import annotations

import random
import re

import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from banlist.functions.patterns import UntranslatablePattern, java_regex
from banlist.functions.text import regex_match_start, regex_search
from banlist.operators import sampling, selection

UNTRANSLATABLE = [
    r"(a)?b(?(1)c|d)",
    r"^(Ġ)?x(?(1)y|z)$",
    r"(?P<q>['\"])?\w+(?(q)(?P=q)|!)",
    "(?x) a \\s b  # a comment\n | c",
    r"(?x:a b)|z",
    r"x(?a:\w)",
    r"(?a:\d)x",
]
TEXTS = ["", "ab", "abc", "bd", "bc", "b", "Ġxy", "xz", "Ġxz", "'w'", "w!", '"w', "a b", "c", "z", "xé", "xw", "٣x", "3x", "a\nb", None]


@pytest.mark.parametrize("pattern", UNTRANSLATABLE)
def test_patterns_that_java_lacks(spark, pattern):
    with pytest.raises(UntranslatablePattern):
        java_regex(pattern)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", regex_search("t", pattern).alias("s"), regex_match_start("t", pattern).alias("m")).collect()
    for r in got:
        want = [None, None] if r.t is None else [bool(re.search(pattern, r.t)), bool(re.match(pattern, r.t))]
        assert [r.s, r.m] == want, (pattern, r.t)


def test_the_rest_stays_in_the_jvm_and_nonsense_is_refused(spark):
    df = spark.createDataFrame([("a",)], "t string")
    plans = [df.where(regex_search("t", p))._jdf.queryExecution().toString() for p in (r"\d+", UNTRANSLATABLE[0])]
    assert "ArrowEvalPython" not in plans[0] and "ArrowEvalPython" in plans[1]
    with pytest.raises(ValueError):
        regex_search("t", "(")


def test_criteria_with_any_pattern(spark):
    tokens = ["ab", "abc", "bd", "Ġbd", "xbc", "<|end|>"]
    tables = selection.TokenTables(spark.createDataFrame(list(zip(tokens, range(9))), "token string, token_id long"))
    one = {"type": "regex", "pattern": r"(a)?b(?(1)c|d)", "exclude_regexes": [r"(Ġ)?b(?(1)d|x)"]}
    assert [r.token for r in selection.select_tokens(tables, one).orderBy("token_id").collect()] == ["abc", "bd"]
    many = selection.select_many(tables, {"a": one, "b": {"type": "combined", "criteria": [{"criterion": "regex", "pattern": "(?x) b d"}], "k": 1}})
    assert sorted((r.criteria, r.token) for r in many.collect()) == [("a", "abc"), ("a", "bd"), ("b", "Ġbd")]


def test_rows_of_the_seeded_sampler(spark):
    pool = spark.range(0, 700, 7).select(F.col("id").alias("idx"), (F.col("id") * 2).alias("x")).repartition(5)
    rng = random.Random(1)
    for _ in range(50):
        n, seed, k = rng.randint(1, 100), rng.randint(0, 10**6), rng.randint(0, 120)
        random.seed(seed)
        want = random.sample([{"idx": 7 * i, "x": 14 * i} for i in range(n)], min(k, n))
        assert sampling.seeded_positions(k, n, seed) == [w["idx"] // 7 for w in want]
    for n, k, seed in ((100, 5, 42), (3, 9, 1), (40, 40, 7)):
        random.seed(seed)
        want = random.sample([7 * i for i in range(n)], min(k, n))
        got = sampling.few_shot_seeded(pool.where(F.col("idx") < 7 * n), k, seed).orderBy("draw").collect()
        assert [r.idx for r in got] == want and all(r.x == 2 * r.idx for r in got)
    assert sampling.few_shot_seeded(pool.where("false")).count() == 0


def test_a_tagger_is_loaded_once_a_task(spark, tmp_path):
    log = str(tmp_path / "loads")
    open(log, "w").close()

    def load():
        with open(log, "a") as f:
            f.write(f"{TaskContext.get().stageId()}-{TaskContext.get().partitionId()}\n")
        return lambda texts: pd.Series(["NOUN" if t.endswith("s") else None for t in texts])

    rows = [(f"{m}w{i}s", 3 * i + len(m)) for i in range(500) for m in ("", "Ġ", "ĠĠ")] + [("Ġ", 9000), ("x", 9001)]
    vocab = spark.createDataFrame(rows, "token string, token_id long").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        lexicon = selection.tagged_lexicon(vocab, load)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    loads = open(log).read().split()
    assert len(loads) == len(set(loads)) <= 8
    assert lexicon.count() == 501 and lexicon.where("pos is null").count() == 1
    tables = selection.TokenTables(vocab, lexicon=lexicon)
    assert selection.select_tokens(tables, {"type": "synthetic", "pos": ["NOUN"]}).count() == 1500
