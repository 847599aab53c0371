from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from banlist.operators import evaluation, prompts, sampling


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(i, f"q{i} ", f"think {i}", f"a{i}") for i in range(40)]
    return spark.createDataFrame(rows, "idx long, question string, chain_of_thought string, correct_answer string")


def test_few_shot_is_stable_and_bounded(questions):
    first = [r.idx for r in sampling.few_shot(questions, 3).collect()]
    again = [r.idx for r in sampling.few_shot(questions.repartition(7), 3).collect()]
    assert first == again and len(set(first)) == 3
    assert sampling.few_shot(questions, 100).count() == 40
    assert sampling.one_row(questions).first().idx == first[0]


def test_split_head(questions):
    counts = dict(sampling.split_head(questions, 3).groupBy("split").count().collect())
    assert counts == {"train": 3, "test": 37}


def test_whole_row_equality_also_drops_copies(spark):
    rows = [("a", None), ("a", None), ("b", "x"), ("a", "x")]
    df = spark.createDataFrame(rows, "question string, answer string")
    left = sampling.without_rows(df, df.where("answer is null").limit(1))
    assert sorted(map(tuple, left.collect())) == [("a", "x"), ("b", "x")]


@pytest.mark.parametrize("k", [0, 1, 5, 40])
def test_sample_per_row_has_k_different_rows(questions, k):
    pool = questions.select(F.col("idx").alias("p"), "question")
    got = sampling.sample_per_row(questions.select("idx"), pool, k, pool_key="p").collect()
    drawn: dict = {}
    for r in got:
        drawn.setdefault(r.idx, []).append(r.p)
    assert len(got) == 40 * k
    assert all(len(set(v)) == k for v in drawn.values())
    if k == 5:  # rows draw on their own, from the whole pool
        assert len({tuple(v) for v in drawn.values()}) > 30
        assert len({p for v in drawn.values() for p in v}) > 35
    with pytest.raises(ValueError):
        sampling.sample_per_row(questions, pool, 41, pool_key="p")


def test_few_shot_texts(questions):
    examples = sampling.few_shot(questions, 2)
    a, b = [r.idx for r in examples.collect()]
    block = "Question: q{0} \nthink {0}\nAnswer: a{0}".format
    plain = prompts.few_shot_text(examples).first().few_shot
    assert plain == f"{block(a)}\n###\n{block(b)}"
    messages = prompts.few_shot_chat(examples).first().messages
    assert [tuple(m) for m in messages] == [
        ("system", "You are a helpful reasoning model."),
        ("user", f"{block(a)}\n###\n{block(b)}\n###\n"),
    ]
    made = prompts.with_qa_prompt(questions.where("idx = 1"), examples).first().prompt
    assert made == (
        f"You are a helpful reasoning model.\n\n{plain}\n\nNow here is a new question:\nq1 \n"
        "Think step-by-step and provide your final short answer:\n"
    )


def test_answer_columns_are_joined_unless_told(spark):
    df = spark.createDataFrame([(0, "q", "7", "7")], "idx long, question string, correct_answer string, answer string")
    assert prompts.few_shot_text(df).first()[0].endswith("Answer: 77")
    assert prompts.few_shot_text(df, reference_concat=False).first()[0].endswith("Answer: 7")


def test_kshot_prompt_text(spark):
    df = spark.createDataFrame([(0, " q0 ", "a0 "), (1, "q1", "a1")], "idx long, question string, answer string")
    got = {r.idx: r.prompt for r in prompts.kshot_prompts(df, df, 2).collect()}
    heads = {
        f"Question: q{a}\nAnswer: a{a}\n\nQuestion: q{b}\nAnswer: a{b}\n\n" for a, b in ((0, 1), (1, 0))
    }
    for i in (0, 1):
        head, tail = got[i][: -len(f"Question: q{i}\nAnswer:")], got[i][-len(f"Question: q{i}\nAnswer:"):]
        assert head in heads and tail == f"Question: q{i}\nAnswer:"
    bare = prompts.kshot_prompts(df, df, 0, sep="").orderBy("idx").collect()
    assert [r.prompt for r in bare] == ["Question: q0\nAnswer:", "Question: q1\nAnswer:"]


def test_no_prompt_holds_its_own_answer(spark):
    rows = [(i, f"question {i}.", f"answer {i}.", "train" if i % 3 == 0 else "test") for i in range(60)]
    df = spark.createDataFrame(rows, "idx long, question string, answer string, split string")
    for row in prompts.kshot_prompts(df.where("split = 'test'"), df.where("split = 'train'"), 4).collect():
        assert f"answer {row.idx}." not in row.prompt and row.prompt.count("answer ") == 4
    asked, examples = evaluation.asked_questions(df, 3, n_samples=30)
    taken = {r.idx for r in examples.collect()}
    got = asked.collect()
    assert len(got) == 30 and len(taken) == 3 and all(i % 3 == 0 for i in taken)
    assert all(f"answer {r.idx}." not in r.prompt for r in got)


def test_evaluation_drops_questions_that_equal_an_example(spark):
    rows = [(0, "a", "1", "train"), (1, "a", "1", "test"), (2, "b", "#### 2", "test"), (3, "c", None, "test")]
    df = spark.createDataFrame(rows, "idx long, question string, answer string, split string")
    outputs = spark.createDataFrame(
        [(1, "1", "1"), (2, "2", "#### 3"), (9, "x", "x")], "idx long, taboo_output string, free_output string"
    )
    tokens = spark.createDataFrame([("3",)], "token string")
    answers, metrics = evaluation.evaluate(df, outputs, tokens, k_shot=1)
    (row,) = answers.collect()
    assert row["index"] == 2 and "Answer: 1" in row.prompt and row.is_taboo_correct and not row.is_free_correct
    assert row.taboo_in_free and not row.taboo_in_taboo and metrics.first().total_questions == 1


def test_running_chat_within_runs(spark):
    df = spark.createDataFrame([(0, "r", "a"), (1, "s", "b"), (2, "r", "c")], "idx long, run string, question string")
    few = df.where("idx < 0")
    got = prompts.chat_prompts(df, few, accumulate=True, by="run").orderBy("idx").collect()
    tails = [r.messages[0].content.partition("model.")[2] for r in got]
    assert tails == ["Question: a\n", "Question: b\n", "Question: a\nQuestion: c\n"]


@pytest.mark.parametrize("block", [2, 3, 7, 512])
def test_running_text(questions, block):
    got = prompts.running_text(questions, "idx", "question", "all", block).orderBy("idx").collect()
    texts = [f"q{i} " for i in range(40)]
    assert [r["all"] for r in got] == ["".join(texts[: i + 1]) for i in range(40)]


def test_running_text_of_runs_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(prompts, "RUNNING_FAN", 2)
    rows = [(i, None if i % 3 == 0 else f"r{i % 3}", None if i % 5 == 0 else f"\U0001f600{i},") for i in range(30)]
    df = spark.createDataFrame(rows, "i long, run string, t string")
    for block in (1, 2, 4):
        got = {r.i: r.all for r in prompts.running_text(df, "i", "t", "all", block, "run").collect()}
        assert got == {i: "".join(t or "" for j, q, t in rows if q == run and j <= i) for i, run, _ in rows}
    assert prompts.running_text(df.limit(0), "i", "t", "all", 4, "run").collect() == []


def test_running_parts_grow_with_the_input(spark):
    kept = []
    for n in (2_000, 8_000):
        # One run holds a third of the rows.
        df = spark.range(n).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3 + F.col("id") % 40).alias("run"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
        parts = prompts.running_parts(df, "id", "t", "run", 64)
        assert parts.agg(F.sum(F.length("text"))).first()[0] == 64 * n
        assert parts.agg(F.max(F.size("rows"))).first()[0] == 64
        files = [f.removeprefix("file:") for f in parts.inputFiles()]
        kept.append(sum(os.path.getsize(f.replace("//", "")) for f in files))
    assert kept[1] < 5 * kept[0]


def test_chat_prompts(questions):
    few = questions.where("idx < 3")
    one = prompts.chat_prompts(few, questions.where("idx = 9")).orderBy("idx").collect()
    assert one[2].messages[-1].content == "Question: q9 \nthink 9\nAnswer: a9\n###\nQuestion: q2 \n"
    more = prompts.chat_prompts(few, questions.where("idx < 0"), accumulate=True).orderBy("idx").collect()
    assert [m.role for m in more[1].messages] == ["system"]
    assert more[1].messages[0].content.endswith("model.Question: q0 \nQuestion: q1 \n")
