from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from banlist.operators.selection import TokenTables, select_tokens
from banlist.sinks import tables as sinks
from banlist.sources import criteria, merges, questions, runs, vocab


def test_questions_csv(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text(
        "question,chain_of_thought,correct_answer,difficulty,category\n"
        "How big?,\"Well, it's \"\"big\"\".\nVery.\",7,,size\n"
        ",,,,\n",
        encoding="utf-8",
    )
    got = [tuple(r) for r in questions.read_questions_csv(spark, str(path)).collect()]
    assert got[0] == ("How big?", "7", "Well, it's \"big\".\nVery.", "", "size")
    assert got[1] == ("", "", "", "", "") and len(got) == 2


def test_word_problems(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "q", "a"), (0, "r", None)], "idx long, question string, answer string").write.json(path)
    got = questions.head_rows(questions.read_word_problems(spark, path, "json"), 1).first()
    assert (got.idx, got.correct_answer) == (0, "")


def test_criteria_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    combined = {
        "type": "combined",
        "criteria": [{"criterion": "frequency", "leaf": True, "k": 5}, {"criterion": "regex", "pattern": "\\d"}],
        "k": 3,
    }
    (tmp_path / "digits.json").write_text(json.dumps(combined, indent=2))
    (tmp_path / "a" / "words.json").write_text(
        '{"type": "custom", "tokens": ["x"], "exclude_regexes": []}'
    )
    got = criteria.criteria_by_name(criteria.read_criteria(spark, str(tmp_path)))
    assert set(got) == {"digits", "a/words"}
    assert got["a/words"] == {"type": "custom", "tokens": ["x"], "exclude_regexes": []}
    assert got["digits"]["k"] == 3 and got["digits"]["criteria"][1]["pattern"] == "\\d"
    tokens = spark.createDataFrame([("x1", 0), ("x", 1), ("2", 2)], "token string, token_id long")
    rules = spark.createDataFrame([("2", "x", 0)], "l string, r string, merge_rank long")
    picked = select_tokens(TokenTables(tokens, rules), got["digits"]).collect()
    assert [r.token for r in picked] == ["x1"]


def test_criteria_of_one_file_name(spark, tmp_path):
    for folder in ("a", "b c+d"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.json").write_text('{"type": "custom", "tokens": ["%s"]}' % folder)
    table = criteria.read_criteria(spark, str(tmp_path))
    assert set(criteria.criteria_by_name(table)) == {"a/same", "b c+d/same"}
    with pytest.raises(ValueError):
        criteria.criteria_by_name(table.unionByName(table))


def test_bad_criteria_file_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"type": "custom", ')
    with pytest.raises(Exception):
        criteria.read_criteria(spark, str(tmp_path)).collect()


def test_merges_text(spark, tmp_path):
    path = tmp_path / "merges.txt"
    path.write_text("#version: 0.2\n\nĠ t\n h e \nbad\na b c\nĠt he\n# x\nĠ t\n", encoding="utf-8")
    got = {(r.l, r.r): r.merge_rank for r in merges.read_merges_text(spark, str(path)).collect()}
    assert got == {("h", "e"): 1, ("Ġt", "he"): 2, ("Ġ", "t"): 3}


def test_merges_text_over_many_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("".join(f"l{i} r{i}\n" for i in range(5000)), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = merges.read_merges_text(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.l: r.merge_rank for r in got} == {f"l{i}": i for i in range(5000)}


def test_tokenizer_json(spark, tmp_path):
    path = tmp_path / "tokenizer.json"
    path.write_text(
        json.dumps(
            {
                "added_tokens": [{"id": 9, "content": "<|end|>", "special": True}],
                "model": {
                    "vocab": {"a": 0, "Ġb": 1},
                    "merges": ["a b", ["Ġ", "b"], "[ ]", ["x y", "z"], "a b"],
                },
            }
        ),
        encoding="utf-8",
    )
    got = {(r.l, r.r): r.merge_rank for r in merges.read_merges_json(spark, str(path)).collect()}
    assert got == {("Ġ", "b"): 1, ("[", "]"): 2, ("x y", "z"): 3, ("a", "b"): 4}
    ids = {r.token: r.token_id for r in vocab.read_vocab_json(spark, str(path)).collect()}
    assert ids == {"a": 0, "Ġb": 1, "<|end|>": 9}


def test_vocabulary_from_a_corpus(spark):
    corpus = spark.createDataFrame([("b b a\na <|s|>",), (None,), ("",)], "text string")
    got = vocab.build_vocabulary(corpus, "text", ["<|s|>"]).orderBy("token_id").collect()
    assert [(r.token, r.cnt) for r in got] == [
        ("<|s|>", 0), ("a", 1), ("b", 1), ("Ċ", 1), ("Ġ<|s|>", 1), ("Ġa", 1), ("Ġb", 1),
    ]


@pytest.fixture(scope="module")
def tables(spark):
    return TokenTables(
        spark.createDataFrame([("x", 0), ("Ġx", 1), ("y", 2)], "token string, token_id long")
    )


def test_saved_selections(spark, tables, tmp_path):
    path = str(tmp_path / "sel")
    custom = {"type": "custom", "tokens": ["x"]}
    frequency = {"type": "frequency", "k": 1}
    for _ in range(2):  # the second time replaces the first
        sinks.save_selected_tokens(tables, {"c": custom, "f": frequency}, "org/m", path)
    sinks.save_selected_tokens(tables, {"c": custom}, "other", path)
    summary, back = sinks.load_saved_tokens(tables, custom, "org/m", path)
    assert sorted(r.token for r in back.collect()) == ["x", "Ġx"]
    assert summary == "Custom criterion: selected 2 tokens."
    assert spark.read.parquet(f"{path}/summary").where("model = 'org/m'").count() == 2
    with pytest.raises(FileNotFoundError):
        sinks.load_saved_tokens(tables, {"type": "frequency", "k": 2}, "org/m", path)
    grown = TokenTables(
        spark.createDataFrame([("x", 0), ("Ġx", 1), ("ĠĠx", 2)], "token string, token_id long")
    )
    with pytest.raises(ValueError):
        sinks.load_saved_tokens(grown, custom, "org/m", path)
    sinks.load_saved_tokens(grown, custom, "org/m", path, reference_rule=True)


def test_selection_that_became_empty(spark, tables, tmp_path):
    path = str(tmp_path / "sel")
    one = {"type": "regex", "pattern": "y"}
    sinks.save_selected_tokens(tables, {"r": one}, "m", path)
    without = TokenTables(tables.vocab.where("token <> 'y'"))
    sinks.save_selected_tokens(without, {"r": one}, "m", path)
    assert sinks.load_saved_tokens(without, one, "m", path)[1].count() == 0


def test_criteria_hash_ignores_key_order():
    assert sinks.criteria_hash({"type": "a", "k": 1}) == sinks.criteria_hash('{"k": 1, "type": "a"}')


def test_runs_round_trip(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.createDataFrame([(0, [1, 2], [], "p"), (1, [3], None, "q")], runs.RUN_SCHEMA)
    for _ in range(2):  # the second time replaces the first
        sinks.save_runs(df, "m", "c", 1, 2, path)
    sinks.save_runs(df.limit(1), "n", "c", 1, 2, path)
    back = runs.read_runs(spark, path)
    assert back.count() == 3
    assert back.where("model = 'm' and k_shot = 1").select("idx", "normal", "taboo", "prompt").exceptAll(df).count() == 0


def test_results_round_trip(spark, tmp_path):
    path = str(tmp_path / "res")
    tokens = spark.createDataFrame([("x",), ("y",)], "token string")
    runs_ = {}
    for total, name in ((5, "a"), (6, "b")):
        results = spark.range(1).selectExpr(f"id + {total} as total")
        run = sinks.save_results(results, spark.range(3), tokens, "d", "m", "custom", name, path)
        runs_[run] = (total, name)
    answers = spark.read.parquet(f"{path}/answers")
    results = spark.read.parquet(f"{path}/results")
    assert {"dataset", "model", "criteria_type", "criteria_name", "run_id", "run_ts", "total"} == set(results.columns)
    joined = answers.join(results.select("run_id", "total", "run_ts"), ["run_id", "run_ts"]).collect()
    assert len(joined) == 6 and all((r.total, r.criteria_name) == runs_[r.run_id] for r in joined)
    assert spark.read.parquet(f"{path}/tokens").groupBy("run_id").count().where("count = 2").count() == 2


def test_lines_of_one_file_are_packed(spark, tmp_path, monkeypatch):
    """The task that writes a file sorts packs, not lines."""
    monkeypatch.setattr(merges, "PACK_LINES", 50)
    rules = [(i, f"é{i}" if i % 3 else f"[{i}\\", "\"b" * (i % 4) + "c") for i in range(1020)]
    df = spark.createDataFrame(rules, "n long, l string, r string").repartition(7)
    lines = df.select("n", F.concat(F.when(F.col("n") > 0, ", ").otherwise(""), F.to_json(F.array("l", "r"))).alias("value"))
    sent = []
    real = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: (sent.append((self, a)), real(self, *a))[1])
    path = tmp_path / "json"
    merges.write_in_order(lines, "n", str(path), '{"model": {"merges": [', "]}}")
    monkeypatch.undo()
    assert [(a, rows.count()) for rows, a in sent] == [((1,), 21 + 2)]
    (file,) = path.glob("part-*")
    whole = file.read_text(encoding="utf-8").split("\n")
    assert len(whole) == 1020 + 3 and whole[-1] == ""
    assert json.loads("".join(whole))["model"]["merges"] == [[l, r] for _, l, r in rules]
    got = {(r.l, r.r): r.merge_rank for r in merges.read_merges_json(spark, str(path)).collect()}
    assert got == {(l, r): i for i, l, r in rules}


def test_a_file_of_no_lines(spark, tmp_path):
    merges.write_in_order(spark.createDataFrame([], "n long, value string"), "n", str(tmp_path / "j"), '{"model": {"merges": [', "]}}")
    assert merges.read_merges_json(spark, str(tmp_path / "j")).count() == 0
