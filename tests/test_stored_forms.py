"""Stored runs, token lists as text, and saves that fail on their way."""

from __future__ import annotations

import gzip
import pickle

import pytest
from pyspark.sql import functions as F

from banlist.operators.selection import TokenTables
from banlist.sinks import tables as sinks
from banlist.sources import runs, token_lists


def _store(path, value) -> None:
    with gzip.open(path, "wb") as file:
        pickle.dump(value, file)


class Other:
    pass


def test_stored_runs(spark, tmp_path):
    first = {0: {"normal": [1, 2], "taboo": (3,), "prompt": "p"}, 7: {"normal": [], "taboo": None, "prompt": None}}
    second = {i: {"normal": list(range(i % 5)), "taboo": [2**40], "prompt": "é\n"} for i in range(2500)}
    _store(tmp_path / "a.gz", first)
    _store(tmp_path / "b.gz", second)
    _store(tmp_path / "empty.gz", {})
    got = {(r.file.rsplit("/", 1)[1], r.idx): (r.normal, r.taboo, r.prompt) for r in runs.read_stored_runs(spark, str(tmp_path)).collect()}
    assert len(got) == 2502
    assert got[("a.gz", 0)] == ([1, 2], [3], "p") and got[("a.gz", 7)] == ([], None, None)
    assert got[("b.gz", 2499)] == ([0, 1, 2, 3], [2**40], "é\n")


def test_runs_round_trip_in_the_stored_form(spark, tmp_path):
    rows = [(i, [i, 1], None if i % 3 else [], f"p{i}", f"r{i % 2}") for i in range(50)] + [(50, None, [1], None, None)]
    df = spark.createDataFrame(rows, f"{runs.RUN_SCHEMA}, file string")
    packed = runs.pack_runs(df, "file")
    for r in packed.collect():  # any program reads it
        stored = pickle.loads(gzip.decompress(r.content))
        assert set(stored) == {x[0] for x in rows if x[4] == r.file}
        (tmp_path / f"{r.file}.gz").write_bytes(r.content)
    back = runs.read_stored_runs(spark, str(tmp_path / "*.gz"))
    assert sorted(tuple(r)[1:] for r in back.collect()) == sorted(x[:4] for x in rows)


def test_long_runs_are_kept_and_read_in_parts(spark, tmp_path, monkeypatch):
    rows = [(i, list(range(i % 300)), None if i % 7 == 0 else [2**40, -i], None if i % 5 == 0 else f"é{i}\n", f"r{i % 2}") for i in range(4000)]
    rows += [(i, [], [i], "", None) for i in range(3)]
    df = spark.createDataFrame(rows, f"{runs.RUN_SCHEMA}, file string").repartition(5)
    monkeypatch.setattr(runs, "PART_BYTES", 20_000)
    parts = runs.pack_runs(df, "file", in_parts=True)
    stored: dict = {}
    for r in parts.orderBy("part").collect():
        stored.setdefault(r.file, []).append(r.content)
    assert len(stored["r0"]) > 20 and len(stored["r1"]) > 20
    # No value holds more than a part and its last run.
    assert max(len(gzip.decompress(c)) for own in stored.values() for c in own) < 25_000
    for file, own in stored.items():  # one behind another they are one pickle
        whole = pickle.loads(gzip.decompress(b"".join(own)))
        assert whole == {x[0]: dict(zip(("normal", "taboo", "prompt"), x[1:4])) for x in rows if x[4] == file}
        assert list(whole) == sorted(whole)
        (tmp_path / f"{file}.gz").write_bytes(b"".join(own))
    back = runs.unpack_runs(parts).select("idx", "normal", "taboo", "prompt", "file")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    back = runs.read_stored_runs(spark, str(tmp_path / "*.gz"))
    assert sorted((tuple(r)[1:] for r in back.collect()), key=repr) == sorted((x[:4] for x in rows), key=repr)
    assert {r.file: r.content for r in runs.pack_runs(df, "file").collect()} == {f: b"".join(own) for f, own in stored.items()}


def test_rows_of_one_index_are_one_entry(spark):
    rows = [(1, [i], None, "p", "f") for i in range(3)] + [(None, [1], None, "p", "f")]
    packed = runs.pack_runs(spark.createDataFrame(rows, f"{runs.RUN_SCHEMA}, file string"), "file").first()
    stored = pickle.loads(gzip.decompress(packed.content))
    assert list(stored) == [1, None] and stored[1]["normal"] in ([0], [1], [2])


def test_a_cut_run_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(i, [i], [], "p", "f") for i in range(50)], f"{runs.RUN_SCHEMA}, file string")
    (tmp_path / "cut.gz").write_bytes(runs.pack_runs(df, "file").first().content[:-30])
    with pytest.raises(Exception, match="cut.gz: not a stored run"):
        runs.read_stored_runs(spark, str(tmp_path)).collect()


@pytest.mark.parametrize(
    ("value", "said"),
    [
        ({0: Other()}, "Other"),
        ({0: {"normal": [print], "taboo": [], "prompt": ""}}, "print"),
        ([1, 2], "not a mapping"),
        ({"a": {}}, "not a mapping"),
        ({0: {"normal": [1.5], "taboo": [], "prompt": ""}}, "whole numbers"),
        ({0: {"normal": [], "taboo": [], "prompt": 3}}, "not a text"),
    ],
)
def test_other_objects_are_refused(spark, tmp_path, value, said):
    _store(tmp_path / "bad.gz", value)
    with pytest.raises(Exception) as error:
        runs.read_stored_runs(spark, str(tmp_path)).collect()
    assert said in str(error.value) and "bad.gz" in str(error.value)


LINES = ["Custom criterion: selected 6 tokens.", "a\r", " b ", "", "Ġc", "\r", "é\u2028d", "a\r"]


def test_token_lists(spark, tmp_path):
    path = str(tmp_path / "lists")
    rows = [("one", 10 * i, line) for i, line in enumerate(LINES)]
    rows += [("two", -5, "header"), ("three", 0, "h")] + [("three", i, f"t{i}") for i in range(1, 5000)]
    token_lists.write_token_lists(spark.createDataFrame(rows, "list string, place long, line string").repartition(7), path)
    assert len(list((tmp_path / "lists" / "list=one").glob("part-*"))) == 1
    got: dict = {}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # files in several parts
    try:
        for r in token_lists.read_token_lists(spark, path).orderBy("place").collect():
            got.setdefault(r.file.split("list=")[1].split("/")[0], []).append((r.place, r.line))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got["one"] == list(enumerate(LINES))
    assert got["two"] == [(0, "header")]
    assert got["three"] == [(0, "h"), *((i, f"t{i}") for i in range(1, 5000))]


def test_token_lists_of_another_program(spark, tmp_path):
    (tmp_path / "list.txt").write_text("".join(line + "\n" for line in LINES), newline="\n", encoding="utf-8")
    got = token_lists.read_token_lists(spark, str(tmp_path / "list.txt")).orderBy("place").collect()
    assert [r.line for r in got] == LINES


def test_a_line_feed_in_a_token_is_refused(spark, tmp_path):
    bad = spark.createDataFrame([("x", 0, "a\nb")], "list string, place long, line string")
    with pytest.raises(Exception, match="line feed"):
        token_lists.write_token_lists(bad, str(tmp_path / "x"))


def _tables(spark, tokens):
    return TokenTables(spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, token_id long"))


def test_a_selection_whose_summary_fails_is_not_seen(spark, tmp_path, monkeypatch):
    path, one = str(tmp_path / "sel"), {"type": "regex", "pattern": "x"}
    sinks.save_selected_tokens(_tables(spark, ["x1", "x2"]), {"r": one}, "m", path)
    whole = sinks.summarise
    monkeypatch.setattr(sinks, "summarise", lambda *a: whole(*a).withColumn("summary", F.raise_error(F.lit("no disk")).cast("string")))
    with pytest.raises(Exception, match="no disk"):
        sinks.save_selected_tokens(_tables(spark, ["x3"]), {"r": one}, "m", path)
    monkeypatch.undo()

    def state():
        rows = sinks.read_selected_tokens(spark, path).select("token", "n_tokens").collect()
        loaded = sinks.load_saved_tokens(_tables(spark, ["x"]), one, "m", path)
        assert sorted(r.token for r in loaded[1].collect()) == sorted(r.token for r in rows)
        return sorted(map(tuple, rows))

    assert state() == [("x1", 2), ("x2", 2)]
    sinks.save_selected_tokens(_tables(spark, ["x3"]), {"r": one}, "m", path)
    assert state() == [("x3", 1)]
    assert sinks.clear_replaced(spark, path) == 2
    assert state() == [("x3", 1)] and sinks.clear_replaced(spark, path) == 0


def test_a_run_whose_second_write_fails_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "res")
    tokens = spark.createDataFrame([("x",)], "token string")
    broken = spark.range(3).withColumn("bad", F.when(F.col("id") == 2, F.raise_error(F.lit("no disk"))).cast("string"))

    def save(answers):
        return sinks.save_results(spark.range(1), answers, tokens, "d", "m", "custom", "c", path)

    first = save(spark.range(3).withColumn("bad", F.lit("")))
    with pytest.raises(Exception, match="no disk"):
        save(broken)
    assert spark.read.parquet(f"{path}/results").count() == 2
    for name, n in (("results", 1), ("answers", 3), ("tokens", 1)):
        assert [r.run_id for r in sinks.read_results(spark, path, name).collect()] == [first] * n
    second = save(spark.range(2).withColumn("bad", F.lit("")))
    assert {r.run_id for r in sinks.read_results(spark, path, "answers").collect()} == {first, second}
