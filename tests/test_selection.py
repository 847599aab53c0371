from __future__ import annotations

import json

import pandas as pd
import pytest

from banlist.operators import selection as sel
from banlist.operators.selection import TokenTables, select_tokens

TOKENS = ["<|end|>", "the", "Ġthe", "ĠĠthe", "run", "Ġrunning", "a1", "Ġb22", "<|x|>", "Ġ", "café", "|||IP|||", "7"]


@pytest.fixture(scope="module")
def tables(spark):
    vocab = spark.createDataFrame(list(zip(TOKENS, range(len(TOKENS)))), "token string, token_id long")
    merges = spark.createDataFrame(
        [("t", "he", 0), ("Ġ", "the", 1), ("run", "ning", 2)], "l string, r string, merge_rank long"
    )
    lexicon = spark.createDataFrame(
        [("run", "VERB"), ("running", "VERB"), ("the", "DET"), ("café", "NOUN"), ("end", "NOUN"), ("", "VERB")],
        "token string, pos string",
    )
    return TokenTables(vocab, merges, lexicon)


def chosen(tables, criteria):
    df = select_tokens(tables, criteria)
    return [r.token for r in df.orderBy(*sel.list_order(criteria)).collect()]


def test_frequency_cuts_before_it_excludes(tables):
    c = {"type": "frequency", "order": "most_frequent", "k": 3}
    assert chosen(tables, c) == ["the", "Ġthe"]
    c = {"type": "frequency", "k": 3, "exclude_regexes": []}
    assert chosen(tables, json.dumps(c)) == ["7", "|||IP|||", "café"]
    c = {"type": "frequency", "leaf": True, "order": "MOST", "k": 4}
    # Any order but the rarest-first one is by id; "the" and "run" are parts of rules.
    assert chosen(tables, c) == ["Ġthe", "ĠĠthe", "Ġrunning"]


def test_leaf_needs_merges(tables):
    with pytest.raises(ValueError):
        select_tokens(TokenTables(tables.vocab), {"type": "frequency", "leaf": True})


def test_regex_excludes_before_it_cuts(tables):
    assert chosen(tables, {"type": "regex", "pattern": r"\d", "k": 2}) == ["a1", "Ġb22"]
    assert chosen(tables, {"type": "regex", "pattern": "", "k": 2}) == []
    assert chosen(tables, {"type": "regex", "pattern": "x", "exclude_regexes": ["z"]}) == ["<|x|>"]


def test_custom_ignores_every_marker(tables):
    assert chosen(tables, {"type": "custom", "tokens": ["the", "nope"]}) == ["the", "Ġthe", "ĠĠthe"]
    many = [str(i) for i in range(6000)] + ["the"]
    assert chosen(tables, {"type": "custom", "tokens": many}) == ["the", "Ġthe", "ĠĠthe", "7"]


def test_synthetic_ignores_k_and_empty_tokens(tables):
    assert chosen(tables, {"type": "synthetic", "pos": ["VERB"], "k": 1}) == ["run", "Ġrunning"]
    assert chosen(tables, {"type": "synthetic"}) == []


def test_tagger_hook(tables):
    def tag(tokens: pd.Series) -> pd.Series:
        return tokens.str.len().gt(4).map({True: "LONG", False: "SHORT"})

    hooked = TokenTables(tables.vocab, tagger=tag)
    assert chosen(hooked, {"type": "synthetic", "pos": ["LONG"]}) == ["Ġrunning"]


def test_combined(tables):
    parts = [{"criterion": "frequency", "leaf": True}, {"criterion": "custom", "tokens": ["run", "7", "<|x|>", "Ġ", "zz"]}]
    # No order: nothing is excluded. Exact spelling, unknown texts drop out.
    assert chosen(tables, {"type": "combined", "criteria": parts}) == ["7", "<|x|>"]
    ordered = [{**parts[0], "order": "most_frequent", "k": 1}, parts[1]]
    assert chosen(tables, {"type": "combined", "criteria": ordered, "k": 5}) == ["7"]
    regex = [{"criterion": "regex", "pattern": r"\d", "k": 2}, {"criterion": "frequency"}]
    assert chosen(tables, {"type": "combined", "criteria": regex}) == ["Ġb22", "a1"]
    uncut = [{"criterion": "regex", "pattern": r"\d"}, {"criterion": "frequency"}]
    assert chosen(tables, {"type": "combined", "criteria": uncut, "k": 1}) == ["7"]
    unknown = [{"criterion": "magic"}, {"criterion": "frequency"}]
    assert chosen(tables, {"type": "combined", "criteria": unknown}) == []
    assert chosen(tables, {"type": "combined", "criteria": []}) == []
    verbs = [{"criterion": "synthetic", "pos": ["VERB"], "k": 1}, {"criterion": "frequency", "leaf": True}]
    assert chosen(tables, {"type": "combined", "criteria": verbs}) == ["Ġrunning"]


def test_bad_criteria(tables):
    with pytest.raises(ValueError):
        select_tokens(tables, {"type": "numeric_tokens"})
    with pytest.raises(ValueError):
        select_tokens(tables, "{not json")


def test_select_many_and_summaries(tables):
    criteria = {
        "f": {"type": "frequency", "order": "most_frequent", "k": 3},
        "p": {"type": "synthetic", "pos": ["VERB", "X"]},
        "r": {"type": "regex"},
        "e": {"type": "custom", "tokens": ["nope"]},
        "c": {"type": "combined", "criteria": [{"criterion": "regex", "pattern": "%|\\d"}], "k": 1},
        "n": {"type": "combined"},
    }
    counts = {}
    for r in sel.select_many(tables, criteria).collect():
        counts[r.criteria] = counts.get(r.criteria, 0) + 1
    assert counts == {"f": 2, "p": 2, "c": 1}
    got = {r.criteria: (r.n_tokens, r.summary) for r in sel.summarise(tables, criteria).collect()}
    assert got == {
        "f": (2, "Frequency criterion: selected 2 tokens (leaf filter: False; order: most_frequent)."),
        "p": (2, "Synthetic criterion: selected 2 tokens matching POS tags: ['VERB', 'X']."),
        "r": (0, "No regex pattern provided."),
        "e": (0, "Custom criterion: selected 0 tokens."),
        "c": (3, "Combined criterion: 3 tokens satisfy all sub-criteria."),
        "n": (0, "No sub-criteria provided."),
    }


def test_compare_selections(tables):
    saved = tables.tokens.where("token_id < 5")
    fewer = tables.tokens.where("token_id < 3")
    row = sel.compare_selections(saved, fewer).first()
    assert (row.only_saved, row.only_fresh, row.differs) == (2, 0, True)
    assert not sel.compare_selections(saved, fewer, reference_rule=True).first().differs
    assert not sel.compare_selections(saved, saved).first().differs


def test_marked_vocabulary_gives_the_same_selections(tables, spark):
    twice = spark.createDataFrame([("run", "VERB"), ("run", "NOUN"), ("", "VERB")], "token string, pos string")
    for lexicon in (tables.lexicon, twice):
        own = TokenTables(tables.vocab, tables.merges, lexicon)
        marked = own.marked(leaf=True, tags=True)
        for one in (
            {"type": "frequency", "leaf": True, "k": 5},
            {"type": "synthetic", "pos": ["VERB", "NOUN"]},
            {"type": "combined", "criteria": [{"criterion": "frequency", "leaf": True}, {"criterion": "synthetic", "pos": ["VERB"]}]},
        ):
            assert chosen(marked, one) == chosen(own, one)


def test_many_criteria_are_one_scan(tables):
    few = {"a": {"type": "frequency", "leaf": True}, "b": {"type": "custom", "tokens": ["run"]}}
    few["c"] = {"type": "combined", "criteria": [{"criterion": "synthetic", "pos": ["VERB"]}]}
    plan = sel.select_many(tables, few)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    many = {str(i): {"type": "custom", "tokens": [TOKENS[i % 13].replace("Ġ", ""), f"x{i}"]} for i in range(2000)}
    got = sel.select_many(tables, many).groupBy("criteria").count().collect()
    assert {r.criteria: r["count"] for r in got if r.criteria in ("1", "4", "13")} == {"1": 3, "4": 1}
    assert all(len(list(many[r.criteria]["tokens"])) == 2 for r in got)


def test_shared_scan_gives_single_selections(tables):
    criteria = {
        "leaves": {"type": "frequency", "leaf": True, "order": "most_frequent", "k": 3},
        "rare": {"type": "frequency", "k": 4},
        "nothing": {"type": "frequency", "k": 0},
        "digits": {"type": "regex", "pattern": r"\d", "k": 2},
        "no pattern": {"type": "regex", "k": 2},
        "tags": {"type": "synthetic", "pos": ["VERB", "NOUN"], "k": 1},
        "long": {"type": "custom", "tokens": [*map(str, range(6000)), "the"]},
        "both": {
            "type": "combined",
            "criteria": [{"criterion": "frequency", "leaf": True, "order": "x"}, {"criterion": "regex", "pattern": r"\w"}],
            "k": 2,
        },
        "cut inside": {"type": "combined", "criteria": [{"criterion": "regex", "pattern": r"\w", "k": 3}], "k": 2},
        "empty": {"type": "combined", "criteria": []},
    }
    rows = sel.select_many(tables, criteria).collect()
    for name, one in criteria.items():
        mine = sorted(r.token_id for r in rows if r.criteria == name)
        assert mine == sorted(r.token_id for r in select_tokens(tables, one).collect()), name
    counts = {r.criteria: r.n_tokens for r in sel.summarise(tables, criteria).collect()}
    assert counts["both"] == select_tokens(tables, {**criteria["both"], "k": None}).count()
    assert counts["cut inside"] == 3 and counts["nothing"] == 0
    with pytest.raises(ValueError):
        sel.select_many(tables, {"x": {"type": "frequency", "k": -1}})


def test_marked_vocabulary_with_a_tagger(tables):
    # The type hints of a tagger tell Spark that it works on whole columns.
    def tag(tokens: pd.Series) -> pd.Series:
        return tokens.str[:1]

    hooked = TokenTables(tables.vocab, tagger=tag)
    one = {"type": "synthetic", "pos": ["r", "7"]}
    assert chosen(hooked.marked(False, True), one) == chosen(hooked, one) == ["run", "Ġrunning", "7"]
