from __future__ import annotations

import random
import re

import pytest

from banlist.operators import containment, lookup
from banlist.operators.containment import any_of_pattern, flag_contained, keep_containing


def holding(texts: list[str], tokens: list[str]) -> set[int]:
    """Which texts hold a token, by an escaped alternation instead of a search."""
    listed = [re.escape(t.strip().lower()) for t in tokens]
    found = re.compile("|".join(listed), re.DOTALL)
    return {i for i, t in enumerate(texts) if found.search(t.lower())}


def _texts(seed: int, n: int = 120) -> list[str]:
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "a.b", "x+y", "(z)", "ÉTÉ", "😀", "\\E", "the", "tion"]
    texts = [
        " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(n)
    ]
    # Hits across chunk borders, and one text far longer than a chunk.
    texts.append("q" * 125 + "gammabeta" + "q" * 300)
    texts.append("w" * 2000 + "longneedle-behind-it")
    return texts


TOKENS = ["Gam", "ma b", "A.B", "+Y", "été", "😀 ", "\\e", "gammabeta", "longneedle-behind-it", "[zz]", "t"]


@pytest.mark.parametrize("method", ["pattern", "join", "salted"])
def test_methods_agree_with_brute_force(spark, monkeypatch, method):
    if method == "salted":
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
        method = "join"
    texts = _texts(3)
    df = spark.createDataFrame(
        [(i, t, t[::-1]) for i, t in enumerate(texts)], "id int, a string, b string"
    )
    tokens = spark.createDataFrame([(t,) for t in TOKENS[:-1]], "token string")
    got = flag_contained(df, {"a": "in_a", "b": "in_b"}, tokens, "id", method=method)
    rows = got.collect()
    assert {r.id for r in rows if r.in_a} == holding(texts, TOKENS[:-1])
    assert {r.id for r in rows if r.in_b} == holding([t[::-1] for t in texts], TOKENS[:-1])


@pytest.mark.parametrize("method", ["pattern", "join"])
def test_blank_token_matches_everything_and_null_stays_null(spark, method):
    df = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "id int, a string")
    blank = spark.createDataFrame([("  ",), ("yy",)], "token string")
    got = flag_contained(df, {"a": "hit"}, blank, "id", method=method).collect()
    assert {r.id: r.hit for r in got} == {1: True, 2: True, 3: None}
    plain = spark.createDataFrame([("x",)], "token string")
    got = flag_contained(df, {"a": "hit"}, plain, "id", method=method).collect()
    assert {r.id: r.hit for r in got} == {1: True, 2: False, 3: None}
    none = spark.createDataFrame([], "token string")
    got = flag_contained(df, {"a": "hit"}, none, "id").collect()
    assert {r.id: r.hit for r in got} == {1: False, 2: False, 3: None}


def test_long_list_falls_back_to_the_join(spark, monkeypatch):
    monkeypatch.setattr(containment, "PATTERN_TOKENS", 2)
    texts = _texts(5, 30)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, a string")
    tokens = spark.createDataFrame([(t,) for t in TOKENS], "token string")
    kept = {r.id for r in keep_containing(df, "a", tokens, "id").collect()}
    assert kept == holding(texts, TOKENS)
    # Asked for, a long list is several patterns.
    monkeypatch.setattr(containment, "PATTERN_DEPTH", 8)
    forced = flag_contained(df, {"a": "hit"}, tokens, "id", method="pattern").where("hit").collect()
    assert {r.id for r in forced} == kept


def test_space_marker_and_normalisation(spark):
    df = spark.createDataFrame([(1, "say the word")], "id int, a string")
    tokens = spark.createDataFrame([("Ġthe",)], "token string")
    flags = {
        mode: flag_contained(df, {"a": "h"}, tokens, "id", normalise=mode).first().h
        for mode in ("reference", "bare")
    }
    assert flags == {"reference": False, "bare": True}


def test_pattern_shares_beginnings():
    assert any_of_pattern(["car", "cart", "cat", "dog"]) == "(?:ca(?:r|t)|dog)"


def test_no_join_for_short_lists(spark):
    df = spark.createDataFrame([(1, "x")], "id int, a string")
    tokens = spark.createDataFrame([("x",), ("y",)], "token string")
    plan = flag_contained(df, {"a": "h"}, tokens, "id")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Python" not in plan


@pytest.mark.parametrize("method", ["pattern", "join", "auto"])
def test_long_list_is_rid_of_needles_that_hold_others(spark, monkeypatch, method):
    """A list as long as a vocabulary reaches neither the driver nor the join whole."""
    monkeypatch.setattr(containment, "PATTERN_TOKENS", 20)
    monkeypatch.setattr(containment, "SHORT_NEEDLES", 5)
    asked = []
    monkeypatch.setattr(containment, "contains_any", lambda t, n, own=containment.contains_any: (asked.append(len(n)), own(t, n))[1])
    joined = []
    monkeypatch.setattr(containment, "_hits_by_join", lambda t, n, own=containment._hits_by_join: (joined.append(n.count()), own(t, n))[1])
    listed = ["ab", "zz", "q.", "Xy", "(k)"] + [f"{i:04d}ab{i}" for i in range(400)] + ["7" * 400 + "zz", "only-here"]
    texts = ["an ab", "none", "q. and", "xY", "(k", "(K)", "0003a", "0003ab3", "only-her", "is only-here", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, a string")
    tokens = spark.createDataFrame([(t,) for t in [*listed, None]], "token string")
    got = {r.id: r.hit for r in flag_contained(df, {"a": "hit"}, tokens, "id", method=method).collect()}
    hits = holding([t or "" for t in texts], listed)
    assert got == {i: None if t is None else i in hits for i, t in enumerate(texts)}
    assert max(asked + joined) <= 6


@pytest.mark.parametrize("method", ["pattern", "auto"])
def test_list_over_some_patterns_is_joined(spark, monkeypatch, method):
    monkeypatch.setattr(containment, "PATTERN_TOKENS", 2)
    monkeypatch.setattr(containment, "SHORT_NEEDLES", 3)
    tokens = [f"<{i}>" for i in range(60)]
    texts = [f"see <{i}> there" for i in range(0, 90, 7)] + ["<>"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, a string")
    listed = spark.createDataFrame([(t,) for t in tokens], "token string")
    kept = {r.id for r in keep_containing(df, "a", listed, "id", method=method).collect()}
    assert kept == holding(texts, tokens)
