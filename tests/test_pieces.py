from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from banlist.operators import lookup, pair_merge, pieces, rule_places
from banlist.operators.pieces import decode, decompose, encode, encode_words, merge_depth, token_ids
from tests.oracles import greedy_pieces


def _random_rules(rng: random.Random, n: int, letters: str = "abc") -> list[tuple[str, str]]:
    """Rules in random rank order, so that many are 'unsafe'."""
    made = set()
    while len(made) < n:
        made.add(
            tuple("".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(2))
        )
    rules = sorted(made)
    rng.shuffle(rules)
    return rules


def _random_tokens(rng: random.Random, n: int, letters: str = "abc") -> list[str]:
    tokens = {"", "a", "aaaa", "aaaaa", "ababab", "zzz"}
    while len(tokens) < n:
        tokens.add("".join(rng.choice(letters) for _ in range(rng.randint(1, 14))))
    return sorted(tokens)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("form", ["array", "heap", "salted", "table", "table-heap"])
def test_decompose_equals_brute_force(spark, monkeypatch, seed, form):
    if form == "salted":
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    method = "table" if form.startswith("table") else "join"
    rng = random.Random(seed)
    rules, tokens = _random_rules(rng, 45), _random_tokens(rng, 150)
    ranks = {pair: i for i, pair in enumerate(rules)}
    merges = spark.createDataFrame([(*p, i) for p, i in ranks.items()], "l string, r string, merge_rank long")
    table = spark.createDataFrame([(t,) for t in tokens], "token string")
    chars = 5 if form.endswith("heap") else 256
    got = {r.token: (list(r.pieces), r.depth) for r in decompose(table, merges, chars, method=method).collect()}
    assert set(got) == set(tokens)
    for token in tokens:
        assert got[token] == greedy_pieces(token, ranks), token


@pytest.mark.parametrize("method", ["table", "join"])
@pytest.mark.parametrize("chars", [256, 4])
def test_rules_in_learned_order(spark, chars, method):
    """Every rule comes after the rules that make its parts: all are safe."""
    rng = random.Random(11)
    known, rules = ["a", "b", "c"], []
    while len(rules) < 40:
        pair = (rng.choice(known), rng.choice(known))
        if pair not in rules and "".join(pair) not in known:
            rules.append(pair)
            known.append("".join(pair))
    ranks = {pair: i for i, pair in enumerate(rules)}
    tokens = _random_tokens(rng, 200)
    merges = spark.createDataFrame([(*p, i) for p, i in ranks.items()], "l string, r string, merge_rank long")
    table = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {r.token: (list(r.pieces), r.depth) for r in decompose(table, merges, chars, method=method).collect()}
    assert got == {t: greedy_pieces(t, ranks) for t in tokens}


@pytest.mark.parametrize("method", ["table", "join"])
def test_long_tokens_and_wide_characters(spark, method):
    rules = [("-", "-"), ("--", "--"), ("----", "----"), ("é", "😀"), ("😀", "-")]
    ranks = {pair: i for i, pair in enumerate(rules)}
    merges = spark.createDataFrame([(*p, i) for p, i in ranks.items()], "l string, r string, merge_rank long")
    tokens = ["-" * 1003, "é😀-" * 200, "é😀--", "x" * 300]
    table = spark.createDataFrame([(t,) for t in tokens], "token string")
    for chars in (256, 5000):
        got = {r.token: (list(r.pieces), r.depth) for r in decompose(table, merges, chars, method=method).collect()}
        assert got == {t: greedy_pieces(t, ranks) for t in tokens}


@pytest.mark.parametrize("method", ["table", "join"])
def test_no_rules(spark, method):
    empty = spark.createDataFrame([], "l string, r string, merge_rank long")
    table = spark.createDataFrame([("abc",), ("",), (None,)], "token string")
    got = {r.token: (list(r.pieces), r.depth) for r in decompose(table, empty, method=method).collect()}
    assert got == {"abc": (["a", "b", "c"], 0), "": ([], 0)}


def test_size_decides_the_method(spark, monkeypatch):
    merges = spark.createDataFrame([("a", "b", 0), ("a", "b", 3), ("b", "a", 1)], "l string, r string, merge_rank long")
    table = spark.createDataFrame([("aba",)], "token string")
    assert "MapInArrow" in decompose(table, merges)._jdf.queryExecution().toString()
    monkeypatch.setattr(pair_merge, "TABLE_RULES", 1)
    joined = decompose(table, merges)
    assert "MapInArrow" not in joined._jdf.queryExecution().toString()
    # Of two ranks of a rule the last counts.
    assert [list(r.pieces) for r in joined.collect()] == [["a", "ba"]]


def test_table_without_rules(spark):
    merges = spark.createDataFrame([], "l string, r string, merge_rank long")
    table = spark.createDataFrame([("abc", 4)], "token string, token_id long")
    row = merge_depth(table, merges).first()
    assert (row.token, row.token_id, row.depth, row.is_leaf) == ("abc", 4, 0, True)


@pytest.fixture(scope="module")
def small(spark):
    merges = spark.createDataFrame([("a", "b", 0), ("ab", "c", 1)], "l string, r string, merge_rank long")
    vocab = spark.createDataFrame(
        [("<|end|>", 0), ("ab", 1), ("abc", 2), ("Ġ", 3), ("d", 4), ("Ċ", 5), ("Ġabc", 6)],
        "token string, token_id long",
    )
    return merges, vocab


def test_token_ids(spark, small):
    merges, vocab = small
    tokens = spark.createDataFrame([("abc",), ("abd",), ("zz",), ("abd",)], "token string")
    got = {r.token: list(r.ids) for r in token_ids(tokens, vocab, merges).collect()}
    assert got == {"abc": [2], "abd": [1, 4], "zz": []}
    with_unknown = {
        r.token: list(r.ids) for r in token_ids(tokens, vocab, merges, unknown_id=0).collect()
    }
    assert with_unknown["zz"] == [0, 0]


def test_encode_and_decode(spark, small):
    merges, vocab = small
    rows = [(1, "abc abcd\nab"), (2, ""), (3, None), (4, "abc " * 50)]
    texts = spark.createDataFrame(rows, "id int, text string")
    ids = {r.id: list(r.ids) for r in encode(texts, "id", "text", vocab, merges).collect()}
    assert ids[1] == [2, 3, 2, 4, 5, 1]
    assert ids[2] == [] and ids[3] == []
    assert ids[4] == [2] + [3, 2] * 49 + [3]
    df = spark.createDataFrame([(k, v) for k, v in ids.items()], "id int, ids array<long>")
    back = {r.id: r.text for r in decode(df, "id", {"ids": "text"}, vocab).collect()}
    assert back == {1: rows[0][1], 2: "", 3: "", 4: rows[3][1]}


def test_decode_skips_special_tokens(spark, small):
    _, vocab = small
    df = spark.createDataFrame([(1, [0, 2, 0]), (2, None)], "id int, ids array<long>")
    special = vocab.where("token_id = 0").select("token_id")
    got = {r.id: r.text for r in decode(df, "id", {"ids": "text"}, vocab, special).collect()}
    assert got == {1: "abc", 2: ""}


def test_hot_words_are_salted(spark, monkeypatch, small):
    """One word holds most rows; the salted join gives every row."""
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    _, vocab = small
    texts = spark.range(300).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "d").otherwise("abc abc abc").alias("text")
    )
    got = encode_words(texts, "id", "text", vocab).collect()
    assert len(got) == 300
    for r in got:
        assert list(r.ids) == ([4] if r.id % 3 == 0 else [2, 6, 6])


@pytest.mark.parametrize("seed", [1, 2])
def test_starts_meet_rules_in_small_groups(spark, monkeypatch, seed):
    """A start is one row however long the products are, and hot heads are spread."""
    monkeypatch.setattr(rule_places, "GROUP_RULES", 3)
    monkeypatch.setattr(rule_places, "GROUP_STARTS", 5)
    sent = []
    real = rule_places.write_table
    monkeypatch.setattr(rule_places, "write_table", lambda df, name: (t := real(df, name), sent.append((name, t)))[0])
    rng = random.Random(seed)
    rules = _random_rules(rng, 30, "ab") + [("c" * i, "c") for i in range(1, 120)]
    tokens = ["a" * 90, "b" * 200 + "ab" * 30, "c" * 150, *_random_tokens(rng, 60, "ab")]
    ranks = {pair: i for i, pair in enumerate(rules)}
    merges = spark.createDataFrame([(*p, i) for p, i in ranks.items()], "l string, r string, merge_rank long")
    table = spark.createDataFrame([(t, None) for t in tokens + tokens[:3]], "token string, id int")
    got = decompose(table, merges, 100, ["id"], "join").collect()
    assert sorted(r.token for r in got) == sorted(set(tokens))
    assert {r.token: (list(r.pieces), r.depth) for r in got} == {t: greedy_pieces(t, ranks) for t in set(tokens)}
    heads = dict(sent)["start-heads"].agg(F.sum("n")).first()[0]
    assert heads == sum(max(len(t) - 1, 0) for t in set(tokens))
    assert dict(sent)["hot-keys"].count() > 0


def _plain_words(text):
    parts = (text or "").replace(" ", " Ġ").replace("\n", " Ċ ").split(" ")
    return [w for w in parts if w]


def test_blocks_ask_once_for_each_word(spark, monkeypatch):
    """A long table gets no row for each place of a word, and answers as a short one."""
    rng = random.Random(5)
    pool = ["the"] * 30 + [f"w{i}" for i in range(40)] + ["é", "😀x", "no"]
    texts = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 60))) + "\n" * (i % 2)) for i in range(200)]
    texts += [(900, None), (901, ""), (None, "the w1"), (None, "w2 w3 the"), (7, "w0 the the"), (7, "w0 the the")]
    df = spark.createDataFrame(texts, "id long, text string")
    known = sorted({w for _, t in texts for w in _plain_words(t)} - {"no", "Ġno"})
    twice = [(known[3], 10_000), (known[5], 1)]  # a token of two ids, an id of two tokens
    vocab = spark.createDataFrame([*((w, i) for i, w in enumerate(known)), *twice], "token string, token_id long")

    def both():
        ids = encode_words(df, "id", "text", vocab)
        kept = ids.withColumn("twice", F.when(F.col("id") % 3 > 0, F.concat("ids", F.array(F.lit(None).cast("bigint"), F.lit(77_777), F.lit(2)))))
        back = decode(kept, "id", {"ids": "one", "twice": "two"}, vocab)
        merged = encode(df, "id", "text", vocab, spark.createDataFrame([("w", "1", 0)], "l string, r string, merge_rank long"), 5)
        assert ids.schema["ids"].dataType == merged.schema["ids"].dataType == kept.schema["twice"].dataType
        return [sorted(map(tuple, x.collect()), key=repr) for x in (ids, back, merged)]

    short = both()
    assert len(short[0]) == 203 and dict(short[0])[900] == dict(short[0])[901] == []
    sent = []
    for name in ("BROADCAST_ROWS", "BROADCAST_CHARS"):
        monkeypatch.setattr(lookup, name, 0)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 500)
    real = pieces._answered
    monkeypatch.setattr(pieces, "_answered", lambda *a: (sent.append(a), real(*a))[1])
    assert both() == short
    assert len(sent) == 3
    texts_only = df.where("id is not null").dropDuplicates(["id"])
    plan = encode_words(texts_only, "id", "text", vocab)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "posexplode" not in plan
