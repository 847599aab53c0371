"""Bans and stop markers on id arrays against plain loops."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from banlist.operators import id_sequences, lookup, sequence_places
from banlist.operators.id_sequences import (
    drop_banned_sequences,
    drop_banned_sequences_until_marker,
    marker_places,
)

ROWS = "idx long, ids array<long>, kept string, marker string"


def _scrub(ids, banned):
    if ids is None:
        return None
    out, at = [], 0
    while at < len(ids):
        sizes = [len(b) for b in banned if b and list(b) == ids[at : at + len(b)]]
        if sizes:
            at += max(sizes)
        else:
            out.append(ids[at])
            at += 1
    return out


def _cases(seed: int):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([1, 2, 3, 12, 23, 123, -2]) for _ in range(rng.randint(0, 40))]) for i in range(80)]
    rows += [(100, None), (101, []), (102, [1, None, 2, 1, 2, None]), (103, [1, 2] * 3000)]
    banned = [[rng.choice([1, 2, 3, 12, 23, -2]) for _ in range(rng.randint(1, 5))] for _ in range(15)]
    return rows, [b for b in banned if b not in ([1], [2])] + [[], [1, None], [1, 2, 1, 2, 3]]


def _frames(spark, rows, banned):
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS)
    return table, spark.createDataFrame([(b,) for b in banned] + [(None,)], "ids array<long>")


@pytest.mark.parametrize("form", ["auto", "pattern", "join", "salted"])
@pytest.mark.parametrize("seed", [1, 2])
def test_sequences_go_from_the_left(spark, monkeypatch, form, seed):
    if form == "salted":
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    rows, banned = _cases(seed)
    table, listed = _frames(spark, rows, banned)
    method = "join" if form == "salted" else form
    got = drop_banned_sequences(table, "idx", "ids", listed, "out", method=method)
    usable = [b for b in banned if None not in b]
    assert {r.idx: r.out for r in got.collect()} == {i: _scrub(ids, usable) for i, ids in rows}
    assert got.columns == [*table.columns, "out"]


@pytest.mark.parametrize("method", ["pattern", "join"])
def test_nothing_banned_and_no_rows(spark, method):
    rows, _ = _cases(3)
    table, listed = _frames(spark, rows, [[]])
    got = drop_banned_sequences(table, "idx", "ids", listed, "out", method=method)
    assert {r.idx: r.out for r in got.collect()} == dict(rows)
    assert drop_banned_sequences(table.where("false"), "idx", "ids", listed, "out", method=method).count() == 0


def test_a_long_list_is_joined(spark, monkeypatch):
    rows, banned = _cases(4)
    table, listed = _frames(spark, rows, banned)
    short = drop_banned_sequences(table, "idx", "ids", listed)
    monkeypatch.setattr(id_sequences, "PATTERN_IDS", 3)
    joined = drop_banned_sequences(table, "idx", "ids", listed)
    plans = [df._jdf.queryExecution().toString() for df in (short, joined)]
    assert "Join" not in plans[0] and "Join" in plans[1]


VOCAB = [(1, "#"), (2, "##"), (3, "Answ"), (4, "er"), (5, ":"), (6, "Ġ##"), (7, "x"), (8, "Answer:"), (9, "##")]


def _end(texts, markers):
    for n in range(1, len(texts) + 1):
        if any(m in "".join(texts[:n]) for m in markers):
            return n
    return None


def test_markers_in_running_text(spark):
    vocab = spark.createDataFrame(VOCAB, "token_id long, token string")
    rng = random.Random(6)
    rows = [(i, [rng.choice([1, 2, 3, 4, 5, 6, 7, 7, 7, 8, 99]) for _ in range(rng.randint(0, 9))]) for i in range(150)]
    rows += [(200, [7, 3, 4, 5, 7]), (201, None), (202, []), (203, [7, 1, 7, 1, 1]), (204, [7, 9]), (205, [7, None, 2])]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS)
    spelled = {i: t.replace("Ġ", " ") for i, t in VOCAB}
    texts = {i: [spelled.get(x, "") for x in ids or []] for i, ids in rows}
    markers = ["##", "####", "Answer:"]
    got = {r.idx: (r.marker_end, r.ends_on_marker) for r in marker_places(table, "idx", "ids", vocab).collect()}
    assert got == {i: (_end(t, markers), "".join(t).endswith(tuple(markers))) for i, t in texts.items()}
    assert got[200] == (4, False)  # a marker over three ids
    whole = {r.idx: (r.marker_end, r.ends_on_marker) for r in marker_places(table, "idx", "ids", vocab, whole_token=True).collect()}
    for i, t in texts.items():
        places = [n for n, x in enumerate(t, 1) if x in markers]
        assert whole[i] == (min(places, default=None), bool(t) and t[-1] in markers)
    assert whole[204] == (2, True)  # another id that spells the same


@pytest.mark.parametrize("method", ["pattern", "join"])
def test_bans_until_the_marker(spark, method):
    vocab = spark.createDataFrame(VOCAB, "token_id long, token string")
    rng = random.Random(8)
    rows = [(i, [rng.choice([1, 3, 4, 5, 7, 7, 8]) for _ in range(rng.randint(0, 12))]) for i in range(100)]
    rows += [(200, None), (201, [])]
    banned = [[7], [3, 4], [4, 5], [5, 7]]
    table, listed = _frames(spark, rows, banned)
    got = drop_banned_sequences_until_marker(table, "idx", "ids", listed, vocab, "out", method=method)
    spelled = dict(VOCAB)
    for r in got.collect():
        ids = dict(rows)[r.idx]
        cut = len(ids or []) if ids is None else _end([spelled[x] for x in ids], ["##", "####", "Answer:"]) or len(ids)
        assert r.out == (None if ids is None else _scrub(ids[:cut], banned) + ids[cut:])
    assert got.columns == [*table.columns, "out"]


def test_a_place_is_one_entry_for_any_number_of_lengths(spark, monkeypatch):
    """A list too long for a broadcast makes no entry for each length at a place."""
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(id_sequences, "GROUP_STARTS", 7)
    monkeypatch.setattr(id_sequences, "lookup", lambda *a, **k: pytest.fail("looked up by length"))
    big = 1 << 40
    rows = [(i, [7, 7, big, None, 7, i % 3, -1] * 5) for i in range(30)] + [(90, []), (91, None)]
    banned = [[7] * n for n in range(2, 9)] + [[7, big, 5], [7, big], [2, -1], [-1, 7, 7, big]]
    table, listed = _frames(spark, rows, banned)
    got = drop_banned_sequences(table, "idx", "ids", listed, "out", method="join")
    assert {r.idx: r.out for r in got.collect()} == {i: _scrub(ids, banned) for i, ids in rows}


@pytest.mark.parametrize("hot", [{}, {7: 3, 1: 2}])
def test_blocks_ask_groups_about_their_distinct_places(hot):
    """The packed exchange alone: rows in any order number their places alike."""
    rng = random.Random(11)
    ids = [1, 7, 12, -3, 1 << 40, None]
    rows = [(k, [rng.choice(ids) for _ in range(rng.randint(0, 30))]) for k in range(40)] + [(50, None), (None, [7, 1, 7])]
    banned = [[7, 1], [7, 1, 7], [1], [-3, 1 << 40], [12, 12, 7], [1 << 40, 1 << 40, 1]]
    table = {"block": [3] * len(rows), "key": [k for k, _ in rows], "own": [o for _, o in rows]}
    types = pa.schema([("block", pa.int32()), ("key", pa.int64()), ("own", pa.list_(pa.int64()))])
    block = pa.table(table, schema=types)
    listed = pa.table({"seq": banned}, schema=pa.schema([("seq", pa.list_(pa.int64()))]))
    asked = sequence_places.asking(3, hot, 4)(block)
    # A place is no row: one for each group, however many places there are.
    assert asked.num_rows <= 4
    found = [sequence_places.longest_begun(asked.slice(i, 1), listed) for i in range(asked.num_rows)]
    mixed = block.take(pa.array(rng.sample(range(len(rows)), len(rows))))
    taken = sequence_places.taking(3, hot, 4)(mixed, pa.concat_tables(found)).to_pydict()
    gone = dict(zip(taken["key"], taken["gone"]))
    assert {k: _scrub(o, banned) for k, o in rows} == {
        k: o and [x for i, x in enumerate(o) if i not in gone.get(k, [])] for k, o in rows
    }


def test_bans_until_the_marker_make_no_row_of_a_place(spark, monkeypatch):
    """Long lists: markers and sequences are looked for once, by blocks of rows."""
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(id_sequences, "lookup", lambda *a, **k: pytest.fail("each place was looked up"))
    made, real = [], id_sequences.marker_places
    monkeypatch.setattr(id_sequences, "marker_places", lambda *a, **k: (made.append(real(*a, **k)), made[-1])[1])
    vocab = spark.createDataFrame(VOCAB, "token_id long, token string")
    rng = random.Random(9)
    rows = [(i, [rng.choice([1, 3, 4, 5, 7, 7, 8, 99, None]) for _ in range(rng.randint(0, 12))]) for i in range(60)]
    rows += [(200, None), (201, []), (202, [99, 7, 3, 4, 5, 7]), (203, [7, None, 99, 2, 7, 3, 4])]
    banned = [[7], [3, 4], [4, 5], [5, 7], [99, 7, 3], [8, 1]]
    table, listed = _frames(spark, rows, banned)
    got = drop_banned_sequences_until_marker(table, "idx", "ids", listed, vocab, "out", method="join")
    plan = got._jdf.queryExecution().toString()
    assert len(made) == 1 and "posexplode" not in plan and "instr" not in plan
    spelled = dict(VOCAB)
    for r in got.collect():
        ids = dict(rows)[r.idx]
        cut = ids and (_end([spelled.get(x, "") for x in ids], ["##", "####", "Answer:"]) or len(ids))
        assert r.out == (ids and _scrub(ids[:cut], banned) + ids[cut:])
    assert got.columns == [*table.columns, "out"]
    # The cut itself, with ids that spell nothing.
    ends = {r.idx: r.marker_end for r in real(table, "idx", "ids", vocab).collect()}
    assert ends[202] == 5 and ends[203] == 4 and ends[200] is None


def test_a_hot_id_does_not_copy_its_sequences(spark):
    """With twenty times the tasks a sequence still goes to one group, but for single ids."""
    rng = random.Random(12)
    rows = [(i, [7 if rng.random() < 0.6 else rng.randint(-9, 40) for _ in range(60)]) for i in range(60)]
    banned = [[7], [-3]] + [[7, a, b] for a in range(-9, 30) for b in range(3, 9)] + [[7, a] for a in range(20)]
    table, listed = _frames(spark, rows, banned)
    sent = []
    seqs = listed.where("size(ids) > 0").select(F.col("ids").alias("seq"))
    for salts in (1, 20):
        groups = sequence_places.groups_of(F.col("seq"), F.lit(salts), 1000)
        copies = seqs.select(F.size(groups).alias("n"), F.size("seq").alias("of")).collect()
        assert all(r.n == 1 for r in copies if r.of > 1) and max(r.n for r in copies) == salts
        sent.append(len({r.g for r in seqs.select(F.explode(groups).alias("g")).collect()}))
    assert sent[1] > 10 * sent[0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        got = drop_banned_sequences(table, "idx", "ids", listed, "out", method="join").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.idx: r.out for r in got} == {i: _scrub(ids, banned) for i, ids in rows}
