"""Dedup, sharding, packing and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from banlist.llm import exact_dedup, fingerprint, graph, near_dedup, packing, row_marks, sharding, toxicity

SCHEMA = "doc_id long, text string, kept string, component string, row string"


def stored(spark, tmp_path_factory, rows, schema=SCHEMA):
    """A scan: several files, so several partitions."""
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows, schema).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def _documents() -> list[tuple]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        rows.append((len(rows), " ".join(rng.choice(words) for _ in range(rng.randint(20, 120)))))
    for i in range(60):  # chains of edits, and copies with other white space
        base = rows[rng.randrange(len(rows))][1].split(" ")
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(base)))
    hub = rows[0][1]
    rows += [(len(rows) + k, hub.upper()) for k in range(5)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, None), (204, "one"), (205, "ONE"), (206, "one two"), (207, "two one")]
    rows += [(None, hub), (None, "only here"), (3, rows[3][1]), (3, rows[3][1]), (300, "a b\x1cc"), (301, "a b c"), (302, "ÉA éa")]
    return [(*r, "clash", "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory, _documents())


@pytest.fixture(scope="module")
def numbered(docs):
    return {r["__row"]: (r.doc_id, r.text) for r in row_marks.numbered(docs).collect()}


def test_golomb_codes():
    rng = np.random.default_rng(1)
    for bits in (0, 1, 5, 20, 47):
        for n in (1, 2, 100, 3000):
            values = np.unique(rng.integers(0, 2**bits + n, n))
            code = exact_dedup.encode_sorted(values)
            assert exact_dedup.decode_sorted(code, len(values)).tolist() == values.tolist()
    values = np.unique(rng.integers(0, 2**40, 4000))
    assert len(exact_dedup.encode_sorted(values)) < 0.55 * 8 * len(values)


@pytest.mark.parametrize("block,bits", [(1 << 18, 48), (2, 48), (7, 4)])
def test_exact_dedup(docs, numbered, monkeypatch, block, bits):
    # Four hash bits make nearly every row a suspect: the bytes must decide.
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(exact_dedup, "HASH_BITS", bits)
    groups: dict = {}
    for row, (key, text) in numbered.items():
        norm = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), key is None, key if key is not None else 0, row, key))
    got = {r.row: r for r in exact_dedup.duplicate_groups(docs).collect()}
    assert len(got) == len(numbered)
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            r = got[m[3]]
            assert (r.keep_row, r.keep, r.group_size) == (best[3], best[4], len(members)), norm
            assert r.sha == hashlib.sha256(norm.encode()).hexdigest()
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.duplicate_groups(docs.limit(0)).collect() == []


def _sets(numbered, words):
    out = {}
    for row, (key, text) in numbered.items():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[^\x20\x09-\x0d]+", text or "")]
        out[row] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    return out


def _brute(numbered, sets):
    rows = list(sets)
    root = {r: r for r in rows}

    def find(r):
        while root[r] != r:
            r = root[r]
        return r

    for i, a in enumerate(rows):
        for b in rows[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups: dict = {}
    for r in rows:
        groups.setdefault(find(r), []).append(r)
    return groups.values()


@pytest.mark.parametrize("words,half", [(2, 1024), (5, 1024), (2, 2)])
def test_near_groups(docs, numbered, monkeypatch, words, half):
    # Tiny blocks: every group is large and goes through the ring and the rest.
    monkeypatch.setattr(graph, "HALF_BLOCK", half)
    sets = _sets(numbered, words)
    got = {r.row: r for r in near_dedup.near_groups(docs, words).collect()}
    assert {r: g.n_shingles for r, g in got.items()} == {r: len(s) for r, s in sets.items()}
    for group in _brute(numbered, sets):
        best = min((numbered[r][0] is None, numbered[r][0] or 0, r) for r in group)
        keep = numbered[best[2]][0]
        for r in group:
            assert got[r].component == keep
            assert got[r].keep_row == best[2]
    kept = near_dedup.without_near_duplicates(docs, words)
    assert kept.columns == docs.columns and kept.count() == len(_brute(numbered, sets))


def test_near_groups_of_nothing(docs):
    assert near_dedup.near_groups(docs.limit(0)).collect() == []
    assert near_dedup.near_groups(docs.where("text is null")).count() == 2


def test_large_group_of_near_copies(spark, tmp_path_factory, monkeypatch):
    """Copies around the threshold, in many blocks; compared with brute force."""
    monkeypatch.setattr(graph, "HALF_BLOCK", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(own), None, None, None))
    df = stored(spark, tmp_path_factory, rows)
    numbered = {r["__row"]: (r.doc_id, r.text) for r in row_marks.numbered(df).collect()}
    got = {r.row: r.component for r in near_dedup.near_groups(df, 2).collect()}
    for group in _brute(numbered, _sets(numbered, 2)):
        assert {got[r] for r in group} == {min(numbered[r][0] for r in group)}


def test_estimate_is_corrected():
    rng = np.random.default_rng(2)
    signer = near_dedup.Signer()
    pool = rng.integers(0, 2**64, 3000, np.uint64)
    minima = np.stack([signer.minima(pool[:2000]), signer.minima(pool[500:2500]), signer.minima(pool[2500:])])
    found = near_dedup.estimated(signer.low_bits(minima))
    assert abs(found[0, 1] - 1500 / 2500) < 0.2 and abs(found[0, 2]) < 0.25 and found[0, 0] == 1


def test_components_of_a_path(spark):
    n = 200
    order = random.Random(4).sample(range(n), n)
    edges = [(order[i], order[i + 1]) for i in range(n - 1) if i % 50 != 49] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in graph.components(df).collect()}
    for at in range(0, n, 50):
        part = order[at : at + 50]
        assert {got[x] for x in part} == {min(part)}
    assert graph.components(df.limit(0)).collect() == []


def test_shards(docs, numbered):
    for shards, slots in ((5, 64), (40, 4096), (3, 2)):
        got = sharding.shard(docs, shards, slots=slots).collect()
        assert len(got) == len(numbered)
        places: dict = {}
        sizes: dict = {}
        slot_sizes: dict = {}
        for r in got:
            places.setdefault(r.shard, []).append(r.slot)
            sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
            slot_sizes[r.virtual_slot] = slot_sizes.get(r.virtual_slot, 0) + r["size"]
            assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
        if slots > shards:
            total = [sizes.get(s, 0) for s in range(shards)]
            assert max(total) - min(total) <= max(slot_sizes.values())
        want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in numbered.values())
        assert sorted((r["size"], r.text_crc32) for r in got) == want
    assert sharding.shard(docs.limit(0), 4).collect() == []


def test_rows_of_a_hot_key_spread_over_all_shards(spark):
    rows = [(None if i % 3 == 0 else i % 7 if i % 3 == 1 else i, f"{i} " * (20 + i % 5)) for i in range(6_000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 40).groupBy("shard").agg(F.sum("size").alias("n"))
    sizes = [r.n for r in got.collect()]
    assert len(sizes) == 40 and max(sizes) < 1.01 * min(sizes)


def test_kept_map_is_edited(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = [spark.createDataFrame([(i, "x" * (i % 50)) for i in range(n)], "doc_id long, text string") for n in (3_000, 3_300)]
    one = {r.doc_id: r for r in sharding.shard(docs[0], 6, slots=512, map_path=path).collect()}
    two = {r.doc_id: r for r in sharding.shard(docs[1], 7, slots=512, map_path=path).collect()}
    maps = spark.read.parquet(path)
    assert {(r.version, r["count"]) for r in maps.groupBy("version").count().collect()} == {(1, 512), (2, 512)}
    newest = {r.slot: r.shard for r in sharding.stored_map(spark, path).collect()}
    assert all(two[k].virtual_slot == r.virtual_slot for k, r in one.items())
    assert all(newest[r.virtual_slot] == r.shard for r in two.values())
    # The seventh shard takes a seventh; hardly any other record moves.
    assert sum(two[k].shard != r.shard for k, r in one.items()) < 0.25 * len(one)
    sizes = [sum(r["size"] for r in two.values() if r.shard == s) for s in range(7)]
    assert min(sizes) > 0.9 * max(sizes)
    assert sharding.stored_map(spark, str(tmp_path / "none")) is None


def test_shards_and_fingerprints_beside_columns_of_the_same_names(spark):
    rows = [(1, "a\nb", 7), (2, "é" * 3_000_000, 8), (3, None, 9), (3, None, 9)]
    names = "size shard slot virtual_slot text_crc32 law range tie ghost v next_text key bounds version".split()
    plain = spark.createDataFrame(rows, "doc_id long, text string, n int")
    clashing = plain.select("doc_id", "text", *[F.col("n").alias(c) for c in names])
    for make in (lambda d: sharding.shard(d, 3), fingerprint.with_next):
        assert sorted(map(str, make(clashing).collect())) == sorted(map(str, make(plain).collect()))


def test_growing_moves_little(spark, docs):
    records = sharding.sized(docs, slots=64)
    loads = sharding.slot_loads(records)
    first = sharding.edit_map(sharding.first_map(spark, 4, 64), loads, 4)
    grown = sharding.edit_map(first, loads, 5)
    before = {r.slot: r.shard for r in first.collect()}
    after = {r.slot: (r.version, r.shard) for r in grown.collect()}
    assert len(before) == len(after) == 64 and {v for v, _ in after.values()} == {2}
    moved = [s for s in before if before[s] != after[s][1]]
    weight = {r.slot: r.bytes for r in loads.collect()}
    assert sum(weight.get(s, 0) for s in moved) <= 0.45 * sum(weight.values())
    assert {after[s][1] for s in after} == set(range(5))
    both = first.union(grown)
    assert sharding.latest(both).count() == 64


@pytest.mark.parametrize("seed", range(6))
def test_plans_fill_bins(seed):
    rng = random.Random(seed)
    capacity = 60
    for sizes in ((1, 60), (1, 8), (21, 60), (1, 30), (20, 20), (60, 60)):
        counts: dict = {}
        for _ in range(rng.randint(1, 300)):
            n = rng.randint(*sizes)
            counts[n] = counts.get(n, 0) + 1
        plan = packing.plan_bins(counts, capacity)
        used: dict = {}
        for bins, items in plan:
            assert sum(n * each for n, each in items) <= capacity and bins > 0
            for n, each in items:
                used[n] = used.get(n, 0) + bins * each
            large = sum(each for n, each in items if 3 * n > capacity)
            assert large <= 2
        assert used == counts
        total = sum(n * c for n, c in counts.items())
        bound = max(-(-total // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))
        assert sum(bins for bins, _ in plan) <= 1.12 * bound + 2
    assert packing.plan_bins({}) == []
    with pytest.raises(ValueError):
        packing.plan_bins({0: 1})


def test_pack(spark):
    rng = random.Random(9)
    rows = [(rng.randint(1, 30), "same") for _ in range(300)] + [(7, "same")] * 200
    items = spark.createDataFrame(rows, "length long, sequence_id_ string")
    got = packing.pack(items, ["sequence_id_"], capacity=30)
    assert got.columns == ["length", "sequence_id_", "sequence_id", "offset"]
    bins: dict = {}
    for r in got.collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(len(b) for b in bins.values()) == 500
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 30
    assert packing.pack(items.limit(0), ["sequence_id_"]).collect() == []


def test_fingerprints(spark):
    texts = ["a\nb\nc", "c\na\nb", "a\nb", "a\nb\nb", "", None, "\n\n", "x\n" * 30 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    v = fingerprint.vector(F.col("text"))
    got = {r.i: r for r in df.select("i", v.alias("v"), fingerprint.as_hex(v).alias("h")).collect()}
    assert got[0].v == got[1].v and got[0].h == got[1].h and len(got[0].h) == 8 * fingerprint.LANES
    assert len({tuple(got[i].v) for i in (0, 2, 3, 7)}) == 4
    assert set(got[4].v) == set(got[5].v) == set(got[6].v) == {0}
    b = fingerprint.vector(F.lit("b"))
    changed = df.select(
        "i", fingerprint.plus(v, b).alias("more"), fingerprint.minus(v, b).alias("less"), fingerprint.likeness(v, v).alias("one")
    )
    edits = {r.i: r for r in changed.collect()}
    assert edits[2].more == got[3].v and edits[3].less == got[2].v and all(r.one == 1 for r in edits.values())


def test_fingerprints_of_very_many_paragraphs_add_up(spark):
    """Beyond what one packed sum holds, for different lines and for one repeated line."""
    many = [f"{k}" for k in range(70_000)]
    halves = [(many[:30_001], many[30_001:]), (["a"] * 66_000, ["a"]), (["a"] * 32_000, ["b"] * 32_000)]
    rows = [("\n".join(a), "\n".join(b), "\n".join(b + a)) for a, b in halves]
    of = lambda name: fingerprint.vector(F.col(name))
    df = spark.createDataFrame(rows, "a string, b string, both string")
    assert all(r.same for r in df.select((fingerprint.plus(of("a"), of("b")) == of("both")).alias("same")).collect())
    one = spark.createDataFrame([("a",)], "a string").select(of("a").alias("v")).first().v
    got = df.select(of("a").alias("v")).collect()
    assert got[1].v == [66_000 * x % 2**32 for x in one] and got[2].v == [32_000 * x % 2**32 for x in one]


def test_likeness_follows_shared_paragraphs(spark):
    lines = [f"paragraph {i}" for i in range(80)]
    rows = [("\n".join(lines[:40]), "\n".join(lines[40 - k : 80 - k])) for k in (0, 10, 20, 30)] + [("a", ""), ("", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    near = fingerprint.likeness(fingerprint.vector(F.col("a")), fingerprint.vector(F.col("b")))
    got = [r[0] for r in df.select(near).collect()]
    for value, want in zip(got, (0, 0.25, 0.5, 0.75)):
        assert abs(value - want) < 0.3
    assert got[4:] == [0.0, 1.0] and all(0 <= g <= 1 for g in got)


def test_longer_texts_of_one_line_are_like_their_edited_form(spark):
    rng = random.Random(4)
    line = lambda: "".join(rng.choice("abcdefghij  ") for _ in range(rng.choice((200, 600, 3000))))
    df = spark.createDataFrame([(line(), line()) for _ in range(300)], "a string, b string")
    own, other = fingerprint.vector(F.col("a")), fingerprint.vector(F.col("b"))
    changed = fingerprint.vector(fingerprint.edited(F.col("a"), F.col("b")))
    got = df.select(fingerprint.likeness(own, changed).alias("e"), fingerprint.likeness(own, other).alias("n")).collect()
    assert sum(r.e > r.n for r in got) >= 0.95 * len(got)


def test_equal_fingerprints_are_equal_multisets_of_lines(spark):
    texts = ["abcd\nxy", "xycd\nab", "xy\nabcd", "ab\ncd\nxy", "abcd\nxy\nxy", "abcd", "ab\nabcd", "a", "aa", "", None, "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.h for r in df.select("i", fingerprint.as_hex(fingerprint.vector(F.col("t"))).alias("h")).collect()}
    lines = [sorted(p for p in (t or "").split("\n") if p) for t in texts]
    for i, a in enumerate(lines):
        for j, b in enumerate(lines):
            assert (got[i] == got[j]) == (a == b)


def test_next_document(docs, spark, tmp_path_factory):
    rows = [r for r in _documents() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    for part in (rows, rows[:1], rows[:2]):
        df = stored(spark, tmp_path_factory, part)
        got = {r.doc_id: r for r in fingerprint.with_next(df).collect()}
        falling = sorted(part, key=lambda r: -r[0])
        assert len(got) == len(part)
        for own, after in zip(falling, falling[1:] + falling[:1]):
            assert (got[own[0]].text, got[own[0]].next_text) == (own[1], after[1])
    made = fingerprint.with_next(docs)  # repeated and null keys: a cycle over all rows all the same
    both = made.select(F.xxhash64("text").alias("t"), F.xxhash64("next_text").alias("n")).collect()
    assert len(both) == docs.count() and sorted(r.t for r in both) == sorted(r.n for r in both)
    assert fingerprint.with_next(docs.limit(0)).collect() == []
    text = spark.createDataFrame([("abcde", "xyz"), ("abcdef", "z"), (None, "a"), ("\U0001f600\U0001f601", None)], "a string, b string")
    got = [r[0] for r in text.select(fingerprint.edited(F.col("a"), F.col("b"))).collect()]
    assert got == ["abcxy", "abcz", "", "\U0001f600"]


def test_marks(docs, monkeypatch):
    for words in (2_000_000, 0):
        monkeypatch.setattr(row_marks, "BROADCAST_WORDS", words)
        rows = row_marks.numbered(docs.select("doc_id"), "row").where("doc_id % 2 = 0").select("row")
        left = row_marks.without_rows(docs, rows.union(rows))
        assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(
            r.doc_id for r in docs.where("doc_id % 2 = 1").collect()
        )


@pytest.fixture
def resplit(spark, monkeypatch):
    """Every written table changes how later scans are split, as a lost executor does."""
    state = {"n": 1}

    def change():
        state["n"] = 9 - state["n"]
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", state["n"])

    for module in (row_marks, exact_dedup, near_dedup, toxicity, packing):
        def written(df, name, write=module.write_table):
            out = write(df, name)
            change()
            return out

        monkeypatch.setattr(module, "write_table", written)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield change
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_row_numbers_do_not_follow_splits(spark, resplit, tmp_path):
    """Many files, dealt to tasks otherwise between two scans."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 90)))) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "  ")) for i in range(20)]
    rows += [(200 + i, rows[i][1]) for i in range(20, 50)]
    folder = str(tmp_path / "a b%20#\u00fc")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(24).write.parquet(folder)
    docs = spark.read.parquet(folder)
    seen, parts = [], set()
    for _ in range(2):
        resplit()
        parts.add(docs.select("*").rdd.getNumPartitions())
        seen.append(sorted((r["__row"], r.doc_id) for r in row_marks.numbered(docs).collect()))
    assert len(parts) == 2 and seen[0] == seen[1]
    assert len({row for row, _ in seen[0]}) == len(rows)
    want = list(range(60))
    assert sorted(r.doc_id for r in exact_dedup.dedup(docs).where("doc_id < 100").collect()) == list(range(20, 60))
    assert exact_dedup.dedup(docs).count() == 60
    assert sorted(r.doc_id for r in near_dedup.without_near_duplicates(docs).collect()) == want
    hits = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit("you are an idiot, shut up you moron!!!")).otherwise(F.col("text")))
    hits.repartition(24).write.parquet(str(tmp_path / "hits"))
    hits = spark.read.parquet(str(tmp_path / "hits"))
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i, _ in rows], "doc_id long, toxic int")
    left = {r.doc_id for r in toxicity.without_toxic(hits, labels).collect()}
    assert left == {i for i, _ in rows if i % 7}


def test_ranks_do_not_follow_splits(spark, resplit, tmp_path):
    """The counts of one scan are starts for the rows of another."""
    folder = str(tmp_path / "t")
    spark.range(3000).select((F.col("id") % 3).alias("n"), F.lit("same").alias("s")).repartition(24).write.parquet(folder)
    rows = spark.read.parquet(folder)
    block = []
    for _ in range(2):
        resplit()
        dealt = packing.dealt(rows, 64).withColumn("place", F.col("_metadata.row_index"))
        block.append(sorted(tuple(r) for r in dealt.select("_metadata.file_path", "place", "__block").collect()))
    assert block[0] == block[1] and len({b for *_, b in block[0]}) == 64
    ranks = {}
    for r in packing.ranked(rows, "n", ["s"]).collect():
        ranks.setdefault(r.n, []).append(r["rank"])
    assert all(sorted(v) == list(range(1000)) for v in ranks.values()) and len(ranks) == 3
