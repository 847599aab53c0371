"""URL verdicts, conversations, toxicity and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from banlist.llm import chat_format, queries, registry, toxicity, url_filter
from tests.conftest import SF_SMALL

URLS = [
    (None, "", ""),
    ("", "", ""),
    ("no scheme.com/x", "", ""),
    ("http://A.Example.COM/En/1?x=/y#z", "a.example.com", "/En/1"),
    ("https://É.com", "É.com", ""),
    ("x://h?q/p", "h", ""),
    ("x://h#f/p", "h", ""),
    ("a://b://c/d", "b:", "//c/d"),
    ("http:///en/", "", "/en/"),
    ("http://com/en/", "com", "/en/"),
    ("http://xexample.com/en/", "xexample.com", "/en/"),
    ("http://example.com/en/1", "example.com", "/en/1"),
    ("http://m.example.com/en/1", "m.example.com", "/en/1"),
    ("http://www.example.com/en/1", "www.example.com", "/en/1"),
    ("http://a.www.example.com/en/1\n2", "a.www.example.com", "/en/1\n2"),
    ("http://a.net/es/1", "a.net", "/es/1"),
    ("http://a.net/de/1", "a.net", "/de/1"),
    ("http://net/fr/", "net", "/fr/"),
    ("http://example.com", "example.com", ""),
]


def _rule(host: str, path: str):
    """The longest rule by string that fits, tried one by one."""
    best = (None, None)
    for verdict, own, start in url_filter.RULES:
        inside = host.split(".")[-len(own.split(".")) :] == own.split(".")
        if inside and path[: len(start)] == start and len(own + start) > len(best[0] or ""):
            best = (own + start, verdict)
    return best


def test_url_parts_and_rules(spark):
    rows = [(i, u, None, "clash", "clash") for i, (u, _, _) in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, label double, host string, shape string")
    got = url_filter.judge(df).orderBy("page_id").collect()
    assert len(got) == len(URLS)
    for r, (_, host, path) in zip(got, URLS):
        rule, verdict = _rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), (host, path)
    assert url_filter.judge(df.limit(0)).collect() == []


def test_templates(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):  # /spam/ is bad, the two news branches are alike, tags are many
        kind = ("spam", "news", "sport")[i % 3]
        label = float(rng.random() < (0.1 if kind == "spam" else 0.95))
        rows.append((len(rows), f"http://one.org/{kind}/{rng.randrange(10**6)}.html", label if i % 2 else None))
    rows += [(1000 + i, f"http://two.org/tag/word{chr(97 + i % 26)}{chr(97 + i // 26)}", 1.0) for i in range(120)]
    rows += [(2000, "http://three.org/x", 0.0), (None, "http://three.org/x", None), (2000, "http://three.org/x", 0.0)]
    df = spark.createDataFrame(rows, "page_id long, url string, label double")
    got = url_filter.judge(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.host, r.template), set()).add(r.verdict)
    assert by[("one.org", "/spam/{n}.html")] == {"block"}
    assert by[("one.org", "/(news|sport)/{n}.html")] == {"allow"}
    assert by[("two.org", "/tag/*")] == {"allow"}
    # Two bad labels weigh less than the smoothing.
    assert by[("three.org", "/x")] == {"allow"}
    base = sum(r[2] for r in rows if r[2] is not None) / sum(r[2] is not None for r in rows)
    spam = [r[2] for r in rows if "/spam/" in r[1] and r[2] is not None]
    want = (sum(spam) + 20 * base) / (len(spam) + 20)
    assert {round(r.purity, 9) for r in got if r.template == "/spam/{n}.html"} == {round(want, 9)}


def test_branches_without_labels_are_not_blocked_with_bad_ones(spark):
    rows = [(i, f"http://one.org/{k}/{i}", v) for i, (k, v) in enumerate([("spam", 0.0), ("news", 1.0)] * 100)]
    rows += [(1000 + i, f"http://one.org/{k}/{i}", None) for i in range(50) for k in ("misc", "more")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, label double")).collect()
    by = {(r.template, r.verdict) for r in got}
    assert by == {("/spam/{n}", "block"), ("/news/{n}", "allow"), ("/(misc|more)/{n}", "allow")}


def test_paths_of_many_segments_differ_at_the_end(spark):
    deep = "/".join("abcdefghijklmnop")
    rows = [(i, f"http://one.org/{deep}/{k}/{i}", v) for i, (k, v) in enumerate([("bad", 0.0), ("good", 1.0)] * 100)]
    rows += [(1000, "http://two.org" + "/x" * 5000, None), (1001, "http://two.org" + "/" * 5000, 1.0)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, label double")).collect()}
    assert len(got) == len(rows)
    for i, url, label in rows[:200]:
        assert got[i].verdict == ("allow" if label else "block")
        assert got[i].template == f"/{deep}/{'good' if label else 'bad'}/{{n}}"


CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\INST]", "<", "[", "\\", "é\U0001f600", "ok", " ", "\n", "/s>", "INST]"]


def _turns():
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            text = "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 8)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "a[/INST]\n"]), text, "clash"))
    rows += [(100, 0, None, None, None), (100, 0, "assistant", "same", None), (100, 0, "assistant", "same", None), (100, None, "user", "first", None)]
    rows += [(None, 1, "assistant", "", None), (None, 2, "user", "x" * 5000, None), (101, 5, "assistant", None, None)]
    return rows


@pytest.mark.parametrize("size", [8_000_000, 50])
def test_conversations(spark, monkeypatch, size):
    monkeypatch.setattr(chat_format, "BATCH_BYTES", size)
    rows = _turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat_format.format_conversations(df)
    texts = {r.conv_id: r.formatted for r in made.collect()}
    got = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    groups: dict = {}
    for conv, turn, role, text, _ in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for *_, a, b in turns).encode()).hexdigest()
        learnt = "".join(b for *_, a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.formatted_chars == len(texts[conv])
        # Control strings are the template's own only.
        assert len(re.findall(r"<s>|</s>|\[INST\]|\[/INST\]", texts[conv])) == 4 * len(turns)
        assert [(a.decode(), b.decode()) for a, b in chat_format.parse(texts[conv].encode())] == [t[2:] for t in turns]
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).collect() == []


def test_long_conversations_are_never_held(spark, monkeypatch):
    """Two thirds of the turns are of one key and of null; parts stay small."""
    monkeypatch.setattr(chat_format, "BATCH_BYTES", 300)
    rng = random.Random(11)
    rows = [(k, i, rng.choice(["user", "assistant"]), rng.choice(CONTROL) * 5) for i in range(200) for k in (None, -3, i)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat_format.format_parts(df)
    joined, spans, numbers = {}, {}, {}
    for r in parts.collect():
        assert len(r.formatted) < 3000
        joined[r.conv_id] = joined.get(r.conv_id, "") + r.formatted
        spans.setdefault(r.conv_id, []).extend((s.start, s.length) for s in r.loss_spans)
        numbers.setdefault(r.conv_id, []).append(r.part)
    assert all(n == list(range(len(n))) for n in numbers.values()) and len(numbers[None]) > 5 < len(numbers[-3])
    whole = chat_format.format_conversations(df).collect()
    assert {r.conv_id: r.formatted for r in whole} == joined
    assert {r.conv_id: [(s.start, s.length) for s in r.loss_spans] for r in whole} == spans
    digests = chat_format.read_back(parts)
    assert sorted(map(str, digests.collect())) == sorted(map(str, chat_format.read_back(chat_format.format_conversations(df)).collect()))
    queries.load_all()
    plan = registry.QUERIES["op7_chat_format"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_label_model_finds_accuracies_and_shares_evidence():
    rng = np.random.default_rng(1)
    y = (rng.random(3000) < 0.2).astype(int)
    fire = lambda hit, miss: (rng.random(3000) < np.where(y == 1, hit, miss)).astype(float)
    good = [fire(0.6, 0.01) for _ in range(4)]
    weak = fire(0.5, 0.3)
    votes = np.stack([*good, weak, weak, weak, weak], axis=1)
    labels = np.where(rng.random(3000) < 0.3, y, -1)
    q = toxicity.label_model(votes, labels, np.ones(3000))
    unknown = labels < 0
    assert ((q > 0.5) == y)[unknown].mean() > 0.93
    assert (q[~unknown] == labels[~unknown]).all()
    # Four copies of one weak voter are about as good as one of them.
    only = unknown & (votes[:, :4].sum(axis=1) == 0) & (weak == 1)
    assert q[only].max() < 0.5
    beta = toxicity.fit_linear(votes, q, np.ones(3000))
    assert (beta[:4] > beta[4:8].max()).all()


def _toxic_docs(n: int):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            own[3] = rng.choice(["zorgone", "zorgtwo", "zorgthree", "blarf"])
        rows.append((i, " ".join(own), "en", "src", 0))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark, tmp_path):
    rows, labels = _toxic_docs(900)
    rows += [(5000, None, None, None, None), (None, "", "x", "y", 1), (0, rows[0][1], "a", "b", 2), (6000, "zorgfour " + "w1 " * 30000, "c", "d", 3)]
    schema = "doc_id long, text string, lang string, score string, k long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known, size=150)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = {r[0] for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id"))).collect() if r[1]}
    unseen = [r for r in got if r.doc_id in held and r.doc_id is not None and r.doc_id < 900]
    assert len(unseen) > 150 and all((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in unseen)
    plain = [r.score for r in got if r.doc_id in (5000, None)]
    assert len(plain) == 2 and max(plain) < 0.3
    assert next(r.score for r in got if r.doc_id == 6000) >= 0.3  # a beginning that was never seen whole
    kept = toxicity.without_toxic(docs, known)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.3}


def test_toxicity_learns_nothing_from_held_out_rows(spark, tmp_path):
    rows, labels = _toxic_docs(400)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lies = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, known) == toxicity.fit(docs, lies)


def test_toxicity_without_labels_or_rows(spark, tmp_path):
    spark.createDataFrame([(1, "you are an idiot"), (2, "fine")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, none)).collect() == []


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version of its decision."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    before = docs
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, before, SF_SMALL).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns
        assert after.exceptAll(before).count() == 0
        if name == "exact_dedup":
            norm = F.regexp_replace("text", "[\\x20\\x09-\\x0D]", "")
            assert after.count() == before.select(norm).distinct().count() == after.select(norm).distinct().count()
        if name == "near_dedup":
            rows = before.collect()
            sets = []
            for r in rows:
                w = (r.text or "").lower().split()
                sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
            left = {r.doc_id for r in after.collect()}
            lost = [i for i, r in enumerate(rows) if r.doc_id not in left]
            for i in lost:  # who goes has a linked partner
                assert any(
                    100 * len(sets[i] & s) >= 80 * len(sets[i] | s) for j, s in enumerate(sets) if j != i and sets[i]
                )
            stay = [s for r, s in zip(rows, sets) if r.doc_id in left and s]
            assert not any(
                100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(stay) for b in stay[:i]
            )
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF_SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.collect()}
    sizes: dict = {}
    for r in packed:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert max(sizes.values()) <= 2048
    whole = corpus_pipeline.run(spark, SF_SMALL)
    assert sorted((r.doc_id, r.piece, r.length) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.length) for r in packed)


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", None), (1, None, "en", "s", None), (None, "", None, None, 0), (2, "a " * 9000, "de", "t", 1), (3, "A  " * 9000, "de", "t", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, part in (("odd", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(part, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0)] if part else [], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        # Null and empty texts are equal; "a ..." and "A ..." have equal shingles.
        assert len({(r.doc_id, r.piece) for r in out}) == len(out)
        assert {r.doc_id for r in out} == ({1, 2} if part else set())


def test_queries_are_registered():
    queries.load_all()
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in registry.QUERIES)
    assert numbers == list(range(1, 14))
