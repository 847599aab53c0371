"""Phrase mining against counting everything."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from banlist.llm import phrases, queries, registry
from tests.conftest import SF_CHECK

SCHEMA = "text string, lang string, n string, rank string, phrase string, cell string"


def _expected(rows: list[tuple], longest=5, bar=100, percent=100, top=2000) -> list[tuple]:
    n: Counter = Counter()
    f: dict = defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: c for p, c in counts.items() if c >= bar}
        scored = []
        for p, a in found.items():
            if len(p) < 2:
                continue
            inside = any(
                len(q) > len(p) and 100 * c >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, c in found.items()
            )
            if not inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def _texts(seed: int, size: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["a", "B", "c", "dd", "É", "ß", "x\x1cy", "\x00", "𝄞", "-", "of", "OF"]
    ends = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\x0b", "!", " ; "]
    fixed = ["new york city hall", "in the year of", "a a a a a a"]
    rows = []
    for _ in range(size):
        out = []
        for _ in range(rng.randint(0, 60)):
            out.append(rng.choice(fixed) if rng.random() < 0.1 else rng.choice(words))
            out.append(rng.choice(ends))
        rows.append(("".join(out), rng.choice(["en", "de", None, "", "und"])))
    rows += [(None, "en"), ("", "en"), (" \n.", "en"), (None, None), ("alone", "fr")]
    rows += [("same words twice " * 3, "en")] * 4 + [("go on " * 30_000 + "w" * 300_000, "en"), ("on go " * 400, "xx")]
    return rows


def _run(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in phrases.collocations(frame.repartition(6), **settings).collect())


@pytest.mark.parametrize("settings", [{"bar": 8}, {"bar": 3, "longest": 3, "percent": 70, "top": 9}, {"bar": 10_000}])
def test_against_counting_everything(spark, settings):
    rows = _texts(7, 150)
    got = _run(spark, rows, **settings)
    assert got == _expected(rows, **settings)
    assert got


def test_one_language_with_nothing_frequent_and_no_rows(spark):
    assert _run(spark, [("a b c", "en")], bar=2) == []
    assert _run(spark, [], bar=2) == []


def test_small_cells_and_parts(spark, monkeypatch):
    from banlist.llm import cells

    monkeypatch.setattr(cells, "CELL_BYTES", 300)
    monkeypatch.setattr(cells, "PART_ENTRIES", 10)
    rows = _texts(8, 60)
    assert _run(spark, rows, bar=6) == _expected(rows, bar=6)


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(2)
    for _ in range(30):
        stream = rng.zipf(1.3, 4000) % 500
        bar = int(rng.integers(5, 200))
        summary = phrases.Summary(len(stream) // bar + 1)
        for piece in np.array_split(stream, int(rng.integers(1, 40))):
            other = phrases.Summary(summary.room)
            for small in np.array_split(piece, 3):
                other.merge(*(x.astype(t) for x, t in zip(np.unique(small, return_counts=True), (np.uint64, np.int64))))
            summary.merge(other.keys, other.counts)
        assert len(summary.keys) <= summary.room
        keys, counts = np.unique(stream, return_counts=True)
        assert set(keys[counts >= bar].tolist()) <= set(summary.keys.tolist())


def test_query(spark):
    queries.load_all()
    got = registry.QUERIES["op13_collocations"](spark, SF_CHECK)
    assert dict(got.dtypes) == {
        "lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint",
        "n": "bigint", "score": "bigint",
    }
    rows = [tuple(r) for r in registry.table(spark, SF_CHECK, "documents").select("text", "lang").collect()]
    assert sorted(tuple(r) for r in got.collect()) == _expected(rows)
