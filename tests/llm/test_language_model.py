"""Prediction by partial matching against a trie of dictionaries."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from banlist.llm import language_model, queries, registry
from tests.conftest import SF_SMALL

SF_LARGE = "/root/testdata/sf0.1"

SCHEMA = "doc_id long, text string, held_out string, score string, k string, words string, cell string"
HELD = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1"


def held(key) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 1


def tokens(text: str | None) -> list[bytes]:
    lower = re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0d]+", lower), b""]


class Trie:
    """Bytes seen after every context, by order, with a walk from the longest down."""

    def __init__(self, texts: list[bytes]) -> None:
        self.after: dict[bytes, Counter] = {}
        for text in texts:
            for context, byte in steps(text):
                for order in range(language_model.ORDER + 1):
                    self.after.setdefault(context[len(context) - order :], Counter())[byte] += 1
        self.known: dict = {}

    def chance(self, context: bytes, byte: int) -> float:
        p, out = 1.0, set()
        for order in range(language_model.ORDER, -1, -1):
            seen = {s: 2 * c - 1 for s, c in self.after.get(context[len(context) - order :], {}).items() if s not in out}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if byte in seen:
                return p * seen[byte] / whole
            p *= len(seen) / whole
            out |= set(seen)
        return p / (language_model.ALPHABET - len(out))

    def score(self, text: bytes) -> float:
        for step in set(steps(text)) - set(self.known):
            self.known[step] = log10(self.chance(*step))
        return sum(self.known[s] for s in steps(text))


def steps(text: bytes) -> list[tuple[bytes, int]]:
    padded = b" " * language_model.ORDER + text
    return [(padded[i : i + language_model.ORDER], byte) for i, byte in enumerate(text)]


def stream(own: list[bytes]) -> bytes:
    return b"".join(w + b" " for w in own[:-1]) + b"\n"


def expected(rows: list[tuple]) -> list[tuple]:
    counts: Counter = Counter()
    for key, text in rows:
        if not held(key):
            counts.update(tokens(text))
    total, known = sum(counts.values()), len(counts)
    trie = Trie([stream(tokens(t)) for k, t in rows if not held(k)])
    out = []
    for key, text in rows:
        own = tokens(text)
        base = sum(log10((counts[w] + 0.5) / (total + 0.5 * (known + 1))) for w in own)
        out.append((key, held(key), len(own), sum(w in counts for w in own), total, base, trie.score(stream(own))))
    return out


def close(got: list, want: list[tuple]) -> None:
    got = sorted((tuple(r) for r in got), key=repr)
    want = sorted(want, key=repr)
    assert len(got) == len(want)
    key = lambda r: (repr(r[0]), r[2], round(r[6], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def _documents() -> list[tuple]:
    rng = random.Random(3)
    parts = ["the", "an", "ing", "é", "ß", "st", "er", "Q", "x.", "\x00", "\x1c", "|"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    rows = [(i, rng.choice([" ", "\n", "\t \r"]).join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " \n\t\x0b\x0c\r "), (73, "the"), (74, "THE"), (75, "unseen𝄞word"), (None, "no key"), (None, None)]
    rows += [(76, "same text"), (76, "same text"), (77, "the " * 200_000 + "w" * 300_000), (78, "y" * 100_000)]
    return rows


def make(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA).repartition(5)


def test_scores(spark):
    rows = _documents()
    got = language_model.scores(make(spark, rows), F.expr(HELD)).collect()
    close(got, expected(rows))


def test_chances_of_a_context_add_up_to_one():
    own = [w or b"\n" for _, text in _documents()[:60] for w in tokens(text)]
    words = sorted(set(own))
    at = np.array([words.index(w) for w in own], np.int32)
    keys, sums = language_model.path_counts(words, at, np.ones(len(at), bool))
    low, low_sums = language_model.summed(keys & np.uint64(0xFFFF), sums)
    model = language_model.levels(keys, sums, low, low_sums)
    every = np.array([b for b in range(256) if b not in b"\t\x0b\x0c\r"], np.uint64)
    contexts = [int(k) >> 8 for k in keys[::97]] + [int.from_bytes(b"zzzzz", "big"), int.from_bytes(b"zzthe", "big")]
    for context in contexts:
        chances = 10 ** language_model.log_chances(model, np.uint64(context << 8) | every)
        assert chances.sum() == pytest.approx(1, abs=1e-9)
        assert chances.min() > 0


def test_no_training_rows_and_no_rows(spark):
    rows = [(i, "a b") for i in range(200) if held(i)]
    close(language_model.scores(make(spark, rows), F.expr(HELD)).collect(), expected(rows))
    assert language_model.scores(make(spark, rows).where("false"), F.expr(HELD)).count() == 0


def test_query(spark):
    queries.load_all()
    got = registry.QUERIES["op12_ppm_scores"](spark, SF_SMALL)
    assert dict(got.dtypes) == {
        "doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint",
        "train_tokens": "bigint", "base_score": "double", "score": "double",
    }
    rows = [tuple(r) for r in registry.table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    close(got.collect(), expected(rows))


def test_better_than_the_base_on_held_out_rows(spark):
    got = registry.QUERIES["op12_ppm_scores"](spark, SF_LARGE).where("held_out").agg(F.sum("score"), F.sum("base_score"))
    score, base = got.first()
    assert score > base
