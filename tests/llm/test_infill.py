"""Fill-in-middle against plain slicing."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from banlist.llm import infill, queries, registry
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, k string, h1 string, output string, form string"


def _texts() -> list[str | None]:
    rng = random.Random(11)
    letters = "ab é\n\t𝄞ß<>PSM"
    out: list[str | None] = [None, "", " ", "\n", "x", "<P>", "a<S>b", "<<M>>", "𝄞", "<P", "S>" * 40]
    out += ["".join(rng.choice(letters) for _ in range(rng.choice([2, 9, 60, 1023, 1024, 1025, 5000]))) for _ in range(120)]
    out += ["é" * 700_000 + "x " * 50_000, "same", "same", "\n" * 5000, " " * 5000]
    return out


def _pieces(text: str, unit: str) -> list[str]:
    if unit == "chars":
        return list(text)
    if unit == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    words = re.findall(r"[ \t-\r]*[^ \t-\r]+", text)
    rest = text[len("".join(words)) :]
    return words[:-1] + [words[-1] + rest] if words else [text] if text else []


def _expected(key, text: str | None, unit: str) -> tuple:
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    pieces = _pieces(text, unit)
    n = len(pieces)
    if not text or h3 % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (pieces[:a], pieces[a:b], pieces[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "clash", "clash", "clash") for i, t in enumerate(_texts())]
    rows += [(None, "no key at all", *["clash"] * 4), (3, "a repeated key", *["clash"] * 4), (-7, "negative", *["clash"] * 4)]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("unit", ["chars", "words", "lines"])
def test_outputs_and_way_back(docs, unit):
    settings = infill.Settings(unit=unit)
    made = infill.fill_in_middle(docs, settings=settings)
    back = made.withColumn("back", infill.restored(F.col("output"), F.col("form"), settings)).collect()
    got = sorted(((r.doc_id, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back), key=repr)
    rows = docs.select("doc_id", "text").collect()
    assert got == sorted(((r.doc_id, *_expected(r.doc_id, r.text, unit)) for r in rows), key=repr)
    assert sorted(r.back for r in back) == sorted(r.text or "" for r in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_empty_table(docs):
    assert infill.fill_in_middle(docs.where("false")).count() == 0


def test_every_cut_of_a_tree():
    text = ("é\n" * 900 + "ab c\n" * 800 + "𝄞" * 400).encode()
    for unit in ("chars", "words", "lines"):
        tree = infill.BlockTree(np.frombuffer(text, np.uint8), unit)
        pieces = _pieces(text.decode(), unit)
        assert tree.units == len(pieces)
        for cut in [0, 1, 2, tree.units - 1, tree.units, *range(3, tree.units, 37)]:
            head = "".join(pieces[:cut])
            assert tree.cut(cut) == (len(head.encode()), len(head))


def test_other_markers_and_shares(docs):
    settings = infill.Settings("\x02pre", "\x03suf", "\x04mid", fim_percent=100, spm_percent=100, seed="s")
    made = infill.fill_in_middle(docs, settings=settings)
    rows = made.select("output", "form", infill.restored(F.col("output"), F.col("form"), settings).alias("back")).collect()
    assert {r.form for r in rows if r.back} == {"spm"}
    assert sorted(r.back for r in rows) == sorted(r.text or "" for r in docs.select("text").collect())
    for bad in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs, settings=infill.Settings(*bad))


def test_query(spark):
    queries.load_all()
    got = registry.QUERIES["op11_fill_in_middle"](spark, SF_SMALL)
    assert dict(got.dtypes) == {
        "doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint",
        "output_sha256": "string", "restored_sha256": "string",
    }
    docs = registry.table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {r.doc_id: _expected(r.doc_id, r.text, "chars") for r in docs}
    for r in got.collect():
        n, form, a, b, out = want.pop(r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, a, b, digest(out))
    assert not want
