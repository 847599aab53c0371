"""Encoding, decoding and prefix counts against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from banlist.llm import bpe, packing, token_counts

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
TRAPS = [
    "", " ", "   \n\n a", "a" * 700, "ab" * 400, "don't we'll I'RE !!'s", "<|endoftext|>", "x<|endoftext|>!!<|startoftext|> y",
    "<|endof", "café é É", "漢字 \U0001f600\U0001f468‍\U0001f469", "ΑΣ Σ", "İx",
    "\x1c\x1d a\x85b c ", "1234 5 ３٣", "ﬁ K", "́abc", "tab\tand\r\nline", "'", "''ll", "�",
]


def _texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    bits = ["the", "ing", " ", "  ", "\n", "'s", "'", "!", "a", "é", "́", "漢", "7", "42", "<|endoftext|>", "zq", "\U0001f600"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


def ids_of(tokenizer: Tokenizer, text: str) -> list[int]:
    return tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    texts = TRAPS + _texts(1, 200)
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "a b", None, None), (0, None, "x", None), (5, "same", "x", "y"), (5, "same", "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")


def test_encode_and_decode(docs, library):
    rows = docs.collect()
    encoded = bpe.encode(docs, BYTE)
    got = encoded.collect()
    assert [(r.doc_id, r.ids) for r in got] == [(r.doc_id, ids_of(library[0], r.text or "")) for r in rows]
    back = bpe.decode(encoded, BYTE).collect()
    assert [r.text for r in back] == [r.text or "" for r in rows]
    broken = docs.sparkSession.createDataFrame([(1, [150, None, 999]), (2, None)], "doc_id long, ids array<int>")
    got = [r.text for r in bpe.decode(broken, BYTE).collect()]
    assert got == [library[0].decode([150, 999], skip_special_tokens=False), ""]


def test_round_trip_digests(docs, library, monkeypatch):
    import hashlib

    rows = docs.collect()
    for r, got in zip(rows, bpe.round_trip(docs, BYTE).collect()):
        ids = ids_of(library[0], r.text or "")
        assert (got.doc_id, got.n_tokens) == (r.doc_id, len(ids))
        assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), BYTE).collect() == []


def test_pieces_of_a_long_text_keep_their_characters(monkeypatch):
    import hashlib

    monkeypatch.setattr(bpe, "TOKENS_AT_ONCE", 3)
    coder = bpe.SegmentTreeBpe(BYTE)
    ids, _ = coder.encode_batch(["\U0001f600漢 \U0001f468 ab" * 9])
    digest = hashlib.sha256()
    bpe._decode_pieces(coder, ids, digest)
    assert digest.hexdigest() == hashlib.sha256(("\U0001f600漢 \U0001f468 ab" * 9).encode()).hexdigest()


def test_both_forms_of_the_tree_agree(library):
    coder = bpe.SegmentTreeBpe(BYTE)
    rng = random.Random(3)
    for size in (1, 2, 3, 17, 128, 129, 3000):
        word = "".join(rng.choice("aabthein") for _ in range(size))
        alone = coder.merge_one(coder.byte_ids[np.frombuffer(word.encode(), np.uint8)].tolist())
        assert alone == ids_of(library[0], word) == coder.encode_batch([word])[0].tolist()


def test_cache_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 4)
    coder = bpe.SegmentTreeBpe(BYTE)
    for text in _texts(4, 30):
        assert coder.encode_batch([text])[0].tolist() == ids_of(library[0], text)


def test_every_prefix_is_counted(library):
    counter = token_counts.PrefixCounter(WORD)
    for text in TRAPS + _texts(2, 60):
        table = counter.prefix_table(text)
        assert table[0] == 0
        assert table[-1] == len(ids_of(library[1], text)), repr(text)
        if "<|" not in text:
            shown = counter.normalise(text)
            assert len(table) == len(shown) + 1
            for k in range(len(shown) + 1):
                assert table[k] == len(ids_of(library[1], shown[:k])), repr(shown[:k])
        else:
            for k in range(len(text) + 1) if text.isascii() and text == text.lower() and "  " not in text and "\n" not in text else ():
                assert table[k] == len(ids_of(library[1], text[:k])), repr(text[:k])


def test_long_words_and_many_texts_at_once(library):
    counter = token_counts.PrefixCounter(WORD)
    texts = TRAPS + _texts(5, 100)
    for text, table in zip(texts, counter.prefix_tables(texts)):
        assert table.tolist() == counter.prefix_table(text).tolist()
    word = "".join(random.Random(6).choice("thingeraco") for _ in range(60))
    raw = word.encode()
    rows = counter._many_words(sorted([raw[:32], raw[:31], raw[:9] + b"zz"]))
    assert rows[[r.startswith(raw[:32]) for r in sorted([raw[:32], raw[:31], raw[:9] + b"zz"])].index(True), :32].tolist() == counter._one_word(raw)[:32]


def test_budget_questions(docs, library):
    rows = docs.collect()
    got = token_counts.count_prefixes(docs, WORD, budget=7, keep_table=True).collect()
    for r, g in zip(rows, got):
        n = len(ids_of(library[1], r.text or ""))
        assert (g.doc_id, g.n_bytes, g.n_tokens, g.over_limit) == (r.doc_id, len((r.text or "").encode()), n, n > 7)
        assert g.prefix_tokens[g.fit_chars] <= 7 and all(c > 7 for c in g.prefix_tokens[g.fit_chars + 1 :])
    assert token_counts.count_prefixes(docs.limit(0), WORD).collect() == []


def test_pieces(docs, library):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()
    df = docs.sparkSession.createDataFrame(rows, docs.schema)
    got = packing.pieces(df, BYTE, capacity=5, keep_ids=True).collect()
    by_doc: dict = {}
    for g in got:
        by_doc.setdefault(g.doc_id, []).append(g)
        assert len(g.ids) == g.length <= 5 and g.ids_crc32 == zlib.crc32(np.array(g.ids, "<u4").tobytes())
    for r in rows:
        parts = sorted(by_doc[r.doc_id], key=lambda g: g.piece)
        assert [g.piece for g in parts] == list(range(len(parts)))
        assert [i for g in parts for i in g.ids] == ids_of(library[0], r.text or "") + [0]
        assert all(g.length == 5 for g in parts[1:])
        assert [g.start for g in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]


@pytest.mark.parametrize("text", ["x" + " " * 2_000_000 + "word", "\n" * 2_000_000, "a" * 300_000, " " * 1_200_000, "b \n" + "\u3000" * 400_000 + " c", "<|endoftext|>" + "\n" * 150_000 + "<|endoftext|> x"])
def test_long_runs_have_the_librarys_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.FastByteLevel(path).ids(text).tolist() == want
