"""Byte-pair encoding and decoding with a segment tree over adjacent pairs.

A leaf of the tree holds the merge rank of one adjacent pair and its place, an
inner node the least of its two children. The root is thus the leftmost pair
of the lowest rank. A merge changes three leaves (the pair itself and its two
neighbours), each in logarithmic time, until no pair can be merged.

Words, as the file's split pattern cuts them, never merge with each other.
Each distinct word of a batch is encoded once: short words as rows of one
matrix, whose trees are worked on together, long ones alone, so a word of any
length takes n log n steps. A bounded cache keeps words between batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.llm import byte_level
from banlist.llm.registry import query, table
from banlist.llm.workers import Pool, ragged, ship, slices

ship(__name__)

NONE = np.int64(1) << 60
CACHED_WORDS = 300_000
# Up to this length words are merged together; longer ones alone.
LONGEST_ROW = 128
ROW_CELLS = 1 << 19
TOKENS_AT_ONCE = 1 << 18
_ID_BITS = 20


class SegmentTreeBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        import regex

        spec = byte_level.load(path)
        if spec["normalizer"] or spec["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path}: only byte-level files without word ends and normalizer")
        split = spec["pre_tokenizer"]
        if split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"{path}: only the plain byte-level split")
        self.findall = regex.compile(byte_level.BYTE_LEVEL_SPLIT).findall
        vocab = spec["model"]["vocab"]
        alphabet = byte_level.byte_alphabet()
        self.byte_ids = np.array([vocab[c] for c in alphabet], np.int64)
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in byte_level.pairs(spec)]
        table_ = np.array(merges, np.int64).reshape(-1, 3)
        keys = (table_[:, 0] << _ID_BITS) | table_[:, 1]
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(order, 0)
        self.merged = table_[:, 2].copy()
        self.ranks = {int(k): r for r, k in enumerate(keys)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        if size > 1 << _ID_BITS:
            raise ValueError(f"{path}: ids over {_ID_BITS} bits")
        back = {c: b for b, c in enumerate(alphabet)}
        texts = [b""] * size
        for token, i in vocab.items():
            texts[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            texts[i] = token.encode()
        self.bytes_of = Pool(np.uint8)
        self.bytes_of.extend(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
        digits = [b"%d," % i for i in range(size)]
        self.decimals_of = Pool(np.uint8)
        self.decimals_of.extend(np.frombuffer(b"".join(digits), np.uint8), np.array([len(t) for t in digits]))
        self._forget()

    def _forget(self) -> None:
        """Start the word cache anew; special strings have keys no word can have."""
        self.index = {(s,): k for k, s in enumerate(self.special)}
        self.words = Pool(np.int64)
        self.words.extend(np.array([*self.special.values()], np.int64), np.ones(len(self.special), np.int64))

    def encode_batch(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        words: list = []
        counts = np.empty(len(texts), np.int64)
        specials = list(self.special)
        for k, text in enumerate(texts):
            before = len(words)
            for part, special in byte_level.cut_out(text, specials):
                if special:
                    words.append((part,))
                else:
                    words += self.findall(part)
            counts[k] = len(words) - before
        if len(self.index) > CACHED_WORDS:
            self._forget()
        entries = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            new = list(dict.fromkeys([words[i] for i in missing]))
            self.words.extend(*self.encode_words(new))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            entries[missing] = [self.index[words[i]] for i in missing]
        ids, lengths = self.words.gather(entries)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)

    def encode_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        out: list = [None] * len(raw)
        found = np.zeros(len(raw), np.int64)
        width = 1
        while width <= LONGEST_ROW:
            rows = np.flatnonzero((sizes <= width) & ((sizes > width // 2) | (width == 1)))
            step = max(1, ROW_CELLS // width)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                cells = np.arange(width)
                inside = cells < sizes[some, None]
                matrix = np.full((len(some), width), -1, np.int64)
                matrix[inside] = ragged(flat, starts[some], sizes[some])
                ids, lengths = self.merge_rows(matrix)
                found[some] = lengths
                for k, end, length in zip(some.tolist(), np.cumsum(lengths).tolist(), lengths.tolist()):
                    out[k] = ids[end - length : end]
            width *= 2
        for k in np.flatnonzero(sizes > LONGEST_ROW):
            out[k] = np.array(self.merge_one(flat[starts[k] : starts[k] + sizes[k]].tolist()), np.int64)
            found[k] = len(out[k])
        return (np.concatenate(out) if out else np.empty(0, np.int64)), found

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << _ID_BITS) | right
        at = np.searchsorted(self.pair_keys, keys)
        hit = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_ranks[at], NONE)

    def merge_rows(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the words in the rows of a matrix (-1 behind a word's end)."""
        n, width = matrix.shape
        if width > 1:
            shift = width.bit_length() - 1
            # Column `width` stands for what is not there.
            tok = np.concatenate([matrix, np.full((n, 1), -1, np.int64)], axis=1)
            after = np.tile(np.minimum(np.arange(1, width + 2), width), (n, 1))
            before = np.tile(np.append(np.arange(-1, width - 1), width), (n, 1))
            before[:, 0] = width
            tree = np.full((n, 2 * width), NONE)

            def leaf(rank: np.ndarray, place) -> np.ndarray:
                return np.where(rank < NONE, (rank << shift) | place, NONE)

            tree[:, width:-1] = leaf(self._rank(tok[:, : width - 1], tok[:, 1:width]), np.arange(width - 1))
            level = width
            while level > 1:
                tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
                level //= 2
            rows = np.arange(n)
            while True:
                least = tree[rows, 1]
                live = least < NONE
                if not live.all():
                    rows, least = rows[live], least[live]
                if not len(rows):
                    break
                at, new = least & (width - 1), self.merged[least >> shift]
                gone = after[rows, at]
                nxt = after[rows, gone]
                prev = before[rows, at]
                tok[rows, at] = new
                tok[rows, gone] = -1
                after[rows, at] = nxt
                before[rows, nxt] = at
                tree[rows, width + gone] = NONE
                tree[rows, width + at] = leaf(self._rank(new, tok[rows, nxt]), at)
                # The last leaf has no pair: it takes the update of a missing neighbour.
                has = prev < width
                place = np.where(has, prev, width - 1)
                rank = self._rank(tok[rows, np.where(has, prev, width)], new)
                tree[rows, width + place] = leaf(rank, place)
                nodes = [width + gone, width + at, width + place]
                for _ in range(shift):
                    nodes = [node >> 1 for node in nodes]
                    for node in nodes:
                        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            matrix = tok[:, :width]
        kept = matrix >= 0
        return matrix[kept], kept.sum(axis=1)

    def merge_one(self, tok: list[int]) -> list[int]:
        """Merge one word of any length."""
        n = len(tok)
        width = 1 << max(1, (n - 1).bit_length())
        none, ranks, merged = int(NONE), self.ranks, self.merged.tolist()
        after = [*range(1, n + 1)]
        before = [*range(-1, n - 1)]

        def leaf(i: int) -> int:
            j = after[i]
            rank = ranks.get(tok[i] << _ID_BITS | tok[j]) if j < n else None
            return none if rank is None else rank * width + i

        tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    return
                tree[node] = value

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            tok[i], tok[j] = merged[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [t for t in tok if t >= 0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.bytes_of.gather(ids)[0].tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, each followed by a comma."""
        return self.decimals_of.gather(ids)[0].tobytes()


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, ids array<int>)`` of every whole text.

    A null text is an empty one and has no ids. Strings of special tokens get
    their ids, as the tokenizer file's library does by default. Rows are
    independent: repeated rows and null keys stay as they are, and other
    columns are ignored. No shuffle; a task holds a few MB of texts at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SegmentTreeBpe(path)
        for batch in slices(batches, "t"):
            ids, counts = bpe.encode_batch(_texts(batch, "t"))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(docs: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``(key, text)`` of lists of ids; bytes that are not UTF-8 become U+FFFD.

    A null list is an empty one, null elements are skipped, ids that the file
    does not have are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SegmentTreeBpe(path)
        for batch in batches:
            texts = []
            for row in batch.column(1):
                own = np.array([i for i in row.as_py() or [] if i is not None], np.int64)
                if len(own) and not 0 <= own.min() <= own.max() < bpe.bytes_of.entries:
                    raise ValueError("an id that the tokenizer file does not have")
                texts.append(bpe.decode_bytes(own).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "text"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode each text, decode its ids, and return digests of both in one pass.

    ``(key, n_tokens, ids_sha256, decoded_sha256)``; edge cases as in `encode`.
    A text's ids are turned into digits and bytes in pieces of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SegmentTreeBpe(path)
        for batch in slices(batches, "t"):
            ids, counts = bpe.encode_batch(_texts(batch, "t"))
            id_digests, text_digests = [], []
            end = 0
            for n in counts.tolist():
                own = ids[end : end + n]
                end += n
                digits, decoded = hashlib.sha256(), hashlib.sha256()
                for at in range(0, n, TOKENS_AT_ONCE):
                    some = own[at : at + TOKENS_AT_ONCE]
                    listed = bpe.decimals(some)
                    digits.update(listed if at + TOKENS_AT_ONCE < n else listed[:-1])
                    if n <= TOKENS_AT_ONCE:
                        raw = bpe.decode_bytes(some)
                        decoded.update(raw.decode("utf-8", "replace").encode())
                if n > TOKENS_AT_ONCE:
                    _decode_pieces(bpe, own, decoded)
                id_digests.append(digits.hexdigest())
                text_digests.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                ["k", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def _decode_pieces(bpe: SegmentTreeBpe, ids: np.ndarray, digest) -> None:
    """Decode a long list of ids piece by piece; a character may span two pieces."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(ids), TOKENS_AT_ONCE):
        raw = bpe.decode_bytes(ids[at : at + TOKENS_AT_ONCE])
        digest.update(decoder.decode(raw, at + TOKENS_AT_ONCE >= len(ids)).encode())


@query("op8_bpe_round_trip")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
