"""Exact token counts of every prefix of a text, by dynamic programming.

For each prefix of a word the table holds the last token of its encoding: of
the tokens that end there, the one that is valid behind the last token of the
prefix it leaves. Its count is that prefix's count plus one. Two neighbouring
tokens are valid when no pair across their border is merged earlier than the
pieces it is made of. A prefix that ends a text also ends a word, so a second
row of the table closes each prefix with a word-end token.

Words do not merge with each other. A text's table is therefore the running
sum of its words' tables, and truncation and budget questions are answered
from it without encoding anything again.

The distinct words of a batch are sorted and worked on together, one length
after another: words that begin alike share the states of that beginning. A
bounded cache keeps words between batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.llm import byte_level
from banlist.llm.registry import query, table
from banlist.llm.workers import Pool, ship, slices

ship(__name__)

CACHED_WORDS = 400_000
# Words of up to so many bytes are worked on together; longer ones alone.
LONGEST_ROW = 32
_PAIR_SLOTS_BITS = 20
_NEVER = 1 << 40
_ID_BITS = 20
# Lower case of letters that came with Unicode 16, which Python
# does not know yet.
_NEW_LOWER = {0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)}


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


class IntTable:
    """Many look-ups of integer keys at once; -1 for a key that is not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        slots = _slots(keys, self.bits)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], self._next(slots[~placed])

    def _next(self, slots: np.ndarray) -> np.ndarray:
        return (slots + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = _slots(keys, self.bits)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        slots = slots[open_]
        while len(open_):
            slots = self._next(slots)
            there = self.keys[slots]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slots[hit]]
            more = ~hit & (there >= 0)
            open_, slots = open_[more], slots[more]
        return out


class PrefixCounter:
    """Prefix tables under one lower-casing tokenizer file with word ends."""

    def __init__(self, path: str) -> None:
        import regex

        spec = byte_level.load(path)
        steps = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.end = spec["model"].get("end_of_word_suffix")
        if steps != ["NFC", "Replace", "Lowercase"] or not self.end:
            raise ValueError(f"{path}: only files that lower-case and mark word ends")
        self.findall = regex.compile(byte_level.WORD_SPLIT).findall
        self.spaces = regex.compile(r"\s+")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self._learn_merges(spec)
        self._forget()

    def _learn_merges(self, spec: dict) -> None:
        """Number the tokens; per token, its pieces along either border, each
        with the rank at which it disappears into a larger piece of the token."""
        alphabet = byte_level.byte_alphabet()
        names = [*alphabet, *(c + self.end for c in alphabet)]
        number = {s: i for i, s in enumerate(names)}
        # A token as symbols: a byte, plus 256 if it also ends the word.
        symbols = [(i,) for i in range(512)]
        self.right = [((i, _NEVER),) for i in range(512)]
        self.left = list(self.right)
        self.rank: dict[int, int] = {}
        born = [-1] * 512
        for rank, (a, b) in enumerate(byte_level.pairs(spec)):
            x, y = number.get(a), number.get(b)
            if x is None or y is None or a + b in number:
                raise ValueError("a merge rule of unknown parts, or a second one for a token")
            if max(born[x], born[y]) >= rank:
                raise ValueError("merge rules are not in the order they were learnt")
            self.rank[x << _ID_BITS | y] = rank
            n = number[a + b] = len(symbols)
            symbols.append(symbols[x] + symbols[y])
            born.append(rank)
            self.right.append(((n, _NEVER), (y, rank), *self.right[y][1:]))
            self.left.append(((n, _NEVER), (x, rank), *self.left[x][1:]))
        # A token that its own text does not encode to can never be a last token.
        self.token = {symbols[n]: n for n in range(len(symbols)) if born[n] < 0 or self._own(n, born[n])}
        self.longest = max(map(len, self.token))
        self._tables()

    def _own(self, n: int, rank: int) -> bool:
        """Whether the token's two halves stay apart until they become the token."""
        x, y = self.left[n][1][0], self.right[n][1][0]
        for p, dp in self.right[x]:
            for q, dq in self.left[y]:
                found = self.rank.get(p << _ID_BITS | q, _NEVER)
                if (p, q) != (x, y) and found < min(dp, rank) and found <= min(dq, rank):
                    return False
        return True

    def _fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: no pair across the border comes first.

        Of equal ranks the left pair is merged first, so a pair loses against
        the end of its left piece and wins against the end of its right one.
        """
        for p, dp in self.right[a]:
            for q, dq in self.left[b]:
                rank = self.rank.get(p << _ID_BITS | q)
                if rank is not None and rank < dp and rank <= dq:
                    return False
        return True

    def _tables(self) -> None:
        """The same facts as arrays: a trie of the tokens, ranks, border pieces."""
        steps: dict[int, int] = {}
        ends = [-1]
        for name, n in self.token.items():
            node = 0
            for symbol in name:
                key = node << 9 | symbol
                node = steps.get(key, 0)
                if not node:
                    node = steps[key] = len(ends)
                    ends.append(-1)
            ends[node] = n
        self.steps = IntTable(np.array([*steps], np.int64), np.array([*steps.values()], np.int64))
        self.ends = np.array([*ends, -1], np.int64)  # node -1: no such beginning
        self.ranks = IntTable(np.array([*self.rank], np.int64), np.array([*self.rank.values()], np.int64))

        def padded(sides: list) -> tuple[np.ndarray, np.ndarray]:
            depth = max(map(len, sides))
            grid = np.full((2, len(sides), depth), -1, np.int64)
            for k, side in enumerate(sides):
                grid[:, k, : len(side)] = np.array(side).T
            return grid[0], grid[1]

        self.rights, self.lefts = padded(self.right), padded(self.left)
        self.pair_keys = np.full(1 << _PAIR_SLOTS_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << _PAIR_SLOTS_BITS, bool)

    def _fit_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`_fits` of many pairs, behind a cache with one place for each slot."""
        keys = a << _ID_BITS | b
        slots = _slots(keys, _PAIR_SLOTS_BITS)
        out = self.pair_fits[slots]
        new = np.flatnonzero(self.pair_keys[slots] != keys)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            a, b = fresh >> _ID_BITS, fresh & ((1 << _ID_BITS) - 1)
            good = np.ones(len(fresh), bool)
            for i in range(self.rights[0].shape[1]):
                rows = np.flatnonzero(good & (self.rights[0][a, i] >= 0))
                for j in range(self.lefts[0].shape[1]):
                    rows = rows[good[rows] & (self.lefts[0][b[rows], j] >= 0)]
                    if not len(rows):
                        break
                    x, y = a[rows], b[rows]
                    rank = self.ranks.get(self.rights[0][x, i] << _ID_BITS | self.lefts[0][y, j])
                    first = (rank >= 0) & (rank < self.rights[1][x, i]) & (rank <= self.lefts[1][y, j])
                    good[rows[first]] = False
            slots = _slots(fresh, _PAIR_SLOTS_BITS)
            self.pair_keys[slots], self.pair_fits[slots] = -1, False
            self.pair_keys[slots] = fresh
            kept = self.pair_keys[slots] == fresh
            self.pair_fits[slots[kept]] = good[kept]
            out[new] = good[back]
        return out

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.words = Pool(np.int32)

    def _one_word(self, raw: bytes) -> list[int]:
        """Closed counts of every prefix (in bytes) of one word."""
        last, count, closed = [-1], [0], []
        for k in range(1, len(raw) + 1):
            for ending in (0, 256):
                for j in range(max(0, k - self.longest), k):
                    token = self.token.get((*raw[j : k - 1], raw[k - 1] + ending))
                    if token is not None and (not j or self._fits(last[j], token)):
                        break
                if ending:
                    closed.append(count[j] + 1)
                else:
                    last.append(token)
                    count.append(count[j] + 1)
        return closed

    def _many_words(self, raw: list[bytes]) -> np.ndarray:
        """Closed counts of every prefix of sorted words, a row for each word.

        Words that begin alike share the states of that beginning: at each
        length only the first word of each different beginning is worked on.
        """
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        width = int(sizes.max())
        byte = np.array(raw, f"S{width}").view(np.uint8).reshape(len(raw), width).astype(np.int64)
        inside = np.arange(width) < sizes[:, None]
        same = np.zeros((len(raw), width), bool)
        same[1:] = (byte[1:] == byte[:-1]) & inside[1:] & inside[:-1]
        new = inside & ~np.logical_and.accumulate(same, axis=1)
        owner = np.cumsum(new, axis=0) - 1
        out = np.zeros((len(raw), width), np.int64)
        states = np.zeros((1, 0), np.int64)
        lasts, counts = [np.array([-1])], [np.array([0])]
        for k in range(1, width + 1):
            rows = np.flatnonzero(new[:, k - 1])
            if not len(rows):
                break
            parents = owner[rows, k - 2] if k > 1 else np.zeros(len(rows), np.int64)
            before = np.concatenate([states[parents], np.zeros((len(rows), 1), np.int64)], axis=1)
            shorter = [owner[rows, j - 1] if j else np.zeros(len(rows), np.int64) for j in range(k)]
            prev = np.stack([lasts[j][shorter[j]] for j in range(k)], axis=1)
            sums = np.stack([counts[j][shorter[j]] for j in range(k)], axis=1)
            alive = before >= 0
            for ending in (0, 256):
                nodes = np.full(before.shape, -1, np.int64)
                symbol = np.broadcast_to(byte[rows, k - 1, None] + ending, before.shape)[alive]
                nodes[alive] = self.steps.get(before[alive] << 9 | symbol)
                tokens = self.ends[nodes]
                good = tokens >= 0
                check = good & (np.arange(k) > 0)
                good[check] = self._fit_many(prev[check], tokens[check])
                at = good.argmax(axis=1)[:, None]
                total = np.take_along_axis(sums, at, 1)[:, 0] + 1
                if ending:
                    own = owner[:, k - 1]
                    out[:, k - 1] = np.where(inside[:, k - 1], total[np.maximum(own, 0)], 0)
                else:
                    states = nodes
                    lasts.append(np.take_along_axis(tokens, at, 1)[:, 0])
                    counts.append(total)
        return out

    def word_tables(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The token count of every prefix (in characters) of each word, one
        word after another, and the words' lengths in characters."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        tables: list = [None] * len(words)
        short = sorted((k for k, r in enumerate(raw) if len(r) <= LONGEST_ROW), key=raw.__getitem__)
        step = 1 << 15
        for at in range(0, len(short), step):
            some = short[at : at + step]
            counts = self._many_words([raw[k] for k in some])
            for row, k in zip(counts, some):
                tables[k] = row[: len(raw[k])]
        for k, own in enumerate(tables):
            if own is None:
                tables[k] = np.array(self._one_word(raw[k]))
            if len(raw[k]) != len(words[k]):
                # Prefixes end where no continuation byte follows.
                after = np.frombuffer(raw[k] + b"a", np.uint8)[1:]
                tables[k] = tables[k][(after & 0xC0) != 0x80]
            if len(words[k]) > 1 and words[k][0] == "'" and words[k][1].isalpha():
                # A shorter prefix of 're or 's is an apostrophe and a letter word.
                inner = self._one_word(raw[k][1:-1])
                tables[k] = np.array([1, *(1 + c for c in inner), tables[k][-1]])
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return (np.concatenate(tables) if tables else np.empty(0)).astype(np.int32), lengths

    def normalise(self, text: str) -> str:
        import unicodedata

        text = self.spaces.sub(" ", text if text.isascii() else unicodedata.normalize("NFC", text))
        if text.isascii():
            return text.lower()
        # Each character for itself: the final sigma is not treated specially.
        lower = "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()
        return lower.translate(_NEW_LOWER)

    def counts(self, text: str) -> np.ndarray:
        """Counts after each character of a normalised text without special strings."""
        words = self.findall(text)
        if len(self.index) > CACHED_WORDS:
            self._forget()
        entries = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            new = list(dict.fromkeys([words[i] for i in missing]))
            self.words.extend(*self.word_tables(new))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            entries[missing] = [self.index[words[i]] for i in missing]
        values, lengths = self.words.gather(entries)
        totals = values[np.cumsum(lengths) - 1] if len(values) else values
        values = np.append(0, values + np.repeat(np.cumsum(totals) - totals, lengths))
        # White space is in no word and has no token.
        shown = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) != 32
        return values[np.cumsum(shown)]

    def prefix_table(self, text: str) -> np.ndarray:
        """Element k is the token count of the first k characters of the
        normalised text; special strings stay as they are in it."""
        done = [np.zeros(1, np.int64)]
        total = 0
        mark = ""
        for part, special in byte_level.cut_out(text, self.specials):
            if special:
                # Inside the string its characters are ordinary ones, and its
                # first ones may continue the mark before it.
                before = total - (int(self.counts(mark)[-1]) if mark else 0)
                inner = self.counts(mark + part)[len(mark) : -1] + before
                own = np.append(inner, total + 1)
                mark = ""
            else:
                part = self.normalise(part)
                own = self.counts(part) + total
                words = self.findall(part)
                mark = words[-1] if words and part[-1] == words[-1][-1] and not part[-1].isalnum() else ""
            if len(own):
                total = int(own[-1])
                done.append(own)
        return np.concatenate(done)

    def prefix_tables(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The tables of many texts; plain ones are counted as one long text."""
        tables: list = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if not any(s in t for s in self.specials)]
        shown = [self.normalise(texts[k]) for k in plain]
        # A space between two texts keeps their words apart.
        counts = np.append(0, self.counts(" ".join(shown)))
        at = 0
        for k, text in zip(plain, shown):
            tables[k] = counts[at : at + len(text) + 1] - counts[at]
            at += len(text) + 1
        return [self.prefix_table(t) if own is None else own for t, own in zip(texts, tables)]


def longest_within(prefixes: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most so many tokens. Counts can
    fall when a longer prefix merges better, so the last one counts."""
    return int(np.flatnonzero(prefixes <= budget)[-1])


def count_prefixes(
    docs: DataFrame,
    path: str,
    budget: int = 2048,
    text: str = "text",
    key: str = "doc_id",
    keep_table: bool = False,
) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit, fit_chars, prefix_tokens)`` per row.

    ``fit_chars`` is the length of the longest prefix of the normalised text
    within the budget; ``prefix_tokens`` is the whole table (null unless
    asked for). A null text is an empty one with no tokens. Rows are independent: repeated rows
    and null keys stay, other columns are ignored. No shuffle; a task holds a
    few MB of texts at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(path)
        for batch in slices(batches, "t", rows=4096, size=2_000_000):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_tokens, fits, tables = [], [], []
            for prefixes in counter.prefix_tables(texts):
                n_tokens.append(int(prefixes[-1]))
                fits.append(longest_within(prefixes, budget))
                tables.append(prefixes.astype(np.int32) if keep_table else None)
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > budget for n in n_tokens], pa.bool_()),
                    pa.array(fits, pa.int64()),
                    pa.array(tables, pa.list_(pa.int32())),
                ],
                ["k", "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_tokens"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = f"k {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, prefix_tokens array<int>"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


@query("op2_prefix_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return count_prefixes(table(spark, sf_dir, "documents"), path).drop("prefix_tokens")
