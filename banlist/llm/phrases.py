"""Phrases whose words occur together more often than they would by themselves.

Phrases are counted level by level, as a frequent phrase of n words consists of two
frequent ones of n - 1. At each level

1. a cell of texts (see `cells`) numbers the phrases of n words whose two parts are
   known to be frequent, and sends each distinct one once, with its count, to the
   hash partition that owns it;
2. a partition goes over what it was sent with a Misra-Gries summary of more
   counters than its mass divided by the bar. Summaries of pieces are merged by
   adding counters and taking the largest one that has no room off all. A phrase
   that reaches the bar cannot lose all its count, so every frequent one survives;
3. a second pass over the same lists counts the survivors exactly, numbers those
   that reach the bar and answers the cells.

A phrase's key is the number of its first n - 1 words and that of its last word, so
keys are exact, not hashes. Memory in a partition is bounded by its lists; the lists
shrink fast from level to level, since cells keep only words in frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from banlist.llm import cells
from banlist.llm.cells import STOP, pack, unpack
from banlist.llm.registry import query, table
from banlist.llm.workers import ship, slices
from banlist.session import write_table

ship(__name__)

_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_SPELL = bytes.maketrans(
    bytes(range(65, 91)) + b"\t" + _ENDS, bytes(range(97, 123)) + b" " + STOP * len(_ENDS)
)
# Word numbers are below 2**31, phrase numbers below 2**32.
WORD_BITS = 31

_CELLS = "cell long, lang string, n long, total long, tokens binary, words binary, counts binary"
# A cell's words and the frequent phrases that begin there, and what it asks about.
_STATE = "cell long, lang string, n long, tokens binary, grams binary, keys binary, counts binary"
_ASKED = "cell long, lang string, part long, keys binary, counts binary"
_WORDS = "cell long, lang string, part long, words binary, counts binary, places binary"
# To a cell: the keys (of words: places) that are frequent and their numbers. To the
# result (cell null): key, number and count of each.
_FOUND = "cell long, lang string, words binary, keys binary, numbers binary, counts binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of texts of one language."""
    schema, numbers = cells.arrow_schema(_CELLS), cells.Numbers()
    for batch in slices(batches, "t", rows=1 << 20, size=cells.CELL_BYTES):
        rows = []
        for lang in batch.column(0).unique().to_pylist():
            texts = batch.column(1).filter(pc.equal(batch.column(0), lang)).cast(pa.binary()).to_pylist()
            joined = b"\n".join((t or b"").translate(_SPELL) for t in texts).replace(STOP, b" \n ")
            words, at = cells.tokens(joined)
            stop = words.index(pa.scalar(STOP, pa.binary())).as_py()
            counts = np.bincount(at, minlength=len(words)).astype(np.int64)
            if stop >= 0:  # leave it out of the list
                words = pa.concat_arrays([words[:stop], words[stop + 1 :]])
                counts = np.delete(counts, stop)
                at = np.where(at == stop, -1, at - (at > stop)).astype(np.int32)
            if len(words):
                packed = (pack(at), cells.pack_words(words), pack(counts))
                rows.append((numbers.take(), lang, len(words), int(counts.sum()), *packed))
        yield cells.batch(schema, rows)


def _ask_words(parts: int):
    schema = cells.arrow_schema(_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, lang, blob, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words, counts = cells.unpack_words(blob), unpack(packed, np.int64)
                yield cells.batch(
                    schema,
                    [
                        (cell, lang, part, cells.pack_words(words.take(pa.array(at))), pack(counts[at]), pack(at.astype(np.int32)))
                        for part, at in cells.by_part(cells.word_owners(words, parts))
                    ],
                )

    return run


def numbered(n: int, part: int, parts: int, bits: int) -> np.ndarray:
    """Numbers for n frequent entries of a part that no other part gives."""
    if n and (n - 1) * parts + part >= 1 << bits:
        raise OverflowError(f"over 2**{bits} frequent phrases of one length: raise the bar")
    return np.arange(n, dtype=np.uint64) * np.uint64(parts) + np.uint64(part)


def _count_words(bar: int, parts: int):
    schema = cells.arrow_schema(_FOUND)

    def run(key: tuple, asked: pa.Table) -> pa.Table:
        lang, part = key[0].as_py(), key[1].as_py()
        words = [cells.unpack_words(b) for b in asked.column("words").to_pylist()]
        counts = [unpack(b, np.int64) for b in asked.column("counts").to_pylist()]
        encoded = pa.concat_arrays(words).dictionary_encode()
        entries = encoded.indices.to_numpy()
        total = np.bincount(entries, np.concatenate(counts), len(encoded.dictionary)).astype(np.int64)
        often = np.flatnonzero(total >= bar)
        often = often[np.argsort(-total[often], kind="stable")]  # small numbers pack best
        number = np.zeros(len(total), np.uint64)
        number[often] = numbered(len(often), part, parts, WORD_BITS)
        rows, end = [], 0
        for cell, own, where in zip(asked.column("cell").to_pylist(), words, asked.column("places").to_pylist()):
            mine = entries[end : end + len(own)]
            keep = total[mine] >= bar
            rows.append((cell, lang, None, cells.pack_sorted(unpack(where, np.int32)[keep].astype(np.uint64)), pack(number[mine[keep]]), None))
            end += len(own)
        if len(often):
            names = cells.pack_words(encoded.dictionary.take(pa.array(often)))
            rows.append((None, lang, names, None, pack(number[often]), pack(total[often])))
        return pa.Table.from_batches([cells.batch(schema, rows)])

    return run


class Summary:
    """Misra-Gries counters of keys, in sorted arrays. Summaries of parts of a stream
    merge: what is taken off a counter is below mass / (room + 1) in all."""

    def __init__(self, room: int) -> None:
        self.room = room
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, where = np.unique(np.append(self.keys, keys), return_inverse=True)
        counts = np.bincount(where, np.append(self.counts, counts), len(keys)).astype(np.int64)
        if len(keys) > self.room:
            off = np.partition(counts, len(counts) - self.room - 1)[len(counts) - self.room - 1]
            left = counts > off
            keys, counts = keys[left], counts[left] - off
        self.keys, self.counts = keys, counts


def _count_phrases(bar: int, parts: int):
    schema = cells.arrow_schema(_FOUND)

    def run(key: tuple, asked: pa.Table) -> pa.Table:
        lang, part = key[0].as_py(), key[1].as_py()
        lists, mass = asked.select(["cell", "keys", "counts"]).to_pylist(), 0
        for r in lists:
            r["counts"] = unpack(r["counts"], np.int64)
            mass += int(r["counts"].sum())
        summary = Summary(mass // bar + 1)
        for r in lists:
            summary.merge(cells.unpack_sorted(r["keys"]), r["counts"])
        alive, total = summary.keys, np.zeros(len(summary.keys), np.int64)
        for r in lists:
            own = cells.unpack_sorted(r["keys"])
            at = np.searchsorted(own, alive)
            at[at == len(own)] = 0
            hit = own[at] == alive
            total[hit] += r["counts"][at[hit]]
        often = total >= bar
        keys, total = alive[often], total[often]
        number, rows = np.empty(len(keys), np.uint64), []
        number[np.argsort(-total, kind="stable")] = numbered(len(keys), part, parts, 32)
        for r in lists:
            mine = np.isin(keys, cells.unpack_sorted(r["keys"]), assume_unique=True)
            rows.append((r["cell"], lang, None, cells.pack_sorted(keys[mine]), pack(number[mine]), None))
        if len(keys):
            rows.append((None, lang, None, cells.pack_sorted(keys), pack(number), pack(total)))
        return pa.Table.from_batches([cells.batch(schema, rows)])

    return run


def squeezed(tokens: np.ndarray, grams: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept tokens, with one gap for each run of others."""
    gap = ~keep
    stay = keep | (gap & np.append(False, keep[:-1]))
    return np.where(keep, tokens, -1)[stay], np.where(keep, grams, -1)[stay]


def _state(cell: int, lang: str, tokens: np.ndarray, grams: np.ndarray, length: int) -> pa.Table:
    """A cell's tokens and frequent phrases of ``length`` words, and what it asks about
    phrases of one word more; nothing if there is nothing to ask."""
    rows, at = [], starts(tokens, grams, length)
    if len(at):
        keys, counts = np.unique(key_of(tokens, grams, at, length), return_counts=True)
        # One word's phrases are the words themselves.
        packed = (pack(tokens), None if length == 1 else pack(grams), cells.pack_sorted(keys), pack(counts.astype(np.int64)))
        rows.append((cell, lang, len(keys), *packed))
    return pa.Table.from_batches([cells.batch(cells.arrow_schema(_STATE), rows)])


def starts(tokens: np.ndarray, grams: np.ndarray, length: int) -> np.ndarray:
    """Where two frequent phrases of ``length`` words overlap in all but one word."""
    if len(grams) < 2:
        return np.empty(0, np.int64)
    at = np.flatnonzero((grams[:-1] >= 0) & (grams[1:] >= 0))
    return at[at < len(tokens) - length]


def key_of(tokens: np.ndarray, grams: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    return (grams[at].astype(np.uint64) << np.uint64(WORD_BITS)) | tokens[at + length].astype(np.uint64)


def _ask_phrases(parts: int):
    schema = cells.arrow_schema(_ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, lang, blob, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                keys, counts = cells.unpack_sorted(blob), unpack(packed, np.int64)
                owners = (cells.mixed(keys) % np.uint64(parts)).astype(np.int64)
                rows = [
                    (cell, lang, part, cells.pack_sorted(keys[at]), pack(counts[at]))
                    for part, at in cells.by_part(owners)
                ]
                yield cells.batch(schema, rows)

    return run


def _words_in(cell: pa.Table, found: pa.Table) -> pa.Table:
    """Takes in the answers on words."""
    own = cell.to_pylist()[0]
    number = np.full(own["n"] + 1, -1, np.int64)  # the last place is for gaps
    for r in found.select(["keys", "numbers"]).to_pylist():
        number[cells.unpack_sorted(r["keys"])] = unpack(r["numbers"], np.uint64)
    tokens = number[unpack(own["tokens"], np.int32)]
    tokens, grams = squeezed(tokens, tokens, tokens >= 0)
    return _state(own["cell"], own["lang"], tokens.astype(np.int32), grams, 1)


def _phrases_in(length: int):
    """Takes in the answers on phrases of ``length`` words."""

    def run(cell: pa.Table, found: pa.Table) -> pa.Table:
        own = cell.to_pylist()[0]
        tokens = unpack(own["tokens"], np.int32)
        grams = tokens.astype(np.int64) if own["grams"] is None else unpack(own["grams"], np.int64)
        answers = found.select(["keys", "numbers"]).to_pylist()
        keys = np.concatenate([cells.unpack_sorted(r["keys"]) for r in answers])
        numbers = np.concatenate([unpack(r["numbers"], np.uint64) for r in answers]).astype(np.int64)
        order = np.argsort(keys)
        keys, numbers = keys[order], numbers[order]
        at = starts(tokens, grams, length - 1)
        new = np.full(len(tokens), -1, np.int64)
        if len(keys):
            wanted = key_of(tokens, grams, at, length - 1)
            where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            new[at] = np.where(keys[where] == wanted, numbers[where], -1)
        # The words of frequent phrases stay, with gaps between.
        begins = np.append(new >= 0, np.zeros(length, bool))
        covered = reduce(np.logical_or, (np.roll(begins, k) for k in range(length)))[: len(tokens)]
        tokens, grams = squeezed(tokens, new, covered)
        return _state(own["cell"], own["lang"], tokens.astype(np.int32), grams, length)

    return run


def _unpacked(words: bool):
    """Rows of the frequent entries: of words with their spelling, of phrases with the
    numbers of their first words and of their last."""
    kinds = [pa.string(), pa.int64(), pa.string() if words else pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                number, count = unpack(r["numbers"], np.uint64), unpack(r["counts"], np.int64)
                if words:
                    name, last = cells.unpack_words(r["words"]).cast(pa.string()), np.zeros(len(number), np.int64)
                else:
                    keys = cells.unpack_sorted(r["keys"])
                    name = (keys >> np.uint64(WORD_BITS)).astype(np.int64)
                    last = (keys & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
                columns = [[r["lang"]] * len(number), number.astype(np.int64), name, last, count]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "id", "first", "last", "f"]
                )

    return run


def frequent(docs: DataFrame, text: str, group: str, longest: int, bar: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, n)``, the words of each group, and ``(lang, len, phrase, f)``: all phrases
    of 1 to ``longest`` words that occur ``bar`` times in their group, words apart by blanks."""
    group_col = F.coalesce(F.col(group).cast("string"), F.lit("und"))
    rows = docs.select(group_col.alias("lang"), F.col(text).alias("t"))
    own = write_table(rows.mapInArrow(_read, _CELLS), "phrase-cells")
    sizes = own.groupBy("lang").agg(F.sum("total").alias("n"))
    parts = cells.part_count(own, "n")
    asked = own.select("cell", "lang", "words", "counts").mapInArrow(_ask_words(parts), _WORDS)
    found = write_table(asked.groupBy("lang", "part").applyInArrow(_count_words(bar, parts), _FOUND), "phrase-words")
    totals = found.where(F.col("cell").isNull())
    named = totals.mapInArrow(_unpacked(True), "lang string, id long, first string, last long, f long")
    words = write_table(named.select("lang", "id", F.col("first").alias("phrase"), "f"), "frequent-words")
    levels, known, join = [words.select("lang", F.lit(1).alias("len"), "phrase", "f")], words, _words_in
    state = own.select("cell", "lang", "n", "tokens")
    for length in range(2, longest + 1):
        answers = found.where(F.col("cell").isNotNull()).groupBy("cell")
        state = write_table(state.groupBy("cell").cogroup(answers).applyInArrow(join, _STATE), "phrase-state")
        parts = cells.part_count(state, "n")
        asked = state.select("cell", "lang", "keys", "counts").mapInArrow(_ask_phrases(parts), _ASKED)
        counted = asked.groupBy("lang", "part").applyInArrow(_count_phrases(bar, parts), _FOUND)
        found = write_table(counted, "phrase-counts")
        totals = found.where(F.col("cell").isNull())
        keyed = totals.mapInArrow(_unpacked(False), "lang string, id long, first long, last long, f long")
        heads = known.select("lang", F.col("id").alias("first"), F.col("phrase").alias("head"))
        tails = words.select("lang", F.col("id").alias("last"), F.col("phrase").alias("tail"))
        spelt = keyed.join(heads, ["lang", "first"]).join(tails, ["lang", "last"])
        known = write_table(
            spelt.select("lang", "id", F.concat_ws(" ", "head", "tail").alias("phrase"), "f"), "frequent-phrases"
        )
        levels.append(known.select("lang", F.lit(length).alias("len"), "phrase", "f"))
        state, join = state.select("cell", "lang", "tokens", "grams"), _phrases_in(length)
    return sizes, reduce(DataFrame.union, levels)


def collocations(
    docs: DataFrame,
    text: str = "text",
    group: str = "lang",
    longest: int = 5,
    bar: int = 100,
    percent: int = 100,
    top: int = 2000,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each group's first ``top`` phrases.

    A phrase of 2 to ``longest`` words that occurs ``a >= bar`` times is scored by its
    weakest cut, ``1000 * a * n / (l * r)`` rounded down, with the counts of the two
    parts and of all words. One that lies in a longer phrase with ``percent`` of its
    count goes: the longer one says it all. A null or empty text has no words, a null group is
    ``und``, repeated rows count as often as they occur, and an empty table gives an
    empty result. Only the two named columns are read, so others cannot clash. A text
    of any length is worked on in memory of some ten times its size.
    """
    sizes, found = frequent(docs, text, group, longest, bar)
    words = F.split("phrase", " ", -1)
    several = found.where("len > 1").withColumn("w", words)
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    # What a longer phrase with enough of its count holds: one word more is enough to
    # look at, as whatever lies between the two has no smaller count.
    ends = [part(F.lit(1), F.col("len") - 1), part(F.lit(2), F.col("len") - 1)]
    inside = several.where("len > 2").select("lang", "f", F.explode(F.array(*ends)).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = several.join(covered, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(percent) * F.col("f"))
    )
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, len - 1)"))).select(
        "lang",
        "phrase",
        F.col("f").alias("a"),
        "k",
        part(F.lit(1), F.col("k")).alias("head"),
        part(F.col("k") + 1, F.col("len") - F.col("k")).alias("tail"),
    )
    counts = found.select("lang", "phrase", "f")
    left = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(18, 0)")
    # Products of three counts: 38 digits hold them. The quotient is below 1000 * n.
    score = F.expr("cast(1000 * a as decimal(20, 0)) * cast(n as decimal(18, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    scored = (
        cuts.join(left, ["lang", "head"])
        .join(right, ["lang", "tail"])
        .join(sizes, "lang")
        .withColumn("score", score)
    )
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (
        weakest.select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


@query(
    "op13_collocations",
    sql="""
with p as (
  select coalesce(lang, 'und') as lang, doc_id,
    unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents
), w as (
  select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from p
), sizes as (
  select lang, cast(sum(len(w)) as bigint) as n from w group by lang
), g as (
  select lang, k as len, array_to_string(w[i : i + k - 1], ' ') as phrase
  from (select lang, w, unnest(range(1, len(w) + 1)) as i from w) s, range(1, 6) t(k)
  where i + k - 1 <= len(w)
), f as (
  select lang, len, phrase, count(*) as f from g group by all having count(*) >= 100
), inside as (
  select a.lang, a.phrase from f a join f b
    on a.lang = b.lang and b.len = a.len + 1 and 100 * b.f >= 100 * a.f
    and contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ')
  where a.len > 1
), c as (
  select f.lang, f.phrase, f.f as a, k, s.n, l.f as l, r.f as r,
    (1000::hugeint * f.f * s.n) // (l.f::hugeint * r.f) as score
  from f join sizes s using (lang), range(1, 5) t(k), f l, f r
  where f.len > 1 and k < f.len
    and l.lang = f.lang and l.phrase = array_to_string(string_split(f.phrase, ' ')[1 : k], ' ')
    and r.lang = f.lang and r.phrase = array_to_string(string_split(f.phrase, ' ')[k + 1 :], ' ')
    and not exists (select 1 from inside i where i.lang = f.lang and i.phrase = f.phrase)
), best as (
  select * from c qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
  phrase, a, l, r, n, cast(score as bigint) as score
from best qualify rank <= 2000
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
