"""Does a text contain any token of a list?

Two physical forms give the same answer; the size of the list picks one.

* A list of checked size becomes one regular expression, with the tokens'
  common beginnings shared. Each text is read once, inside the JVM, with no
  join and no shuffle, and the cost hardly grows with the list.
* A longer list is joined on stretches of the texts: broadcast while its size
  allows, else shuffled with the hot stretches salted.

A needle that holds another one is found only where that one is, so a long list is
first rid of such needles, on the executors. What is left may fit a pattern again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banlist.functions.text import normalise_for_containment, strip_space_marker
from banlist.operators.lookup import fits_broadcast, lookup
from banlist.session import write_table

PATTERN_TOKENS = 100_000
PATTERN_CHARS = 1_500_000
# Beginnings may fork at every character, and forks nest.
PATTERN_DEPTH = 300
# Chunks are short: finding a place in a text takes time that grows with it.
# A list asked for as patterns that is over so many of them is joined.
PATTERNS = 4
# Short needles that one pass over the others looks for.
SHORT_NEEDLES = 10_000
_CHUNK_CHARS = 128
_HEAD_CHARS = 6
_PLACE = ("key", "slot", "c")


def normalised_tokens(tokens: DataFrame, token: str = "token", normalise: str = "reference") -> DataFrame:
    """The distinct search texts (``needle``) of a token list.

    ``reference`` compares tokens as they are spelled (lower case, stripped),
    so a token with a word-start marker never matches plain text. ``bare``
    drops the marker first.
    """
    if normalise not in ("reference", "bare"):
        raise ValueError(f"unknown normalisation: {normalise}")
    text = strip_space_marker(token) if normalise == "bare" else F.col(token)
    return tokens.select(normalise_for_containment(text).alias("needle")).distinct()


def any_of_pattern(needles: Iterable[str]) -> str:
    """A pattern that is found where any of the texts begins."""
    shared: dict = {}
    for needle in needles:
        branch = shared
        for char in needle:
            branch = branch.setdefault(char, {})
        branch[""] = {}

    def spell(branch: dict) -> str:
        # Follow single continuations in a loop: only real forks nest.
        text = ""
        while "" not in branch and len(branch) == 1:
            ((char, branch),) = branch.items()
            text += re.escape(char)
        if "" in branch:
            return text
        forks = (re.escape(char) + spell(rest) for char, rest in sorted(branch.items()))
        return f"{text}(?:{'|'.join(forks)})"

    return spell(shared)


def contains_any(text: Column, needles: list[str]) -> Column:
    """Containment test against a list held in the plan."""
    if not needles:
        return F.when(text.isNotNull(), F.lit(False))
    if "" in needles:  # a token without characters is part of every text
        return F.when(text.isNotNull(), F.lit(True))
    return any_true([text.rlike(any_of_pattern(part)) for part in _pattern_parts(needles)] + [
        F.contains(text, F.lit(n)) for n in needles if len(n) > PATTERN_DEPTH
    ])


def any_true(tests: list[Column]) -> Column:
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def _pattern_parts(needles: list[str]) -> list[list[str]]:
    """Neighbours in order, so that beginnings are still shared, in parts that
    each keep the bounds of one pattern."""
    parts: list[list[str]] = []
    chars = 0
    for needle in sorted(n for n in needles if len(n) <= PATTERN_DEPTH):
        if not parts or len(parts[-1]) >= PATTERN_TOKENS or chars + len(needle) > PATTERN_CHARS:
            parts.append([])
            chars = 0
        parts[-1].append(needle)
        chars += len(needle)
    return parts


def _sizes(needles: DataFrame) -> tuple[int, int, int, int]:
    """How many needles, their characters, those of the longest, and the empty ones."""
    size = F.length("needle")
    return tuple(
        needles.agg(
            F.count(F.lit(1)),
            F.coalesce(F.sum(size), F.lit(0)),
            F.coalesce(F.max(size), F.lit(0)),
            F.count_if(F.col("needle") == ""),
        ).first()
    )


def _fit(n: int, chars: int, longest: int, patterns: int = 1) -> bool:
    return n <= patterns * PATTERN_TOKENS and chars <= patterns * PATTERN_CHARS and longest <= PATTERN_DEPTH


def _without_longer(needles: DataFrame) -> DataFrame:
    """The needles found in the same texts, without those that hold a short one.

    Each pass takes the shortest needles left as one pattern and drops the others that hold
    one of them. Passes go on while they halve the list, until it fits a pattern.
    """
    spark = needles.sparkSession
    size = F.length("needle")
    kept = spark.createDataFrame([], "needle string")
    left, n = needles.where("needle is not null"), _sizes(needles)[0]
    while True:
        able = left.where(size <= PATTERN_DEPTH)
        short = [r[0] for r in able.orderBy(size, "needle").limit(SHORT_NEEDLES).collect()]
        if not short:
            return kept.unionByName(left)
        kept = kept.unionByName(spark.createDataFrame([(t,) for t in short], "needle string"))
        left = write_table(left.where(~contains_any(F.col("needle"), short)), "needles-left")
        before, (n, chars, longest, _) = n, _sizes(left)
        if _fit(n, chars, longest) or 2 * n > before:
            return kept.unionByName(left)


def _cut_chunks(numbered: DataFrame, longest: int) -> DataFrame:
    """Chunk ``c`` of each text, with the overlap a stretch of ``longest`` needs."""
    start = F.col("c") * _CHUNK_CHARS + 1
    size = F.lit(_CHUNK_CHARS + longest - 1)
    return numbered.select(*_PLACE, F.substring("text", start, size).alias("chunk"))


def _stretches(chunks: DataFrame, lengths: list[int]) -> DataFrame:
    """The stretches of the given lengths that begin in a chunk's own part."""
    longest = max(lengths)
    starts = F.sequence(F.lit(1), F.least(F.length("chunk"), F.lit(_CHUNK_CHARS)))
    tails = chunks.withColumn("i", F.explode(starts)).select(
        *_PLACE, F.substring("chunk", F.col("i"), F.lit(longest)).alias("tail")
    )
    # At the end of a text a stretch may come out shorter. It is still part of
    # the text, so a match is a match.
    pieces = F.array(*[F.substring("tail", 1, n) for n in lengths])
    return tails.select(*_PLACE, F.explode(pieces).alias("needle"))


def _hits_by_join(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(key, slot) of the texts that contain a needle, by two equi-joins.

    Short stretches find the needles' beginnings first. Only the chunks in
    which a long needle begins are searched for whole long needles.
    """
    small = fits_broadcast(needles, "needle")
    size = F.length("needle")
    head = F.substring("needle", 1, _HEAD_CHARS)
    heads = needles.groupBy(head.alias("needle")).agg(
        F.max(size <= _HEAD_CHARS).alias("whole"), F.max(size > _HEAD_CHARS).alias("longer")
    )
    lengths = sorted(r[0] for r in needles.select(size).distinct().collect())
    short = sorted({min(n, _HEAD_CHARS) for n in lengths})
    long = [n for n in lengths if n > _HEAD_CHARS]

    count = F.ceil(F.length("text") / _CHUNK_CHARS).cast("int")
    # A text is few bytes and much work: a file's few splits are dealt out to all cores.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = texts.where(F.col("text") != "").repartition(tasks, "key", "slot").withColumn(
        "c", F.explode(F.sequence(F.lit(0), count - 1))
    )
    chunks = _cut_chunks(numbered, max(short))
    begun = lookup(_stretches(chunks, short), heads, "needle", how="inner", small=small)
    places = begun.groupBy(*_PLACE).agg(
        F.max("whole").alias("whole"), F.max("longer").alias("longer")
    )
    if not long:
        return places.where("whole").select("key", "slot").distinct()
    places = write_table(places, "containment-places")
    hits = places.where("whole").select("key", "slot").distinct()
    open_places = places.where("longer and not whole").join(hits, ["key", "slot"], "left_anti")
    again = texts.join(open_places.select(*_PLACE), ["key", "slot"])
    more = lookup(
        _stretches(_cut_chunks(again, max(long)), long),
        needles.where(size > _HEAD_CHARS),
        "needle",
        how="inner",
        small=small,
    )
    return hits.unionByName(more.select("key", "slot").distinct())


def flag_contained(
    df: DataFrame,
    columns: Mapping[str, str],
    tokens: DataFrame,
    key: str,
    token: str = "token",
    normalise: str = "reference",
    method: str = "auto",
) -> DataFrame:
    """Add one boolean column per text column: does it contain a listed token?

    ``columns`` maps text column -> flag column; ``key`` is unique per row.
    ``method`` is ``auto``, ``pattern`` or ``join``. Either takes a long list without the
    needles that hold others; asked for as patterns, one that is still over ``PATTERNS``
    of them is joined, as it would not pass through the driver.
    """
    if method not in ("auto", "pattern", "join"):
        raise ValueError(f"unknown method: {method}")
    needles = write_table(normalised_tokens(tokens, token, normalise), "needles")
    n, chars, longest, empties = _sizes(needles)
    if not empties and not _fit(n, chars, longest):
        needles = write_table(_without_longer(needles), "shortest-needles")
        n, chars, longest, _ = _sizes(needles)
    if empties or (method != "join" and _fit(n, chars, longest, PATTERNS if method == "pattern" else 1)):
        listed = [""] if empties else [r[0] for r in needles.collect()]
        return df.withColumns(
            {
                flag: contains_any(normalise_for_containment(text), listed)
                for text, flag in columns.items()
            }
        )
    slots = F.array(
        *[
            F.struct(F.lit(flag).alias("slot"), normalise_for_containment(text).alias("text"))
            for text, flag in columns.items()
        ]
    )
    texts = df.select(F.col(key).alias("key"), F.inline(slots)).where(F.col("text").isNotNull())
    hits = _hits_by_join(texts, needles)
    flags = hits.groupBy(F.col("key").alias(key)).agg(
        *[F.max(F.col("slot") == flag).alias(f"__{flag}") for flag in columns.values()]
    )
    joined = df.join(flags, key, "left")
    for text, flag in columns.items():
        hit = F.coalesce(F.col(f"__{flag}"), F.lit(False))
        joined = joined.withColumn(flag, F.when(F.col(text).isNotNull(), hit)).drop(f"__{flag}")
    return joined


def keep_containing(
    df: DataFrame, text: str, tokens: DataFrame, key: str, **options
) -> DataFrame:
    """The rows whose text contains a listed token (an existence join)."""
    flagged = flag_contained(df, {text: "__hit"}, tokens, key, **options)
    return flagged.where("__hit").drop("__hit")
