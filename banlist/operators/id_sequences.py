"""Bans and stop markers on stored id sequences.

A ban of several ids is one sequence. Sequences are taken out of a row's ids from
left to right: the leftmost match, of those the longest, and on behind it. A short
list is one pattern over the ids as text, with the sequences' common beginnings
shared, applied in the JVM. A longer list is joined: blocks of rows ask, packed, what
begins with their distinct places (`sequence_places`), so no place is a row.

A stop marker is a text. What an id spells is looked up, and the marker is searched
in the running text of a row, so any ids that spell it together are found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banlist.functions.fixed_values import STOP_MARKERS
from banlist.functions.text import unwords
from banlist.operators.lookup import count_keys, fits_broadcast, hot_keys, lookup
from banlist.operators.pieces import _answered
from banlist.operators.rule_places import GROUP_RULES, GROUP_STARTS
from banlist.operators.sequence_places import ANSWERED, ASKED, asking, groups_of, longest_begun, taking
from banlist.session import write_table

# Ids in all sequences of a list that becomes one pattern, and in one of them.
PATTERN_IDS = 50_000
PATTERN_LENGTH = 20
# Ids in all grams of one block of rows, about.
BLOCK_IDS = 4_000_000
_METHODS = ("auto", "pattern", "join")


def _sequences(banned: DataFrame, ids: str) -> DataFrame:
    """Distinct sequences with at least one id; one with a null among them never matches."""
    usable = (F.size(ids) > 0) & ~F.exists(ids, lambda i: i.isNull())
    return banned.where(usable).select(F.col(ids).cast("array<bigint>").alias("seq")).distinct()


def sequence_pattern(sequences: Sequence[Sequence[int]]) -> str:
    """A pattern for sequences in a text of ids, each with a blank before it: the
    longest one that begins at a place."""
    shared: dict = {}
    for sequence in sequences:
        branch = shared
        for sign in "".join(f" {i}" for i in sequence):
            branch = branch.setdefault(sign, {})
        branch[""] = {}

    def spell(branch: dict) -> str:
        # Follow single continuations in a loop: only real forks nest.
        text = ""
        while "" not in branch and len(branch) == 1:
            ((sign, branch),) = branch.items()
            text += sign
        # What goes on is tried before an end, which must be the end of an id.
        forks = [sign + spell(rest) for sign, rest in sorted(branch.items()) if sign]
        if "" in branch:
            forks.append("(?![0-9])")
        return f"{text}(?:{'|'.join(forks)})"

    return spell(shared)


def _by_pattern(df: DataFrame, ids: str, sequences: list[list[int]], out: str) -> DataFrame:
    values = F.col(ids)
    if not sequences:
        return df.withColumn(out, values.cast("array<bigint>"))
    # Nulls are kept as a mark that no sequence has.
    spelled = F.transform(values, lambda i: F.concat(F.lit(" "), F.coalesce(i.cast("string"), F.lit("n"))))
    text = F.array_join(spelled, "")
    left = F.regexp_replace(text, F.lit(sequence_pattern(sequences)), F.lit(""))
    parts = F.filter(F.split(left, " ", -1), lambda p: p != "")
    kept = F.transform(parts, lambda p: F.when(p != "n", p.cast("bigint")))
    return df.withColumn(out, F.when(values.isNotNull(), kept))


def _taken(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """``(key, gone)``: the places of the ids that matches take, for rows ``(key, own)``."""
    longest, n_sequences = sequences.agg(F.coalesce(F.max(F.size("seq")), F.lit(1)), F.count(F.lit(1))).first()
    heads = rows.select(F.explode("own").alias("head"))
    counts = write_table(count_keys(heads, "head"), "head-ids")
    n_places = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(4 * tasks, n_places // GROUP_STARTS, n_sequences // GROUP_RULES)
    blocks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, n_places * longest // BLOCK_IDS + 1)
    # What begins with a hot id is spread over several groups.
    hot = write_table(hot_keys(counts, "head", tasks), "hot-keys")  # fewer rows than tasks
    salts = {r["head"]: r["__salts"] for r in hot.collect()}
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "key", "own").repartition("block")
    asked = dealt.groupBy("block").applyInArrow(asking(longest, salts, groups), ASKED)
    begun = (
        sequences.withColumn("head", F.get("seq", F.lit(0)))
        .join(F.broadcast(hot), "head", "left")
        .select(F.explode(groups_of(F.col("seq"), F.coalesce("__salts", F.lit(1)), groups)).alias("group"), "seq")
    )
    answers = asked.groupBy("group").cogroup(begun.groupBy("group")).applyInArrow(longest_begun, ANSWERED)
    kind = rows.schema["key"].dataType.simpleString()
    taken = taking(longest, salts, groups)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(taken, f"key {kind}, gone array<int>")


def _without(df: DataFrame, key: str, ids: str, taken: DataFrame, out: str) -> DataFrame:
    own = F.col(ids).cast("array<bigint>")
    joined = df.join(taken.select(F.col("key").alias(key), F.col("gone").alias("__gone")), key, "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.coalesce("__gone", F.array().cast("array<int>")))
    kept = F.when(F.size(own) > 0, F.transform(stays, lambda i: F.get(own, i))).otherwise(own)
    return joined.withColumn(out, kept).drop("__gone")


def _listed(banned: DataFrame, ids: str, method: str) -> tuple[DataFrame, str]:
    """The written sequences, and how they are to be found."""
    if method not in _METHODS:
        raise ValueError(f"unknown method: {method}")
    sequences = write_table(_sequences(banned, ids), "banned-sequences")
    if method == "auto":
        size = F.coalesce(F.sum(F.size("seq")), F.lit(0)), F.coalesce(F.max(F.size("seq")), F.lit(0))
        total, longest = sequences.agg(*size).first()
        method = "pattern" if total <= PATTERN_IDS and longest <= PATTERN_LENGTH else "join"
    return sequences, method


def drop_banned_sequences(
    df: DataFrame,
    key: str,
    ids: str,
    banned: DataFrame,
    out: str = "kept",
    banned_ids: str = "ids",
    method: str = "auto",
) -> DataFrame:
    """``df`` with ``out``: its id array without the banned sequences.

    ``banned`` holds one id array a row, such as `pieces.token_ids` gives. ``key`` is
    unique. A null array stays null; a null element stays and ends a match.
    """
    sequences, method = _listed(banned, banned_ids, method)
    if method == "pattern":
        return _by_pattern(df, ids, [list(r.seq) for r in sequences.collect()], out)
    rows = df.select(F.col(key).alias("key"), F.col(ids).cast("array<bigint>").alias("own"))
    return _without(df, key, ids, _taken(rows, sequences), out)


def marker_places(
    df: DataFrame,
    key: str,
    ids: str,
    vocab: DataFrame,
    markers: Sequence[str] = STOP_MARKERS,
    whole_token: bool = False,
) -> DataFrame:
    """``df`` with ``marker_end`` and ``ends_on_marker``.

    ``marker_end`` counts the ids up to and including the one that completes the
    first stop marker of the running text; it is null if there is none, or the array is.
    ``ends_on_marker`` says whether the text ends with a marker; never for a null
    array. With ``whole_token`` a marker counts only as the whole text of one id, in
    any spelling. Ids that the vocabulary lacks spell nothing.
    """
    # How a token looks in a text; the markers of words and lines are spelled out.
    spelled = vocab.select("token_id", unwords(F.array("token")).alias("spelled"))
    if fits_broadcast(spelled, "spelled"):
        # Dealt out by key before they are split, so the places of a row stay where they are.
        dealt = df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).repartition("key")
        found = lookup(dealt.select("key", F.posexplode("ids").alias("at", "token_id")), spelled, "token_id", small=True)
        texts = found.groupBy("key").agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("at", F.coalesce("spelled", F.lit("")).alias("s")))), lambda p: p["s"]
            ).alias("spelled")
        )
    else:
        # Each block of rows asks once for each of its ids.
        values = spelled.groupBy(F.col("token_id").cast("bigint").alias("item")).agg(
            F.sort_array(F.collect_list(F.coalesce("spelled", F.lit("")))).alias("value")
        )
        rows = df.select(F.col(key).alias("key"), F.col(ids).cast("array<bigint>").alias("ids"))
        size = F.coalesce(F.size("ids"), F.lit(0)) * 8
        texts = _answered(rows, "key", size, ["ids"], {"spelled": F.col("ids")}, values, unknown=[""])
    listed = [m for m in dict.fromkeys(markers) if m]
    if whole_token:
        at = F.array(*[F.array_position("spelled", F.lit(m)) for m in listed]) if listed else F.array().cast("array<bigint>")
        first = F.array_min(F.filter(at, lambda p: p > 0)).cast("int")
        last = F.coalesce(F.try_element_at("spelled", F.lit(-1)).isin(listed), F.lit(False))
    else:
        text = F.array_join("spelled", "")
        ends = [F.when(F.instr(text, m) > 0, F.instr(text, m) + len(m) - 1) for m in listed]
        end = F.least(F.lit(None).cast("int"), *ends) if listed else F.lit(None).cast("int")
        start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n"))
        walked = F.aggregate(
            "spelled",
            start,
            lambda s, p: F.when(s["chars"] >= F.col("__end"), s).otherwise(
                F.struct((s["chars"] + F.length(p)).alias("chars"), (s["n"] + 1).alias("n"))
            ),
        )["n"]
        texts = texts.withColumn("__end", end)
        first = F.when(F.col("__end").isNotNull(), walked)
        last = F.lit(False)
        for m in listed:
            last = last | F.endswith(text, F.lit(m))
    marked = texts.select(F.col("key").alias(key), first.alias("marker_end"), last.alias("ends_on_marker"))
    joined = df.join(marked, key, "left")
    return joined.withColumn("ends_on_marker", F.coalesce("ends_on_marker", F.lit(False)))


def drop_banned_sequences_until_marker(
    df: DataFrame,
    key: str,
    ids: str,
    banned: DataFrame,
    vocab: DataFrame,
    out: str = "kept",
    markers: Sequence[str] = STOP_MARKERS,
    banned_ids: str = "ids",
    method: str = "auto",
) -> DataFrame:
    """The same up to and including the id that completes the first stop marker of
    the running text; what follows stays. Without a marker all of it is scrubbed."""
    own = F.col(ids).cast("array<bigint>")
    cut = F.coalesce("marker_end", F.size(own))
    head = F.slice(own, F.lit(1), cut)
    sequences, method = _listed(banned, banned_ids, method)
    if method == "join":
        # The heads are read more than once. What lies behind them takes no part.
        marked = marker_places(df.select(key, ids), key, ids, vocab, markers)
        heads = write_table(marked.select(F.col(key).alias("key"), head.alias("own")), "heads")
        return _without(df, key, ids, _taken(heads, sequences), out)
    parts = marker_places(df, key, ids, vocab, markers).select(
        *df.columns, head.alias("__head"), F.slice(own, cut + 1, F.size(own)).alias("__tail")
    )
    kept = _by_pattern(parts, "__head", [list(r.seq) for r in sequences.collect()], "__kept")
    return kept.withColumn(out, F.concat("__kept", "__tail")).drop("__head", "__tail", "__kept")
