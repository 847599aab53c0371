"""Removing banned tokens from stored token sequences when the list is a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banlist.functions.arrays import drop_banned, first_marker_position
from banlist.functions.fixed_values import STOP_MARKERS
from banlist.operators.lookup import lookup

LITERAL_TOKENS = 10_000


def drop_banned_by_table(
    df: DataFrame, key: str, tokens: str, banned: DataFrame, out: str = "kept"
) -> DataFrame:
    """``df`` with ``out``: its token array without the tokens of ``banned``.

    A list that fits a literal is a filter on the array. A longer one is an
    equi-join of the tokens, hot tokens salted. Both give the same: copies of a
    token all stay or all go, emptied arrays are empty arrays, a null array
    stays null and a null element stays.
    """
    listed = banned.select("token").distinct()
    head = [r[0] for r in listed.limit(LITERAL_TOKENS + 1).collect()]
    if len(head) <= LITERAL_TOKENS:
        return df.withColumn(out, drop_banned(tokens, head))
    placed = df.select(key, F.posexplode_outer(tokens).alias("at", "token"))
    marked = lookup(placed, listed.withColumn("__banned", F.lit(True)), "token")
    stays = F.col("__banned").isNull() & F.col("at").isNotNull()
    kept = marked.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(stays, F.struct("at", "token"))))["token"].alias(out)
    )
    joined = df.join(kept, key, "left")
    return joined.withColumn(out, F.when(F.col(tokens).isNotNull(), F.col(out)))


def drop_banned_until_marker_by_table(
    df: DataFrame,
    key: str,
    tokens: str,
    banned: DataFrame,
    out: str = "kept",
    markers: Sequence[str] = STOP_MARKERS,
) -> DataFrame:
    """The same up to and including the first stop marker only; what follows stays."""
    cut = first_marker_position(tokens, markers)
    parts = df.withColumn("__head", F.slice(tokens, F.lit(1), cut)).withColumn(
        "__tail", F.slice(tokens, cut + 1, F.size(tokens))
    )
    kept = drop_banned_by_table(parts, key, "__head", banned, "__kept")
    return kept.withColumn(out, F.concat("__kept", "__tail")).drop("__head", "__tail", "__kept")
