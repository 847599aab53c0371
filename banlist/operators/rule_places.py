"""Where in tokens may rules of any number apply?

Each start in a token is one short row: what follows it, up to the longest product that
begins alike. Rows and products meet by their first characters, and all products that a
row begins with come out of one walk, so no stretch of a token is a row of its own.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banlist.operators.lookup import count_keys, hot_keys, lookup
from banlist.session import write_table

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How much of a product's beginning tells where it is looked for.
HEAD_CHARS = 3
# Products and starts that one group holds, about.
GROUP_RULES = 100_000
GROUP_STARTS = 500_000
_FOUND = "id bigint, a int, ranks array<bigint>, codes array<bigint>"


def _codes(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts one after another, where each begins, how many it has."""
    listed = texts.to_pylist()
    lengths = np.fromiter(map(len, listed), np.int64, len(listed))
    codes = np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32).astype(np.int64)
    return codes, np.cumsum(lengths) - lengths, lengths


def begun_with(texts: tuple, products: tuple) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (text, product) of which the text begins with the product, shorter products
    first. Either side is its signs one after another, where each begins, how many it has.
    Both are walked together, a sign a step; equal beginnings have one number."""
    signs_t, at_t, n_t = texts
    signs_p, at_p, n_p = products
    of_t, of_p = np.zeros(len(n_t), np.int64), np.zeros(len(n_p), np.int64)
    live_t, live_p = np.arange(len(n_t)), np.arange(len(n_p))
    found_t, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = 0
    while True:
        live_t, live_p = live_t[n_t[live_t] > step], live_p[n_p[live_p] > step]
        if not (len(live_t) and len(live_p)):
            return np.concatenate(found_t), np.concatenate(found_p)
        known, number = np.unique(of_p[live_p] << 32 | signs_p[at_p[live_p] + step], return_inverse=True)
        own = of_t[live_t] << 32 | signs_t[at_t[live_t] + step]
        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
        same = known[place] == own
        live_t, place = live_t[same], place[same]
        of_t[live_t], of_p[live_p] = place, number
        begun = np.zeros(len(known), bool)
        begun[place] = True
        live_p = live_p[begun[number]]
        step += 1
        whole = live_p[n_p[live_p] == step]
        whole = whole[np.argsort(of_p[whole], kind="stable")]
        low = np.searchsorted(of_p[whole], place)
        many = np.searchsorted(of_p[whole], place, side="right") - low
        found_t.append(np.repeat(live_t, many))
        first = np.cumsum(many) - many
        found_p.append(whole[np.arange(many.sum()) - np.repeat(first - low, many)])


def _search(starts: pa.Table, rules: pa.Table) -> pa.Table:
    text, product = begun_with(_codes(starts.column("rest")), _codes(rules.column("product")))
    order = np.argsort(text, kind="stable")
    text, product = text[order], product[order]
    rows, counts = np.unique(text, return_counts=True)
    ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    lists = [
        pa.ListArray.from_arrays(ends, pa.array(rules.column(c).to_numpy()[product].astype(np.int64)))
        for c in ("merge_rank", "code")
    ]
    own = starts.select(["id", "a"]).take(pa.array(rows))
    return pa.table([*own.columns, *lists], names=["id", "a", "ranks", "codes"])


def with_places(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct rows of ``tokens`` with ``places``, in order of rank, where any of the rules
    ``(product, split, merge_rank, safe)`` may apply: it joins characters [a, b) with [b, c)."""
    # Starts travel by the token's number, not its text.
    numbered = write_table(tokens.distinct().withColumn("__id", F.monotonically_increasing_id()), "tokens")
    n = F.length("token")
    starts = (
        numbered.where(n > 1)
        .select(F.col("__id").alias("id"), "token", F.explode(F.sequence(F.lit(0), n - 2)).alias("a"))
        .withColumn("head", F.substring("token", F.col("a") + 1, F.lit(HEAD_CHARS)))
    )
    counts = write_table(count_keys(starts, "head"), "start-heads")
    size = F.length("product")
    code = (F.shiftleft(F.col("split").cast("bigint"), 32) + size) * 2 + F.col("safe").cast("int")
    coded = rules.select("product", "merge_rank", code.alias("code"))
    # A product shorter than a head goes to every head that begins with it.
    shorter = coded.where(size < HEAD_CHARS).join(
        counts.select("head", F.substring("head", 1, HEAD_CHARS - 1).alias("product")), "product"
    )
    longer = coded.where(size >= HEAD_CHARS).withColumn("head", F.substring("product", 1, HEAD_CHARS))
    by_head = longer.unionByName(shorter.select(*longer.columns))
    reach = write_table(by_head.groupBy("head").agg(F.max(size).alias("reach"), F.count(F.lit(1)).alias("n_rules")), "rule-heads")
    n_starts = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_rules = reach.agg(F.coalesce(F.sum("n_rules"), F.lit(0))).first()[0]
    tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(4 * tasks, n_starts // GROUP_STARTS, n_rules // GROUP_RULES)
    # Starts of a hot head are spread over several groups, which all get its rules.
    hot = F.broadcast(write_table(hot_keys(counts, "head", tasks), "hot-keys"))
    salts = F.coalesce("__salts", F.lit(1))

    def group(salt: Column) -> Column:
        return F.pmod(F.xxhash64(F.col("head"), salt), F.lit(groups)).cast("int")

    sent = (
        lookup(starts, reach.select("head", "reach"), "head", how="inner", counts=counts)
        .join(hot, "head", "left")
        .withColumn("group", group(F.pmod(F.xxhash64("id", "a"), salts).cast("int")))
        .select("group", "id", "a", F.substring("token", F.col("a") + 1, F.col("reach")).alias("rest"))
    )
    asked = (
        by_head.join(hot, "head", "left")
        .withColumn("group", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), salts - 1), group))))
        .select("group", "product", "merge_rank", "code")
    )
    found = sent.groupBy("group").cogroup(asked.groupBy("group")).applyInArrow(_search, _FOUND)

    def places(start: Column) -> Column:
        def place(rank: Column, code: Column) -> Column:
            size = F.shiftright(code, 1).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
            split = F.shiftright(code, 33).cast("int")
            return F.struct(
                rank.alias("rank"),
                start["a"].alias("a"),
                (start["a"] + split).alias("b"),
                (start["a"] + size).alias("c"),
                (code % 2 == 1).alias("safe"),
            )

        return F.zip_with(start["ranks"], start["codes"], place)

    # The group is one token: its row and its starts, which meet in one shuffle.
    start = F.struct("a", "ranks", "codes")
    row = numbered.select(F.col("__id").alias("id"), F.struct(*tokens.columns).alias("own"))
    kind = found.select(start.alias("start")).schema["start"].dataType
    both = found.select("id", start.alias("start"), F.lit(None).cast(row.schema["own"].dataType).alias("own")).unionByName(
        row.select("id", F.lit(None).cast(kind).alias("start"), "own")
    )
    grouped = both.groupBy("id").agg(F.first("own", ignorenulls=True).alias("own"), F.collect_list("start").alias("starts"))
    return grouped.select("own.*", F.sort_array(F.flatten(F.transform("starts", places))).alias("places"))
