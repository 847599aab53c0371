"""Byte-pair pieces of tokens, and texts to ids and back."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banlist.functions.arrays import let
from banlist.functions.text import unwords, words
from banlist.operators.lookup import count_keys, fits_broadcast, lookup
from banlist.operators.pair_merge import fits_table, merge_pieces
from banlist.operators.rule_places import with_places
from banlist.session import spread, write_table

# Tokens up to this length are merged by array expressions inside the JVM.
# Longer ones (rare junk) have too many places for that and use a heap.
ARRAY_MERGE_CHARS = 256
# Characters of the texts, or eight times their ids, that one block of rows holds, about.
BLOCK_CHARS = 8_000_000


def _unique(merges: DataFrame) -> DataFrame:
    return merges.groupBy("l", "r").agg(F.max("merge_rank").alias("merge_rank"))


def _rules(unique: DataFrame) -> DataFrame:
    """Merge rules by product, each marked ``safe`` or not.

    A rule is safe when no rule of a better rank uses its product: merging it
    never opens a better merge. All rules of a learned table are safe.
    """
    first_use = (
        unique.select(F.explode(F.array("l", "r")).alias("product"), "merge_rank")
        .groupBy("product")
        .agg(F.min("merge_rank").alias("first_use"))
    )
    return (
        unique.withColumn("product", F.concat("l", "r"))
        .join(first_use, "product", "left")
        .select(
            "product",
            F.length("l").alias("split"),
            "merge_rank",
            F.coalesce(F.col("first_use") > F.col("merge_rank"), F.lit(True)).alias("safe"),
        )
    )


def _applies(cuts: Column, p: Column) -> Column:
    """Are a, b and c neighbours among the cuts?"""
    at = F.array_position(cuts, p["b"]).cast("int")
    return (F.get(cuts, at - 2) == p["a"]) & (F.get(cuts, at) == p["c"])


def _merge_step(state: Column) -> Column:
    """Merge the best place; drop the places that can no longer apply."""
    cuts, places = state["cuts"], state["places"]

    def merge(best: Column) -> Column:
        gone = best["b"]
        merged = F.struct(
            F.array_remove(cuts, gone).alias("cuts"),
            F.filter(
                places, lambda p: (p["a"] != gone) & (p["b"] != gone) & (p["c"] != gone)
            ).alias("places"),
        )
        done = F.struct(cuts.alias("cuts"), F.slice(places, 1, 0).alias("places"))
        return F.when(best.isNotNull(), merged).otherwise(done)

    return let(F.get(F.filter(places, lambda p: _applies(cuts, p)), F.lit(0)), merge)


def _array_cuts(length: Column, places: Column) -> Column:
    """Cut positions left in a token, by array expressions alone."""
    whole = F.sequence(F.lit(0), length)

    # Safe rules only: no merge opens a better one, so going through the
    # places once, best rank first and left to right, is the greedy order.
    def take(cuts: Column, p: Column) -> Column:
        return F.when(_applies(cuts, p), F.array_remove(cuts, p["b"])).otherwise(cuts)

    # Otherwise look for the best place anew after every merge.
    start = F.struct(whole.alias("cuts"), places.alias("places"))
    rounds = F.slice(places, F.lit(1), F.greatest(length - 1, F.lit(0)))
    stepwise = F.aggregate(rounds, start, lambda state, _: _merge_step(state))["cuts"]
    return F.when(
        F.forall(places, lambda p: p["safe"]), F.aggregate(places, whole, take)
    ).otherwise(stepwise)


def _heap_cuts(length: Column, places: Column) -> Column:
    # Everything the batch function uses is nested in here, so that it travels
    # with the function and executors need no copy of this package.
    def cuts_of(n: int, places) -> list[int]:
        from heapq import heapify, heappop, heappush

        # The places of a token that has no need of the heap are null.
        if places is None:
            return []
        rank = {(p["a"], p["b"], p["c"]): p["rank"] for p in places}
        before = list(range(-1, n))
        behind = list(range(1, n + 2))
        waiting = [(r, *place) for place, r in rank.items() if place[2] - place[0] == 2]
        heapify(waiting)
        alive = [True] * (n + 1)
        while waiting:
            _, a, b, c = heappop(waiting)
            if not (alive[a] and alive[b] and alive[c] and behind[a] == b and behind[b] == c):
                continue
            alive[b] = False
            behind[a], before[c] = c, a
            for place in ((before[a], a, c), (a, c, behind[c])):
                if place in rank:
                    heappush(waiting, (rank[place], *place))
        return [i for i in range(n + 1) if alive[i]]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def batch(lengths: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([cuts_of(n, p) for n, p in zip(lengths, places)])

    return batch(length, places)


def decompose(
    tokens: DataFrame,
    merges: DataFrame,
    array_chars: int = ARRAY_MERGE_CHARS,
    keep: Sequence[str] = (),
    method: str = "auto",
) -> DataFrame:
    """``(token, pieces, depth)`` of distinct tokens, with the columns to keep.

    The pieces are what greedy merging leaves: always the best-ranked adjacent
    pair, the leftmost on ties. ``depth`` counts the merges.

    A rule list of checked size goes to the tasks as numbers (``method="table"``), and
    tokens are merged where they are, without a shuffle. A longer one is joined
    (``"join"``): the stretches of a token that some rule produces are found where its
    starts meet the rules with the same beginning (`rule_places`), for the whole table at
    once; the merges of one token then only touch that token's own places. Either takes tokens over ``array_chars`` characters
    one by one on a heap.
    """
    if method not in ("auto", "table", "join"):
        raise ValueError(f"unknown method: {method}")
    tokens = tokens.select("token", *keep).where(F.col("token").isNotNull())
    if method == "table" or (method == "auto" and fits_table(merges)):
        return merge_pieces(spread(tokens), _unique(merges), keep, array_chars).select("token", *keep, "pieces", "depth")
    rules = write_table(_rules(write_table(_unique(merges), "merge-rules")), "rule-products")
    n = F.length("token")
    short = n <= array_chars
    cut = with_places(tokens, rules).withColumn(
        "cuts",
        F.when(short, _array_cuts(n, F.col("places"))).otherwise(
            _heap_cuts(F.when(short, 0).otherwise(n), F.when(~short, F.col("places")))
        ),
    )
    cuts = F.col("cuts")
    pieces = F.transform(
        F.slice(cuts, F.lit(1), F.size(cuts) - 1),
        lambda x, i: F.substring(F.col("token"), x + 1, F.get(cuts, i + 1) - x),
    )
    return cut.select(
        "token",
        *keep,
        pieces.alias("pieces"),
        (n - F.size(cuts) + 1).cast("bigint").alias("depth"),
    )


def merge_depth(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """``(token, token_id, depth, is_leaf)``; a leaf here is a token inside
    which no merge applies."""
    depths = decompose(vocab, merges, keep=["token_id"]).select("token", "token_id", "depth")
    return depths.withColumn("is_leaf", F.col("depth") == 0)


def token_ids(
    tokens: DataFrame, vocab: DataFrame, merges: DataFrame, unknown_id: int | None = None
) -> DataFrame:
    """``(token, ids)``: a known token has its own id, any other the ids of its
    pieces. Pieces outside the vocabulary get ``unknown_id``, or are dropped."""
    ids = vocab.select("token", "token_id")
    small = fits_broadcast(ids, "token")
    distinct = tokens.select("token").distinct()
    table = F.broadcast(ids) if small else ids
    # Both sides have each token once, so no key is hot.
    known = distinct.join(table, "token").select("token", F.array("token_id").alias("ids"))
    unknown = distinct.join(table, "token", "left_anti")
    return known.unionByName(_piece_ids(unknown, ids, merges, unknown_id, small))


def _piece_ids(
    tokens: DataFrame, ids: DataFrame, merges: DataFrame, unknown_id: int | None, small: bool
) -> DataFrame:
    pieces = decompose(tokens, merges).select(
        F.col("token").alias("__word"), F.posexplode("pieces").alias("__at", "token")
    )
    piece_ids = lookup(pieces, ids, "token", small=small)
    place = F.struct(
        "__at", F.coalesce("token_id", F.lit(unknown_id).cast("bigint")).alias("id")
    )
    ordered = F.sort_array(F.collect_list(place))["id"]
    return piece_ids.groupBy(F.col("__word").alias("token")).agg(
        F.filter(ordered, lambda i: i.isNotNull()).alias("ids")
    )


def encode(
    texts: DataFrame,
    key: str,
    text: str,
    vocab: DataFrame,
    merges: DataFrame,
    unknown_id: int | None = None,
) -> DataFrame:
    """``(key, ids)`` of each text, by byte-pair pieces of its words.

    Each distinct word is decomposed once, however often it occurs.
    """
    counted = texts.select(F.explode(words(text)).alias("token"))
    distinct = write_table(count_keys(counted, "token"), "words")
    ids = vocab.select("token", "token_id")
    word_ids = write_table(
        _piece_ids(distinct, ids, merges, unknown_id, fits_broadcast(ids, "token")), "word-ids"
    )
    return _ids_of_words(texts, key, text, word_ids)


def encode_words(texts: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """``(key, ids)`` of texts all of whose words are vocabulary tokens."""
    return _ids_of_words(texts, key, text, vocab.select("token", F.array("token_id").alias("ids")))


def _ids_of_words(texts: DataFrame, key: str, text: str, table: DataFrame) -> DataFrame:
    """The ids of each text's words one after another, by ``(token, ids)``.

    The texts are dealt out by key before they are split, so a text's words stay where
    they are when the table is broadcast.
    """
    if not fits_broadcast(table, "token", "ids"):
        size = F.length(text)
        values = table.groupBy(F.col("token").alias("item")).agg(F.flatten(F.sort_array(F.collect_list("ids"))).alias("value"))
        return _answered(texts, key, size, [text], {"ids": words(text)}, values)
    occurrences = _by_key(texts, key, text).select(key, F.posexplode_outer(words(text)).alias("at", "token"))
    found = lookup(occurrences, table, "token", small=True)
    # The group is one text: its ids in the order of its words.
    places = F.sort_array(
        F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("at", "ids")))
    )
    return found.groupBy(key).agg(F.flatten(places["ids"]).alias("ids"))


def _by_key(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """The rows dealt out by key while they are compact: what is made of a row
    is grouped again without another shuffle."""
    return rows.select(key, *columns).repartition(key)


def _answered(
    rows: DataFrame,
    key: str,
    size: Column,
    columns: list[str],
    items: dict[str, Column],
    values: DataFrame,
    unknown: list[str] | None = None,
) -> DataFrame:
    """``(key, name...)``: the values of each array's items one after another.

    ``items`` maps the new columns to arrays made of ``columns``, ``size`` tells how long
    they are, and ``values`` is ``(item, value)`` of any number of distinct items; values
    are arrays of ids or texts, or with ``unknown``, which stands for an item that is null or
    has no value, arrays of texts. The rows are dealt out in blocks. A block asks once for
    each of its distinct items, so an item is no row for each place it is at, and one
    that is everywhere is as many rows as there are blocks. Rows of one key are one.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    total = rows.agg(F.sum(size)).first()[0] or 0
    blocks = max(2 * cores, total // BLOCK_CHARS + 1)
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("__block")
    dealt = rows.select(block, key, *columns).repartition("__block").select(
        "__block", key, *[array.alias(name) for name, array in items.items()]
    )
    every = F.flatten(F.array_compact(F.array(*items)))
    # Distinct where they are: the rows of a block are in one partition.
    asked = dealt.select("__block", F.explode(every).alias("item")).where("item is not null").distinct()
    answers = asked.join(values, "item").select(F.col("__block").alias("__asking"), "item", "value")
    own = values.schema["value"].dataType
    kinds = ", ".join(f"`{name}` {own.simpleString()}" for name in items)
    names = list(items)

    # Nested, so that executors need no copy of this package.
    def run(asking: pa.Table, found: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow.compute as pc

        asking, found = asking.combine_chunks(), found.combine_chunks()
        keys = pc.dictionary_encode(asking.column(1), null_encoding="encode").combine_chunks()
        of_row = keys.indices.to_numpy().astype(np.int64)
        n_keys = len(keys.dictionary)
        known, value = found.column("item"), found.column("value").combine_chunks()
        if unknown is not None:
            value = pa.concat_arrays([value, pa.array([unknown], value.type)])
        out = [keys.dictionary]
        for name in names:
            listed = asking.column(name).combine_chunks()
            sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy().astype(np.int64)
            place = pc.index_in(listed.flatten(), value_set=known, skip_nulls=True)
            if unknown is not None:
                place = pc.fill_null(place, len(known))
            there = place.is_valid().to_numpy(zero_copy_only=False)
            place = place.drop_null().to_numpy().astype(np.int64)
            group = np.repeat(of_row, sizes)[there]
            if n_keys < len(of_row):
                at = (np.arange(len(there)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[there]
                plain = value.to_pylist()
                rank = np.empty(len(plain), np.int64)
                rank[sorted(range(len(plain)), key=plain.__getitem__)] = np.arange(len(plain))
                order = np.lexsort((rank[place], at, group))
                place, group = place[order], group[order]
            taken = value.take(pa.array(place))
            if pa.types.is_list(taken.type):
                group = np.repeat(group, pc.list_value_length(taken).to_numpy())
                taken = taken.flatten()
            ends = np.cumsum(np.bincount(group, minlength=n_keys))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), taken)
            out.append(pc.binary_join(lists, "") if pa.types.is_string(value.type) else lists)
        return pa.Table.from_arrays(out, [key, *names])

    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, {kinds}"
    return dealt.groupBy("__block").cogroup(answers.groupBy("__asking")).applyInArrow(run, schema)


def decode(
    rows: DataFrame,
    key: str,
    columns: dict[str, str],
    vocab: DataFrame,
    skip_ids: DataFrame | None = None,
) -> DataFrame:
    """``(key, text...)``: the texts that id arrays spell.

    ``columns`` maps id column -> text column; all are decoded in one pass.
    ``skip_ids`` (``token_id``) names special tokens to leave out.
    """
    table = vocab.select("token_id", "token")
    if skip_ids is not None:
        table = table.join(skip_ids.select("token_id"), "token_id", "left_anti")
    if not fits_broadcast(table, "token"):
        size = sum((F.coalesce(F.size(ids), F.lit(0)) * 8 for ids in columns), F.lit(0))
        values = table.groupBy(F.col("token_id").alias("item")).agg(
            F.array_join(F.sort_array(F.collect_list("token")), "").alias("value")
        )
        items = {out: F.col(ids).cast("array<bigint>") for ids, out in columns.items()}
        joined = _answered(rows, key, size, list(columns), items, values.withColumn("item", F.col("item").cast("bigint")))
        return joined.select(key, *[unwords(F.array(out)).alias(out) for out in columns.values()])
    slots = F.array(
        *[
            F.struct(F.lit(out).alias("slot"), F.col(ids).alias("ids"))
            for ids, out in columns.items()
        ]
    )
    places = (
        _by_key(rows, key, *columns).select(key, F.inline(slots))
        .select(key, "slot", F.posexplode_outer("ids").alias("at", "token_id"))
    )
    found = lookup(places, table, "token_id", small=True)

    def text_of(slot: str) -> Column:
        own = F.when(
            (F.col("slot") == slot) & F.col("token").isNotNull(), F.struct("at", "token")
        )
        return unwords(F.sort_array(F.collect_list(own))["token"]).alias(slot)

    return found.groupBy(key).agg(*[text_of(slot) for slot in columns.values()])
