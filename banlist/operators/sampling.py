"""Deterministic sampling: the same rows on every run and on any cluster."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banlist.functions.fixed_values import SAMPLE_SEED
from banlist.operators.ranking import first_k, with_index


def sample_rank(seed: int, *keys: Column | str) -> Column:
    """A text whose order shuffles the rows."""
    parts = [F.lit(str(seed))]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def sample_number(seed: int, *keys: Column | str) -> Column:
    """A number from 0 to 2**60 - 1 drawn from the keys."""
    return F.conv(F.substring(sample_rank(seed, *keys), 1, 15), 16, 10).cast("bigint")


def split_head(df: DataFrame, k: int, idx: str = "idx") -> DataFrame:
    """First k rows are the training part, the rest the test part."""
    return df.withColumn("split", F.when(F.col(idx) < k, F.lit("train")).otherwise(F.lit("test")))


def few_shot(df: DataFrame, n: int = 3, seed: int = SAMPLE_SEED, idx: str = "idx") -> DataFrame:
    """n rows for all prompts to share; all rows when there are fewer."""
    return first_k(df, [sample_rank(seed, idx).asc(), F.asc(idx)], n)


def one_row(df: DataFrame, seed: int = SAMPLE_SEED, idx: str = "idx") -> DataFrame:
    return few_shot(df, 1, seed, idx)


def seeded_positions(k: int, size: int, seed: int = SAMPLE_SEED) -> list[int]:
    """The places that Python's seeded sampler takes out of a list of ``size``, in its
    order; all of them, shuffled, when there are fewer than k. They depend on the size alone."""
    return random.Random(seed).sample(range(size), min(k, size))


def few_shot_seeded(df: DataFrame, n: int = 3, seed: int = SAMPLE_SEED, idx: str = "idx") -> DataFrame:
    """``df`` with ``draw``: the rows that Python's seeded sampler takes from the list of
    all rows in the order of ``idx``, which is unique.

    The positions are drawn for the counted number of rows and meet the rows by row
    number; only the keys are numbered. n positions are made on the driver.
    """
    numbered = with_index(df.select(idx), [idx], "__position")
    picks = list(enumerate(seeded_positions(n, numbered.count(), seed)))
    drawn = df.sparkSession.createDataFrame(picks, "draw long, __position long")
    return df.join(numbered.join(drawn, "__position").select(idx, "draw"), idx).select(*df.columns, "draw")


def without_rows(df: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows that equal none of the taken rows in all columns (nulls are equal)."""
    named = taken.select([F.col(c).alias(f"__{c}") for c in df.columns])
    same = F.lit(True)
    for c in df.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(named, same, "left_anti")


def distinct_positions(k: int, size: int, seed: int, key: str) -> Column:
    """k different positions below ``size``, drawn by hash for each key.

    Draw i picks from the first size - k + i + 1 positions; a position drawn
    before is replaced by the last of them, which no earlier draw could reach.
    """
    if k > size:
        raise ValueError("sample larger than the pool")
    if k == 0:
        return F.array().cast("array<bigint>")
    draws = F.sequence(F.lit(size - k), F.lit(size - 1))

    def draw(taken: Column, last: Column) -> Column:
        pick = F.pmod(sample_number(seed, F.col(key), last), last + 1)
        new = F.when(F.array_contains(taken, pick), last.cast("bigint")).otherwise(pick)
        return F.array_append(taken, new)

    return F.aggregate(draws, F.array().cast("array<bigint>"), draw)


def sample_per_row(
    rows: DataFrame,
    pool: DataFrame,
    k: int,
    key: str = "idx",
    seed: int = SAMPLE_SEED,
    pool_key: str = "pool_idx",
) -> DataFrame:
    """``(key, draw, pool columns)``: an own k-sample of the pool for every row.

    Each row draws k positions and meets only those pool rows, by equi-join on
    the position; the draws spread evenly over the pool. Positions follow the
    order of ``pool_key``, and only the keys are numbered, not the pool's texts.
    """
    numbered = with_index(pool.select(pool_key), [pool_key], "__position")
    size = numbered.count()
    drawn = rows.select(
        key, F.posexplode(distinct_positions(k, size, seed, key)).alias("draw", "__position")
    )
    placed = drawn.join(numbered, "__position").drop("__position")
    return placed.join(pool, pool_key).select(key, "draw", *pool.columns)
