"""Row numbers and top-k over a whole table without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banlist.session import write_table

# monotonically_increasing_id() keeps the partition number above bit 33.
_POSITION_BITS = 33
# Up to this many rows per partition go to the one task that merges the heads.
_SORTED_HEAD_ROWS = 10_000


def with_index(
    df: DataFrame, order: Sequence[Column | str], name: str = "idx", start: int = 0
) -> DataFrame:
    """Number the rows 0, 1, 2, ... by a unique order.

    The rows are range-partitioned and sorted, and written with their place
    inside the partition. The partition sizes (one number per partition) give
    each partition its offset, so no task sees more than its own range.
    """
    position = f"__{name}_position"
    placed = write_table(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(position, F.monotonically_increasing_id()),
        f"index-{name}",
    )
    partition = F.shiftright(F.col(position), _POSITION_BITS).cast("int")
    sizes = placed.groupBy(partition.alias("p")).count().collect()
    by_partition = {row["p"]: row["count"] for row in sizes}
    offsets, seen = [], start
    for p in range(max(by_partition, default=-1) + 1):
        offsets.append(seen)
        seen += by_partition.get(p, 0)
    if not offsets:
        return placed.withColumn(name, F.lit(None).cast("bigint")).drop(position)
    table = F.lit(offsets).cast("array<bigint>")
    within = F.col(position) - F.shiftleft(partition.cast("bigint"), _POSITION_BITS)
    return placed.withColumn(name, F.get(table, partition) + within).drop(position)


def first_k(df: DataFrame, order: Sequence[Column], k: int | None) -> DataFrame:
    """The first k rows by a unique order; all rows when k is None.

    A small k is Spark's TakeOrderedAndProject. A larger one would make a
    single task merge k rows of every partition, so it is cut by the
    distributed row number.
    """
    if k is None:
        return df
    if k < 0:
        raise ValueError("k must not be negative")
    if k <= _SORTED_HEAD_ROWS:
        return df.orderBy(*order).limit(k)
    return with_index(df, order, "__rank").where(F.col("__rank") < k).drop("__rank")
