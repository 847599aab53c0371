"""Sharding over fixed virtual slots.

A record belongs to one of a fixed number of slots by the hash of its key, its
text's checksum and its size, for ever; so rows that share a key, or have none,
spread over all slots. A versioned map, one row per slot, says which shard a
slot is in. Bytes and rows are added up per slot, and only the map is edited to
even out the shards or to add one: version 0 deals the slots round robin, a
later version moves whole slots and leaves the others where they are. A map can
be kept as a table, to which each edit of its newest version adds one.

The law that holds is ``bytes``: sizes are near equal. After an edit, two
shards differ by no more than the largest slot that is in the fuller one, so
the more slots per shard, the closer. All work on records is one pass for the
sums, one for the places; the map itself has a fixed number of rows whatever
the data's size, and is edited in one row by array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from banlist.llm.registry import query, table
from banlist.session import write_table

SLOTS = 4096
OVERHEAD = 16


def virtual_slot(*record: str, slots: int = SLOTS) -> Column:
    """The slot of a record by the columns that tell it from others; nulls take part."""
    return F.pmod(F.xxhash64(*record), F.lit(slots)).cast("int")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(key, size, text_crc32, virtual_slot)`` per record: UTF-8 bytes of the
    text plus a fixed overhead, and the text's checksum. A null text has no bytes."""
    raw = F.coalesce(F.col(text), F.lit(""))
    records = docs.select(
        F.col(key),
        (F.octet_length(raw) + F.lit(OVERHEAD)).cast("bigint").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
    )
    return records.withColumn("virtual_slot", virtual_slot(key, "text_crc32", "size", slots=slots))


def slot_loads(records: DataFrame) -> DataFrame:
    """``(slot, bytes, rows)`` of the slots that have records."""
    return records.groupBy(F.col("virtual_slot").alias("slot")).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt round robin."""
    return spark.range(slots).select(
        F.lit(0).cast("bigint").alias("version"),
        F.col("id").cast("int").alias("slot"),
        F.pmod("id", F.lit(shards)).cast("int").alias("shard"),
    )


def edit_map(current: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: move slots until the shards are near equal.

    Slots are taken by falling size. A slot stays where it is while its shard
    would hold no more than an equal share; the others then go, largest first,
    to the shard that holds least. Shards that the map does not have yet are
    empty and so are filled in this way; ``shards`` may only grow. Slots
    without records keep their shard. ``loads`` may lack slots; ties go to the
    lower slot and the lower shard, so the result is the same on every run.
    """
    known = current.select("version", "slot", "shard").join(
        F.broadcast(loads.select("slot", "bytes")), "slot", "left"
    )
    item = F.struct(
        (-F.coalesce("bytes", F.lit(0))).alias("less"), F.col("slot"), F.col("shard"), F.lit(False).alias("stays")
    )
    # One row with an array of all slots: their number is fixed, not the data's.
    whole = known.agg(
        F.max("version").alias("version"), F.array_sort(F.collect_list(item)).alias("slots")
    ).where(F.size("slots") > 0)
    bytes_of = lambda s: -s["less"]
    share = F.aggregate("slots", F.lit(0).cast("bigint"), lambda total, s: total + bytes_of(s)) / F.lit(shards)
    empty = F.array_repeat(F.lit(0).cast("bigint"), shards)

    def add(held: Column, shard: Column, size: Column) -> Column:
        return F.transform(held, lambda h, i: F.when(i == shard, h + size).otherwise(h))

    nothing = F.expr("cast(array() as array<struct<less:bigint,slot:int,shard:int,stays:boolean>>)")
    state = F.struct(empty.alias("held"), nothing.alias("kept"), nothing.alias("loose"), share.alias("share"))

    def stay(acc: Column, s: Column) -> Column:
        fits = (acc["held"][s["shard"]] + bytes_of(s)) <= acc["share"]
        one = F.array(s)
        return F.struct(
            F.when(fits, add(acc["held"], s["shard"], bytes_of(s))).otherwise(acc["held"]).alias("held"),
            F.when(fits, F.concat(acc["kept"], one)).otherwise(acc["kept"]).alias("kept"),
            F.when(fits, acc["loose"]).otherwise(F.concat(acc["loose"], one)).alias("loose"),
            acc["share"].alias("share"),
        )

    def move(acc: Column, s: Column) -> Column:
        to = (F.array_position(acc["held"], F.array_min(acc["held"])) - 1).cast("int")
        moved = F.struct(s["less"].alias("less"), s["slot"].alias("slot"), to.alias("shard"), F.lit(True).alias("stays"))
        return F.struct(
            add(acc["held"], to, bytes_of(s)).alias("held"),
            F.concat(acc["kept"], F.array(moved)).alias("kept"),
            acc["loose"].alias("loose"),
        )

    staying = whole.select("version", F.aggregate("slots", state, stay).alias("s"))
    ended = staying.select(
        "version",
        F.aggregate(
            "s.loose",
            F.struct(F.col("s.held").alias("held"), F.col("s.kept").alias("kept"), nothing.alias("loose")),
            move,
        ).alias("s"),
    )
    return ended.select((F.col("version") + 1).alias("version"), F.explode("s.kept").alias("e")).select(
        "version", F.col("e.slot").alias("slot"), F.col("e.shard").alias("shard")
    )


def latest(maps: DataFrame) -> DataFrame:
    """The rows of the newest version of a stored map."""
    return maps.where(F.col("version") == maps.agg(F.max("version")).scalar())


def place(records: DataFrame, loads: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard, virtual_slot)``.

    ``slot`` is a record's place in its shard, gapless from 0: the records of
    the shard's earlier virtual slots come first, those of one virtual slot by
    key, checksum and size. Only these columns are shuffled, not the texts.
    """
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slot_map.join(F.broadcast(loads.select("slot", "rows")), "slot", "left")
        .withColumn("start", F.coalesce(F.sum(F.coalesce("rows", F.lit(0))).over(before), F.lit(0)))
        .select(F.col("slot").alias("virtual_slot"), "shard", "start")
    )
    inside = Window.partitionBy("virtual_slot").orderBy(F.col(key).asc_nulls_last(), "text_crc32", "size")
    return (
        records.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "virtual_slot")
        .select(
            key,
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("place")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
        )
    )


def stored_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of the map kept at ``path``; None where there is none yet."""
    place_ = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place_.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place_):
        return None
    schema = "slot int, shard int, version bigint"
    return latest(spark.read.schema(schema).parquet(path)).select("version", "slot", "shard")


def keep_map(edited: DataFrame, path: str) -> None:
    """Add a version to the map kept at ``path``; earlier versions stay. Saving a
    version again replaces it."""
    writer = edited.repartition(1).write.partitionBy("version")  # one row per slot
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def shard(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None
) -> DataFrame:
    """Place all records in ``shards`` shards by a map that is edited once: version
    0, or the newest version of the map kept at ``map_path``, to which the edited
    one is then added.

    An empty table has no places. Repeated rows are rows of their own; a null key
    takes part as a value, and a null text has no bytes. Very long texts are only
    measured where they are read. Other columns are ignored, whatever their names. The
    sums and the map are written once below the checkpoint folder.
    """
    records = sized(docs, key, text, slots)
    loads = write_table(slot_loads(records), "slot-loads")
    current = stored_map(docs.sparkSession, map_path) if map_path else None
    if current is None:
        current = first_map(docs.sparkSession, shards, slots)
    edited = write_table(edit_map(current, loads, shards), "slot-map")
    if map_path:
        keep_map(edited, map_path)
    return place(records, loads, edited, key)


@query("op3_virtual_slot_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 40)
