"""Document fingerprints that add up: a homomorphic hash of the paragraphs.

Each paragraph is hashed to a wide vector of small signed numbers, and a
document's fingerprint is the sum of its paragraphs' vectors, each lane modulo
2^32. The order of paragraphs does not matter, and a paragraph is inserted or
deleted by adding or subtracting its vector (`plus`, `minus`).

A paragraph's vector is itself a sum: of the whole paragraph's, and of one for
each of its pieces, which are sentences cut into a few words from their start.
So a paragraph that is changed in one place keeps most of its vector, also where
it is the only one.

Equal multisets of paragraphs have equal fingerprints; different ones agree by
chance only if all lanes do. The difference of two fingerprints is the sum over
the units in which the documents differ, and the mean square of its lanes
grows with their number. That gives `likeness`, an estimate of the cosine
between the two multisets of paragraphs and pieces: 1 for equal ones, about 0 for
unrelated ones. A paragraph of less than about eight words is one or two pieces,
so a text that is nothing else has little in common with its edited form.

Everything is column functions; fingerprints need no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from banlist.llm.registry import query, table

LANES = 64
_MASK = (1 << 32) - 1
# Two entries of 16 bits, each with room for the sum over so many units.
_PAIR = 0x0000FFFF0000FFFF
PACKED_UNITS = 32_000
# A lane's entry is uniform between -2^15 and 2^15 - 1; this is its mean square.
_MEAN_SQUARE = ((1 << 32) - 1) / 12 + 0.25
# Ranges of keys for `with_next`; their bounds are one array on the driver.
MOST_RANGES = 32_768
# A piece ends behind a sentence or so many words; a run without blanks is cut at RUN_CHARS.
PIECE_WORDS = 4
RUN_CHARS = 64
_CUT = "\x01"
# Only ASCII in the classes: others make Java's matching ten times slower.
_INNER, _STOP = r"[^\s.!?]", r"[.!?]"
# No part is tried twice from one place, so the time grows with the text alone.
_PIECE = (
    rf"((?:{_INNER}{{1,{RUN_CHARS}}}+\s++){{{PIECE_WORDS - 1}}}{_INNER}{{0,{RUN_CHARS}}}+{_STOP}*+"
    rf"|{_INNER}{{{RUN_CHARS}}}|{_INNER}{{0,{RUN_CHARS - 1}}}+{_STOP}++)\s?"
)


def paragraphs(text: Column) -> Column:
    """The non-empty lines of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: p != "")


def units(text: Column) -> Column:
    """What is hashed of a text, as ``(whole, text)``: its paragraphs, and the
    pieces that are not a paragraph by themselves. A piece is told apart from a paragraph
    of the same words."""

    def of_one(paragraph: Column) -> Column:
        found = F.split(F.regexp_replace(paragraph, F.lit(_PIECE), F.lit("$1" + _CUT)), _CUT, -1)
        pieces = F.transform(
            F.filter(found, lambda p: (p != "") & (p != paragraph)),
            lambda p: F.struct(F.lit(0).alias("whole"), p.alias("text")),
        )
        return F.array_append(pieces, F.struct(F.lit(1).alias("whole"), paragraph.alias("text")))

    return F.flatten(F.transform(paragraphs(text), of_one))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(_MASK)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(_MASK)))


def empty(lanes: int = LANES) -> Column:
    return F.array_repeat(F.lit(0).cast("bigint"), lanes)


def _sums(hashes: Column, lanes: int) -> Column:
    """The lanes' sums over hashed units, two in one number; each entry is 2^15 too
    high, and of at most PACKED_UNITS units no sum reaches the next lane or the sign."""
    slots = F.array(*[F.lit(i) for i in range(1, lanes // 2 + 1)])
    return F.aggregate(
        hashes,
        empty(lanes // 2),
        lambda acc, h: F.zip_with(acc, slots, lambda x, i: x + F.xxhash64(h["a"], h["b"], i).bitwiseAND(F.lit(_PAIR))),
    )


def vector(text: Column, lanes: int = LANES) -> Column:
    """The fingerprint of a whole text; of an empty or null one all zeros."""
    hashes = F.transform(
        units(text),
        lambda u: F.struct(F.xxhash64(u["whole"], u["text"]).alias("a"), F.xxhash64(u["whole"] + 2, u["text"]).alias("b")),
    )

    def total(all_: Column) -> Column:
        last = F.greatest(F.floor((F.size(all_) - 1) / PACKED_UNITS).cast("int"), F.lit(0))
        parts = F.transform(
            F.sequence(F.lit(0), last), lambda k: _sums(F.slice(all_, k * PACKED_UNITS + 1, F.lit(PACKED_UNITS)), lanes)
        )
        apart = lambda p: F.flatten(
            F.transform(p, lambda x: F.array(x.bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(x, 32)))
        )
        sums = F.aggregate(parts, empty(lanes), lambda acc, p: F.zip_with(acc, apart(p), lambda x, y: x + y))
        # The shift to signed entries, and the modulus, are left to the end.
        return F.transform(sums, lambda x: (x - F.size(all_).cast("bigint") * 0x8000).bitwiseAND(F.lit(_MASK)))

    # Named by a lambda, so that texts are cut and hashed once.
    return F.element_at(F.transform(F.array(hashes), total), 1)


def as_hex(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _square(fingerprint: Column) -> Column:
    """Estimated squared length of the multiset: the lanes' mean square."""
    signed = F.transform(
        fingerprint, lambda x: F.when(x >= (1 << 31), x - (1 << 32)).otherwise(x).cast("double")
    )
    total = F.aggregate(signed, F.lit(0.0), lambda acc, x: acc + x * x)
    return total / F.size(fingerprint) / F.lit(_MEAN_SQUARE)


def likeness(a: Column, b: Column) -> Column:
    """Between 0 and 1, from two fingerprints alone. Equal ones give 1, also two
    empty ones; an empty and a non-empty one give 0. The estimate's standard
    error is about ``1 / sqrt(lanes)``."""
    parts = F.array(F.struct(_square(a).alias("a"), _square(b).alias("b"), _square(minus(a, b)).alias("d")))
    cosine = F.transform(
        parts, lambda s: (s["a"] + s["b"] - s["d"]) / F.nullif(2 * F.sqrt(s["a"] * s["b"]), F.lit(0.0))
    )
    bounded = F.least(F.greatest(F.coalesce(F.element_at(cosine, 1), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(a == b, F.lit(1.0)).otherwise(bounded)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, v, next_text, next_v)``: each document beside the next one by
    falling key, the first one following the last.

    Rows are cut into ranges of keys of about equal size, so texts are shuffled
    once; the first row of a range is copied to the end of the one before it.
    Equal keys are ordered by a hash of their texts; null keys come last.
    An empty table stays empty.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ranges = min(MOST_RANGES, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = [k / ranges for k in range(1, ranges)]
    accuracy = max(10_000, 4 * ranges)
    found = slim.agg(F.percentile_approx("key", steps, accuracy).alias("b")).first()["b"]
    bounds = sorted(set(found or []))
    if bounds:
        # Binary search: how many bounds lie below the key.
        place = F.aggregate(
            F.sequence(F.lit(0), F.lit(len(bounds).bit_length() - 1)),
            F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
            lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
                F.when(
                    F.element_at(F.col("bounds"), ((s["lo"] + s["hi"]) / 2).cast("int") + 1) < F.col("key"),
                    F.struct((((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi")),
                ).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))
            ),
        )["lo"]
    else:
        place = F.lit(0)
    # Ranges are numbered in reading order: falling keys, nulls at the end.
    number = F.when(F.col("key").isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - place)
    keyed = (
        slim.withColumn("bounds", F.lit(bounds).cast("array<bigint>"))
        .withColumn("range", number)
        .drop("bounds")
        .withColumn("tie", F.xxhash64("text"))
    )
    first = F.min(F.struct((~F.col("key").isNotNull()).alias("none"), F.bitwise_not("key").alias("falling"), F.col("tie")))
    heads = sorted(
        (r["range"], r["first"]["falling"], r["first"]["tie"])
        for r in keyed.groupBy("range").agg(first.alias("first")).collect()
    )
    if heads:
        before = [(r, f, t, heads[k - 1][0]) for k, (r, f, t) in enumerate(heads)]
        copies = spark.createDataFrame(before, "range int, falling bigint, tie bigint, to int")
        ghosts = (
            keyed.withColumn("falling", F.bitwise_not("key"))
            .join(
                F.broadcast(copies.withColumnRenamed("falling", "f")),
                (F.col("f").eqNullSafe(F.col("falling"))) & (keyed["tie"] == copies["tie"]) & (keyed["range"] == copies["range"]),
            )
            .select(keyed["key"], "text", F.col("to").alias("range"), keyed["tie"], F.lit(True).alias("ghost"))
            # Repeated rows give the same copy more than once; one is enough.
            .dropDuplicates(["range"])
        )
        keyed = keyed.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    else:
        keyed = keyed.withColumn("ghost", F.lit(False))
    order = Window.partitionBy("range").orderBy("ghost", F.col("key").desc_nulls_last(), "tie")
    return (
        keyed.withColumn("v", vector(F.col("text")))
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_v", F.lead("v").over(order))
        .where(~F.col("ghost"))
        .select(F.col("key").alias(key), F.col("text").alias(text), "v", "next_text", "next_v")
    )


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the code points, rounded down, replaced by as many of
    the next text's first ones (or all of them)."""
    own, other = F.coalesce(text, F.lit("")), F.coalesce(next_text, F.lit(""))
    n = F.length(own)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(own, F.lit(1), n - half), F.substring(other, F.lit(1), half))


@query("op10_paragraph_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents"))
    changed = docs.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn(
        "edited_v", vector(F.col("edited"))
    )
    return changed.select(
        "doc_id",
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("v")).alias("fingerprint"),
        as_hex(F.col("edited_v")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("edited_v")).alias("near_edited"),
        likeness(F.col("v"), F.col("next_v")).alias("near_next"),
    )
