"""From raw documents to packed training sequences.

``STAGES`` are applied in order. Each takes ``(spark, docs, sf_dir)``, works on
all rows that its predecessor kept, and its result is written as Parquet below
the checkpoint folder and read again as the next one's ``docs``. All but the last
return the columns of ``docs``; none of them shuffles texts to drop rows, as rows
are marked by their numbers in the scan (`banlist.llm.row_marks`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from banlist.llm import exact_dedup, near_dedup, packing, toxicity
from banlist.session import write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of those whose texts are equal but for white space."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at 0.8 or more."""
    return near_dedup.without_near_duplicates(docs, words=5)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers

    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
    return packing.pack(cut, ["doc_id", "piece", "start", "ids_crc32"])


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

# A trained classifier, MinHash groups and a packing are beyond SQL; the stages
# are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
