"""Vocabulary tables: counted from a corpus, or read from tokenizer JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.functions.text import raw_words, strip_space_marker
from banlist.operators.ranking import first_k, with_index


def count_words(corpus: DataFrame, text: str = "text") -> DataFrame:
    """``(token, cnt)`` over all words of a corpus."""
    occurrences = corpus.select(F.explode(raw_words(text)).alias("token"))
    return occurrences.where(F.col("token") != "").groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))


def build_vocabulary(
    corpus: DataFrame, text: str = "text", specials: Sequence[str] = ()
) -> DataFrame:
    """``(token, cnt, token_id)``: special tokens first, then words by count.

    Words are counted before the shuffle; only distinct words are ranked, by
    range partitions.
    """
    counted = count_words(corpus, text).withColumn("special", F.lit(0))
    if specials:
        counted = counted.where(~F.col("token").isin(list(specials)))
        own = corpus.sparkSession.createDataFrame(
            [(s,) for s in specials], "token string"
        ).select("token", F.lit(0).cast("bigint").alias("cnt"), F.lit(1).alias("special"))
        counted = counted.unionByName(own)
    ranked = with_index(
        counted, [F.desc("special"), F.desc("cnt"), F.asc("token")], "token_id"
    )
    return ranked.select("token", "cnt", "token_id")


def bare_counts(vocab: DataFrame) -> DataFrame:
    """``(token, cnt)`` with the word-start markers dropped and counts added up."""
    return (
        vocab.select(strip_space_marker("token").alias("token"), "cnt")
        .where((F.col("token") != "") & (F.col("cnt") > 0))
        .groupBy("token")
        .agg(F.sum("cnt").alias("cnt"))
    )


def prefix_merges(vocab: DataFrame, n_merges: int | None = None) -> DataFrame:
    """``(l, r, merge_rank)``: the rules that build words letter by letter, all of
    them or the most frequent n_merges."""
    # A rule never outranks the shorter rules it extends, so no product among
    # the first n_merges rules is longer than n_merges + 1 characters.
    last = F.length("token") - 1
    steps = F.sequence(F.lit(1), last if n_merges is None else F.least(last, F.lit(n_merges)))
    rules = (
        vocab.where((F.col("cnt") > 0) & (F.length("token") > 1))
        .withColumn("i", F.explode(steps))
        .select(
            F.substring("token", F.lit(1), F.col("i")).alias("l"),
            F.substring("token", F.col("i") + 1, F.lit(1)).alias("r"),
            "cnt",
        )
        .groupBy("l", "r")
        .agg(F.sum("cnt").alias("weight"))
    )
    order = [F.desc("weight"), F.length("l").asc(), F.asc("l"), F.asc("r")]
    best = first_k(rules, order, n_merges)
    return with_index(best, order, "merge_rank").select("l", "r", "merge_rank")


def read_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """``(token, token_id)`` from a tokenizer file, added tokens included."""
    raw = (
        spark.read.schema(
            "model struct<vocab:map<string,bigint>>, "
            "added_tokens array<struct<id:bigint,content:string>>"
        )
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(path)
    )
    own = raw.select(F.explode("model.vocab").alias("token", "token_id"))
    added = raw.select(F.inline("added_tokens")).select(
        F.col("content").alias("token"), F.col("id").alias("token_id")
    )
    return own.unionByName(added).groupBy("token").agg(F.max("token_id").alias("token_id"))
