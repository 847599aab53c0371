"""Input tables derived from the driver's tables, built once per session.

Corpus words give a vocabulary and merge rules; conversations give question
and answer pairs and, by fixed edits, pairs of model outputs.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.functions.text import strip_space_marker, words
from banlist.operators.pieces import encode_words, merge_depth
from banlist.operators.ranking import first_k, with_index
from banlist.operators.selection import TokenTables
from banlist.session import shared_table, spread, write_table
from banlist.sources.vocab import bare_counts, build_vocabulary, prefix_merges

SPECIAL_TOKENS = ["<|endoftext|>", "|||EMAIL_ADDRESS|||"]
K_SHOT = 3
MODEL = "demo-7b-Instruct"
DATASET = "conversations"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_table(
        spark,
        (sf_dir, "vocab"),
        lambda: build_vocabulary(documents(spark, sf_dir, "text"), "text", SPECIAL_TOKENS),
    )


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that builds a word of the vocabulary."""
    return shared_table(spark, (sf_dir, "merges"), lambda: prefix_merges(vocab(spark, sf_dir)))


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_table(
        spark,
        (sf_dir, "depths"),
        lambda: write_table(
            merge_depth(vocab(spark, sf_dir), merges(spark, sf_dir)), "depths"
        ),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(token, pos)`` by bare token: word endings stand in for a tagger."""
    return shared_table(
        spark, (sf_dir, "lexicon"), lambda: write_table(_build_lexicon(spark, sf_dir), "lexicon")
    )


def _build_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = vocab(spark, sf_dir).select(strip_space_marker("token").alias("token")).distinct()
    t = F.col("token")
    return bare.where(t != "").withColumn(
        "pos",
        F.when(F.endswith(t, F.lit("tion")), "NOUN")
        .when(F.endswith(t, F.lit("ed")) | F.endswith(t, F.lit("ing")), "VERB")
        .when(t.between("0", "9~"), "NUM")
        .otherwise("X"),
    )


def token_tables(spark: SparkSession, sf_dir: str) -> TokenTables:
    return TokenTables(
        vocab(spark, sf_dir), merges(spark, sf_dir), lexicon(spark, sf_dir)
    )


def marked_tables(spark: SparkSession, sf_dir: str) -> TokenTables:
    """The same with leaf marks and tags on the vocabulary, made once for all
    queries that ask many criteria."""
    tables = token_tables(spark, sf_dir)
    vocab_ = shared_table(
        spark, (sf_dir, "marked"), lambda: tables.marked(leaf=True, tags=True).vocab
    )
    return replace(tables, vocab=vocab_)


def banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longer ones of the 400 most frequent bare words."""
    return shared_table(
        spark, (sf_dir, "banned"), lambda: write_table(_build_banned(spark, sf_dir), "banned")
    )


def _build_banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bare_counts(vocab(spark, sf_dir))
    frequent = counts.orderBy(F.desc("cnt"), F.asc("token")).limit(400)
    return frequent.where(F.length("token") >= 5).select("token")


def rare(spark: SparkSession, sf_dir: str, k: int | None) -> DataFrame:
    """The k least frequent bare words; all of them without a k."""
    counts = bare_counts(vocab(spark, sf_dir))
    return first_k(counts, [F.asc("cnt"), F.asc("token")], k).select("token")


def _build_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    replied = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("body")
    )
    # Both keys take part, so one long conversation still spreads over tasks.
    pairs = asked.join(replied, ["conv_id", "turn"]).withColumn(
        "answer",
        F.concat("body", F.lit("\n#### "), F.length("body").cast("string")),
    )
    return with_index(pairs, ["conv_id", "turn"], "idx").select(
        "idx",
        "conv_id",
        "turn",
        "question",
        "body",
        "answer",
        F.when(F.col("conv_id") % 3 == 0, "train").otherwise("test").alias("split"),
    )


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_table(spark, (sf_dir, "qa"), lambda: _build_qa(spark, sf_dir))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa(spark, sf_dir).where("split = 'train'")


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa(spark, sf_dir).where("split = 'test'")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs: right, wrong, unmarked and run-on ones by row number."""
    size = F.length("body")
    wrong = F.concat("body", F.lit("\n#### "), (size + 1).cast("string"))
    free = F.when(F.col("idx") % 5 == 0, wrong).when(F.col("idx") % 5 == 1, F.col("body"))
    tail = F.when(F.col("idx") % 7 == 0, F.lit("\nQuestion: again\n#### 9")).otherwise("")
    less = F.replace("body", F.lit("e"), F.lit(""))
    return qa(spark, sf_dir).select(
        "idx",
        "question",
        F.col("answer").alias("correct_answer"),
        F.concat(free.otherwise(F.col("answer")), tail).alias("free_output"),
        F.when(
            F.col("idx") % 3 == 0,
            F.concat(less, F.lit("\n#### "), (size * 2).cast("string")),
        )
        .otherwise(F.concat(less, F.lit("\n####"), size.cast("string")))
        .alias("taboo_output"),
    )


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(idx, variant, response)``: some rows have no verdict."""
    base = qa(spark, sf_dir)
    kind = F.col("idx") % 4
    free = base.select(
        "idx",
        F.lit("free").alias("variant"),
        F.when(kind == 0, F.lit(" yes, it is"))
        .when(kind == 1, F.lit("NO"))
        .when(kind == 2, F.col("body"))
        .alias("response"),
    )
    taboo = base.select(
        "idx",
        F.lit("taboo").alias("variant"),
        F.when(kind == 1, F.lit("YES")).otherwise(F.col("question")).alias("response"),
    )
    return free.unionByName(taboo)


def run_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of all outputs, so that they have ids without loss."""

    def build() -> DataFrame:
        r = runs(spark, sf_dir)
        texts = r.select(F.explode(F.array("free_output", "taboo_output")).alias("text"))
        return build_vocabulary(texts)

    return shared_table(spark, (sf_dir, "run_vocab"), build)


def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(idx, normal, taboo, prompt)`` with id arrays."""

    def build() -> DataFrame:
        r, v = runs(spark, sf_dir), run_vocab(spark, sf_dir)
        normal = encode_words(r, "idx", "free_output", v).withColumnRenamed("ids", "normal")
        taboo = encode_words(r, "idx", "taboo_output", v).withColumnRenamed("ids", "taboo")
        prompt = r.select("idx", F.concat(F.lit("Question: "), "question").alias("prompt"))
        return write_table(normal.join(taboo, "idx").join(prompt, "idx"), "saved-runs")

    return shared_table(spark, (sf_dir, "saved_runs"), build)


def banned_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ids)``: sequences of one to five ids from every third place of the outputs;
    single ids from every tenth output only."""
    places = saved_runs(spark, sf_dir).select("idx", "normal", F.posexplode("normal").alias("at", "id"))
    size = (F.lit(1) + F.floor(F.col("at") / 3) % 5).cast("int")
    cut = places.where("at % 3 = 0").withColumn("n", size).select(
        "idx", "n", F.slice("normal", F.col("at") + 1, F.col("n")).alias("ids")
    )
    whole = cut.where(F.size("ids") == F.col("n"))
    return whole.where("n > 1 or idx % 10 = 0").select("ids").distinct()


def token_array(text: str):
    """Space-separated tokens of an output; newlines count as spaces."""
    return F.split(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), " ", -1)
