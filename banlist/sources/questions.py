"""Question tables from CSV, JSON or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.operators.ranking import first_k, with_index

QUESTION_COLUMNS = ["question", "correct_answer", "chain_of_thought", "difficulty", "category"]


def read_questions_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Question rows, by column name, blanks as empty text.

    ``multi_line=False`` lets Spark split large files; use it when no quoted
    value holds a line break.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("inferSchema", False)
        .csv(path)
    )
    return raw.select([F.coalesce(F.col(c), F.lit("")).alias(c) for c in QUESTION_COLUMNS])


def read_word_problems(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """``(question, answer, ...)`` rows with ``correct_answer`` copied from ``answer``."""
    return with_correct_answer(spark.read.format(file_format).load(path))


def with_correct_answer(df: DataFrame) -> DataFrame:
    return df.withColumn("correct_answer", F.coalesce(F.col("answer"), F.lit("")))


def head_rows(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    return first_k(df, [F.asc(idx)], n)


def with_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of one part of a dataset, ``train`` or ``test``, named as such."""
    if split not in ("train", "test"):
        raise ValueError(f"unknown split: {split}")
    return df.withColumn("split", F.lit(split))


def read_word_problem_splits(spark: SparkSession, paths: dict[str, str], file_format: str = "parquet") -> DataFrame:
    """The parts of a dataset in one table with ``split``; paths by split name."""
    parts = [with_split(read_word_problems(spark, path, file_format), split) for split, path in paths.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def with_row_index(df: DataFrame, *order: str) -> DataFrame:
    """Rows numbered from 0 by a unique order.

    Only the order columns are sorted and written; the others are joined back.
    """
    keys = [F.col(c).alias(f"__{c}") for c in order]
    numbered = with_index(df.select(*keys), [f"__{c}" for c in order], "idx")
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(numbered, same).drop(*(f"__{c}" for c in order))
