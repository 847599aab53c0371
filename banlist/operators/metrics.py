"""Scoring pairs of constrained and free outputs, and the metrics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banlist.functions.text import (
    final_answer,
    judge_says_yes,
    marked_answer,
    number_matches,
    parse_int,
    verdict,
)
from banlist.operators.containment import flag_contained
from banlist.operators.pieces import decode
from banlist.operators.prompts import full_answer, text_or_empty


def attach_verdicts(runs: DataFrame, judge: DataFrame | None, idx: str = "idx") -> DataFrame:
    """Add ``judge_taboo`` and ``judge_free`` from ``(idx, variant, response)``.

    One row per prompt comes out; a missing response is a missing verdict.
    """
    if judge is None:
        nothing = F.lit(None).cast("boolean")
        return runs.withColumns({"judge_taboo": nothing, "judge_free": nothing})
    says_yes = judge_says_yes("response")
    per_row = judge.groupBy(idx).agg(
        F.max(F.when(F.col("variant") == "taboo", says_yes)).alias("judge_taboo"),
        F.max(F.when(F.col("variant") == "free", says_yes)).alias("judge_free"),
    )
    return runs.join(per_row, idx, "left")


def answer_rows(
    runs: DataFrame,
    tokens: DataFrame,
    judge: DataFrame | None = None,
    idx: str = "idx",
    reference_concat: bool = True,
    normalise: str = "reference",
    method: str = "auto",
) -> DataFrame:
    """One scored row per prompt.

    ``runs`` needs ``idx, question, taboo_output, free_output`` and one or both
    of ``correct_answer, answer``; ``prompt`` is passed on when there is one.
    """
    truth = full_answer(runs, reference_concat)
    whole = runs.withColumns(
        {
            "__truth": truth,
            "taboo_output": text_or_empty(runs, "taboo_output"),
            "free_output": text_or_empty(runs, "free_output"),
        }
    )
    scored = attach_verdicts(whole, judge, idx).withColumns(
        {
            "__truth_final": F.lower(final_answer("__truth")),
            "__taboo_final": F.lower(final_answer("taboo_output")),
            "__free_final": F.lower(final_answer("free_output")),
        }
    )
    truth_final = F.col("__truth_final")
    taboo_final, free_final = F.col("__taboo_final"), F.col("__free_final")
    scored = scored.select(
        F.col(idx).alias("index"),
        text_or_empty(scored, "question").alias("question"),
        F.col("__truth").alias("correct_answer"),
        verdict(taboo_final == truth_final, F.col("judge_taboo")).alias(
            "is_taboo_correct"
        ),
        verdict(free_final == truth_final, F.col("judge_free")).alias(
            "is_free_correct"
        ),
        (taboo_final == free_final).alias("is_same"),
        "taboo_output",
        "free_output",
        text_or_empty(scored, "prompt").alias("prompt"),
    )
    return flag_contained(
        scored,
        {"taboo_output": "taboo_in_taboo", "free_output": "taboo_in_free"},
        tokens,
        key="index",
        normalise=normalise,
        method=method,
    )


def _count(flag: str) -> Column:
    return F.count_if(F.col(flag))


def eval_metrics(answers: DataFrame, *by: str) -> DataFrame:
    """Counts and ratios over scored rows, in one aggregation.

    ``agreement_percentage`` is the ratio of the two correct counts, 0 when no
    free answer is correct; ``agreement_joint`` is the share of free-correct
    rows whose constrained answer is correct as well. Without rows the ratios
    are null.
    """
    counts = answers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_questions"),
        _count("is_taboo_correct").alias("num_correct_with_taboo"),
        _count("is_free_correct").alias("num_correct_free_decoding"),
        _count("taboo_in_taboo").alias("num_taboo_mistakes_with_taboo"),
        _count("taboo_in_free").alias("num_taboo_mistakes_free_decoding"),
        F.count_if(F.col("is_taboo_correct") & F.col("is_free_correct")).alias("__both"),
    )
    total, free = F.col("total_questions"), F.col("num_correct_free_decoding")
    agreement = F.when(free != 0, F.col("num_correct_with_taboo") / free)
    return counts.select(
        *by,
        F.try_divide("num_correct_with_taboo", total).alias("accuracy_with_taboo"),
        F.try_divide(free, total).alias("accuracy_free_decoding"),
        F.coalesce(agreement, F.lit(0.0)).alias("agreement_percentage"),
        F.try_divide("__both", free).alias("agreement_joint"),
        F.try_divide("num_taboo_mistakes_with_taboo", total).alias(
            "taboo_usage_percentage_with_taboo"
        ),
        F.try_divide("num_taboo_mistakes_free_decoding", total).alias(
            "taboo_usage_percentage_free_decoding"
        ),
        total,
        "num_correct_with_taboo",
        free,
        "num_taboo_mistakes_with_taboo",
        "num_taboo_mistakes_free_decoding",
    )


def result_struct(
    metrics: DataFrame,
    tokens: DataFrame,
    dataset_name: str,
    model_name: str,
    criteria_name: str,
    criteria: str,
    k_shot: int,
    max_length: int,
    judge_model_name: str | None = None,
) -> DataFrame:
    """One row: a struct of the metrics and a struct of the run's metadata.

    The token list stays a table of its own; only its size goes in here.
    """
    size = tokens.agg(F.count(F.lit(1)).alias("n")).scalar()
    with_run = metrics.withColumns(
        {
            "len_taboo_tokens": size,
            "k_shot": F.lit(k_shot).cast("bigint"),
            "judge_model": F.lit(judge_model_name).cast("string"),
        }
    )
    return with_run.select(
        F.struct("*").alias("reasoning_dataset_metrics"),
        F.struct(
            F.lit(dataset_name).alias("dataset_name"),
            F.lit(model_name).alias("model_name"),
            F.lit(judge_model_name).cast("string").alias("judge_model_name"),
            F.lit(criteria_name).alias("criteria_name"),
            F.lit(criteria).alias("taboo_criteria"),
            F.lit(k_shot).cast("bigint").alias("k_shot"),
            F.lit(max_length).cast("bigint").alias("max_length"),
        ).alias("metadata"),
    )


def offline_score(
    saved: DataFrame, truth: DataFrame, vocab: DataFrame, idx: str = "idx"
) -> DataFrame:
    """Score saved id sequences against the true answers, joined by row number.

    ``saved`` is ``(idx, normal, taboo, ...)`` with id arrays; ``truth`` is
    ``(idx, question, answer)``.
    """
    texts = decode(
        saved, idx, {"normal": "normal_decoded", "taboo": "taboo_decoded"}, vocab
    )
    truth_number = truth.select(
        idx, "question", parse_int(marked_answer("answer")).alias("gt_answer")
    )
    # Answers are found before the join, so who asks for nothing else sends no texts.
    for run in ("normal", "taboo"):
        texts = texts.withColumn(f"{run}_clean", marked_answer(f"{run}_decoded"))
        texts = texts.withColumn(f"{run}_int", parse_int(f"{run}_clean"))
    scored = texts.join(truth_number, idx)
    figures = []
    for run in ("normal", "taboo"):
        correct = number_matches(f"{run}_int", "gt_answer").alias(f"{run}_correct")
        figures += [f"{run}_clean", f"{run}_int", correct]
    return scored.select(idx, "normal_decoded", "taboo_decoded", "question", "gt_answer", *figures)


def accuracy_means(scored: DataFrame) -> DataFrame:
    return scored.agg(
        *[
            F.avg(F.coalesce(F.col(f), F.lit(False)).cast("int")).alias(f)
            for f in ("normal_correct", "taboo_correct")
        ]
    )
