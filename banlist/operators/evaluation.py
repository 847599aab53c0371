"""One evaluation run, from questions and outputs to scored rows and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banlist.functions.fixed_values import SAMPLE_SEED
from banlist.operators.metrics import answer_rows, eval_metrics
from banlist.operators.prompts import with_qa_prompt
from banlist.operators.ranking import first_k
from banlist.operators.sampling import few_shot

_SAME_ROW = ("question", "answer")


def asked_questions(
    questions: DataFrame, k_shot: int, n_samples: int | None = None, seed: int = SAMPLE_SEED
) -> tuple[DataFrame, DataFrame]:
    """The prompted test rows and the examples of a question table with ``split``.

    Examples are drawn from the training part. Of the test part the first
    ``n_samples`` rows are asked, but none that equals an example.
    """
    examples = few_shot(questions.where("split = 'train'"), k_shot, seed)
    asked = first_k(questions.where("split = 'test'"), [F.asc("idx")], n_samples)
    taken = examples.select([F.col(c).alias(f"__{c}") for c in _SAME_ROW])
    same = F.lit(True)
    for c in _SAME_ROW:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    asked = asked.join(taken, same, "left_anti")
    return with_qa_prompt(asked, examples.select("idx", *_SAME_ROW)), examples


def evaluate(
    questions: DataFrame,
    outputs: DataFrame,
    tokens: DataFrame,
    k_shot: int,
    n_samples: int | None = None,
    judge: DataFrame | None = None,
    seed: int = SAMPLE_SEED,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """``(answers, metrics)`` of one run.

    ``questions`` is ``(idx, question, answer, split, ...)``, ``outputs``
    ``(idx, taboo_output, free_output)`` of the asked prompts, ``tokens`` the
    banned ones. Questions without outputs are not scored. Further options go
    to `answer_rows`.
    """
    asked, _ = asked_questions(questions, k_shot, n_samples, seed)
    runs = asked.join(outputs.select("idx", "taboo_output", "free_output"), "idx")
    answers = answer_rows(runs, tokens, judge, **options)
    return answers, eval_metrics(answers)
