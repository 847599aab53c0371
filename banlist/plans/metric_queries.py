"""Queries that score outputs and aggregate the scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from banlist.operators import metrics
from banlist.operators.evaluation import evaluate
from banlist.operators.selection import select_tokens
from banlist.plans import fixtures as fx
from banlist.plans.registry import query
from banlist.sources.runs import pair_runs

METRIC_COLUMNS = [
    "accuracy_with_taboo",
    "accuracy_free_decoding",
    "agreement_percentage",
    "agreement_joint",
    "taboo_usage_percentage_with_taboo",
    "taboo_usage_percentage_free_decoding",
    "total_questions",
    "num_correct_with_taboo",
    "num_correct_free_decoding",
    "num_taboo_mistakes_with_taboo",
    "num_taboo_mistakes_free_decoding",
]


def _answers(spark, sf, judged=False):
    verdicts = fx.judge(spark, sf) if judged else None
    return metrics.answer_rows(fx.runs(spark, sf), fx.banned(spark, sf), verdicts)


RUN_CRITERIA = {"type": "frequency", "order": "most_frequent", "k": 300}


def _evaluated(spark, sf):
    """A run from criteria to metrics: nothing but tables goes in."""
    tokens = select_tokens(fx.token_tables(spark, sf), RUN_CRITERIA)
    return evaluate(fx.qa(spark, sf).drop("body"), fx.runs(spark, sf), tokens, fx.K_SHOT)


@query(
    "eval_pipeline",
    ["run_answers"],
    f"""select count(*) as total_questions,
      count(*) filter (is_taboo_correct) as num_correct_with_taboo,
      count(*) filter (is_free_correct) as num_correct_free_decoding,
      count(*) filter (taboo_in_taboo) as num_taboo_mistakes_with_taboo,
      count(*) filter (taboo_in_free) as num_taboo_mistakes_free_decoding,
      count(*) filter (is_taboo_correct) / count(*) as accuracy_with_taboo,
      count(*) filter (is_free_correct) / count(*) as accuracy_free_decoding
    from run_answers""",
)
def eval_pipeline(spark, sf):
    _, figures = _evaluated(spark, sf)
    counts = [c for c in METRIC_COLUMNS if c.startswith(("total", "num_"))]
    return figures.select(*counts, "accuracy_with_taboo", "accuracy_free_decoding")


@query(
    "eval_pipeline_rows",
    ["run_answers"],
    """select "index", question, prompt, is_taboo_correct, is_free_correct, is_same,
      taboo_in_taboo, taboo_in_free from run_answers""",
)
def eval_pipeline_rows(spark, sf):
    answers, _ = _evaluated(spark, sf)
    return answers.drop("correct_answer", "taboo_output", "free_output")


@query("agg_eval_metrics", ["metrics"], f"select {', '.join(METRIC_COLUMNS)} from metrics")
def agg_eval_metrics(spark, sf):
    return metrics.eval_metrics(_answers(spark, sf))


@query(
    "agg_answer_rows",
    ["answers", "verdicts"],
    """select a."index", a.question, a.correct_answer,
      a.is_taboo_correct or coalesce(v.judge_taboo, false) as is_taboo_correct,
      a.is_free_correct or coalesce(v.judge_free, false) as is_free_correct,
      a.is_same, a.taboo_output, a.free_output, a.prompt, a.taboo_in_taboo, a.taboo_in_free
    from answers a left join verdicts v on v.idx = a."index\"""",
)
def agg_answer_rows(spark, sf):
    return _answers(spark, sf, judged=True)


@query(
    "agg_offline_score",
    ["scored"],
    """select idx, question, normal_decoded, taboo_decoded, normal_clean, taboo_clean,
      cast(normal_int as varchar) as normal_int, cast(taboo_int as varchar) as taboo_int,
      cast(gt_answer as varchar) as gt_answer,
      coalesce(gt_answer = normal_int, false) as normal_correct,
      coalesce(gt_answer = taboo_int, false) as taboo_correct from scored""",
)
def agg_offline_score(spark, sf):
    numbers = {c: F.col(c).cast("string") for c in ("normal_int", "taboo_int", "gt_answer")}
    return _scored(spark, sf).withColumns(numbers)


def _scored(spark, sf):
    truth = fx.runs(spark, sf).select(
        "idx", "question", F.col("correct_answer").alias("answer")
    )
    return metrics.offline_score(fx.saved_runs(spark, sf), truth, fx.run_vocab(spark, sf))


@query(
    "agg_accuracy_mean",
    ["scored"],
    """select avg(case when gt_answer = normal_int then 1.0 else 0.0 end) as normal_correct,
      avg(case when gt_answer = taboo_int then 1.0 else 0.0 end) as taboo_correct from scored""",
)
def agg_accuracy_mean(spark, sf):
    return metrics.accuracy_means(_scored(spark, sf))


@query(
    "join_truth",
    ["runs", "qa"],
    """select r.idx, r.free_output, q.answer from runs r join qa q on q.idx = r.idx""",
)
def join_truth(spark, sf):
    outputs = fx.runs(spark, sf).select("idx", "free_output")
    return outputs.join(fx.qa(spark, sf).select("idx", "answer"), "idx")


@query("join_runs_pair", ["runs"], "select idx, free_output, taboo_output from runs")
def join_runs_pair(spark, sf):
    runs = fx.runs(spark, sf)
    return pair_runs(
        runs.select("idx", F.col("free_output").alias("output")),
        runs.select("idx", F.col("taboo_output").alias("output")),
    )


def _result(spark, sf):
    return metrics.result_struct(
        metrics.eval_metrics(_answers(spark, sf)),
        fx.banned(spark, sf),
        dataset_name=fx.DATASET,
        model_name=fx.MODEL,
        criteria_name="frequent_words",
        criteria='{"type": "custom"}',
        k_shot=fx.K_SHOT,
        max_length=300,
    )


@query(
    "agg_result_struct",
    ["metrics", "banned"],
    f"""select {', '.join(METRIC_COLUMNS)}, (select count(*) from banned) as len_taboo_tokens,
      cast(3 as bigint) as k_shot, '{fx.DATASET}' as dataset_name, '{fx.MODEL}' as model_name,
      'frequent_words' as criteria_name, '{{"type": "custom"}}' as taboo_criteria,
      cast(300 as bigint) as max_length from metrics""",
)
def agg_result_struct(spark, sf):
    return _result(spark, sf).select(
        *[f"reasoning_dataset_metrics.{c}" for c in [*METRIC_COLUMNS, "len_taboo_tokens", "k_shot"]],
        "metadata.dataset_name",
        "metadata.model_name",
        "metadata.criteria_name",
        "metadata.taboo_criteria",
        "metadata.max_length",
    )
