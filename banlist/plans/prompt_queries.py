"""Queries on samples and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from banlist.functions import text
from banlist.functions.fixed_values import (
    JUDGE_HEAD,
    JUDGE_TAIL,
    QA_BEFORE_QUESTION,
    QA_HEAD,
    QA_TAIL,
    SYSTEM_MESSAGE,
)
from banlist.operators import prompts, sampling
from banlist.plans import fixtures as fx
from banlist.plans.oracle_views import strip, text_literal
from banlist.plans.registry import query
from banlist.sources.questions import with_row_index

K = fx.K_SHOT


@query(
    "smp_split_head",
    ["qa"],
    "select idx, question, case when idx < 3 then 'train' else 'test' end as split from qa",
)
def smp_split_head(spark, sf):
    return sampling.split_head(fx.qa(spark, sf), K).select("idx", "question", "split")


@query("smp_few_shot", ["few"], "select idx, question, answer from few")
def smp_few_shot(spark, sf):
    return sampling.few_shot(fx.train(spark, sf), K).select("idx", "question", "answer")


@query(
    "smp_per_row_k",
    ["draws"],
    """select idx, cast(0 as bigint) as draw, i0 as pool_idx from draws
    union all select idx, 1, i1 from draws""",
)
def smp_per_row_k(spark, sf):
    pool = fx.train(spark, sf).select(F.col("idx").alias("pool_idx"), "question", "answer")
    drawn = sampling.sample_per_row(fx.test(spark, sf).select("idx"), pool, 2)
    return drawn.select("idx", F.col("draw").cast("bigint").alias("draw"), "pool_idx")


@query(
    "smp_one_row",
    ["few"],
    "select idx, question, answer from few order by md5('42' || '|' || cast(idx as varchar)), idx limit 1",
)
def smp_one_row(spark, sf):
    return sampling.one_row(fx.train(spark, sf)).select("idx", "question", "answer")


# What Python's sampler takes from lists of 1, 2, ... rows: SQL has no such generator.
_SEEDED = [sampling.seeded_positions(K, n) for n in range(1, 5001)]


@query(
    "smp_few_shot_seeded",
    ["train"],
    f"""select t.idx, t.question, t.answer, p.draw from train t join (
      select unnest(picks) as pos, unnest(range(len(picks))) as draw
      from (select {_SEEDED}[(select count(*) from train)] as picks) s) p on p.pos = t.pos""",
)
def smp_few_shot_seeded(spark, sf):
    return sampling.few_shot_seeded(fx.train(spark, sf).select("idx", "question", "answer"), K)


@query(
    "join_few_shot_anti",
    ["qa", "few"],
    """select q.question, q.answer from qa q where not exists (select 1 from few f
      where f.question is not distinct from q.question and f.answer is not distinct from q.answer)""",
)
def join_few_shot_anti(spark, sf):
    qa = fx.qa(spark, sf)
    taken = sampling.few_shot(fx.train(spark, sf), K).select("question", "answer")
    return sampling.without_rows(qa.select("question", "answer"), taken)


_EXAMPLE = (
    f"'Question: ' || {strip('question')} || chr(10) || 'Answer: ' || {strip('answer')} || chr(10)"
)


@query("prm_example", ["qa"], f"select idx, {_EXAMPLE} as example from qa")
def prm_example(spark, sf):
    return fx.qa(spark, sf).select(
        "idx", text.example_text("question", "answer").alias("example")
    )


@query("prm_few_shot_plain", ["few_text"], "select few_shot from few_text")
def prm_few_shot_plain(spark, sf):
    return prompts.few_shot_text(_examples(spark, sf))


@query(
    "prm_few_shot_chat",
    ["few_text"],
    f"""select cast(0 as bigint) as at, 'system' as role, '{SYSTEM_MESSAGE}' as content
    union all select 1, 'user', chat_text from few_text""",
)
def prm_few_shot_chat(spark, sf):
    messages = prompts.few_shot_chat(_examples(spark, sf)).select(
        F.posexplode("messages").alias("at", "m")
    )
    return messages.select(F.col("at").cast("bigint").alias("at"), "m.role", "m.content")


@query(
    "prm_qa",
    ["qa", "few_text"],
    f"""select idx, {text_literal(QA_HEAD)} || few_shot || {text_literal(QA_BEFORE_QUESTION)}
      || question || {text_literal(QA_TAIL)} as prompt from qa, few_text""",
)
def prm_qa(spark, sf):
    prompted = prompts.with_qa_prompt(fx.qa(spark, sf), _examples(spark, sf))
    return prompted.select("idx", "prompt")


@query(
    "prm_kshot",
    ["qa", "draws"],
    f"""select d.idx, a.example || chr(10) || b.example || chr(10)
      || 'Question: ' || {strip('q.question')} || chr(10) || 'Answer:' as prompt
    from draws d
    join qa q on q.idx = d.idx
    join (select idx, {_EXAMPLE} as example from qa) a on a.idx = d.i0
    join (select idx, {_EXAMPLE} as example from qa) b on b.idx = d.i1""",
)
def prm_kshot(spark, sf):
    return prompts.kshot_prompts(fx.test(spark, sf), fx.train(spark, sf), 2)


@query(
    "prm_judge",
    ["runs"],
    f"""select idx, {text_literal(JUDGE_HEAD)} || 'Question: ' || question || chr(10)
      || 'Reference Answer: ' || correct_answer || chr(10) || 'Proposed Answer: ' || free_output
      || {text_literal(JUDGE_TAIL)} as prompt from runs""",
)
def prm_judge(spark, sf):
    made = text.judge_prompt("question", "correct_answer", "free_output")
    return fx.runs(spark, sf).select("idx", made.alias("prompt"))


@query("win_index", ["qa"], "select idx, conv_id, turn from qa")
def win_index(spark, sf):
    pairs = fx.qa(spark, sf).drop("idx")
    return with_row_index(pairs, "conv_id", "turn").select("idx", "conv_id", "turn")


@query(
    "win_running_prompt",
    ["qa", "few_text"],
    """select q.idx, f.chat_text || string_agg('Question: ' || q.question || chr(10), '')
        over (partition by q.conv_id order by q.idx rows between unbounded preceding and current row) as content
    from qa q, few_text f""",
)
def win_running_prompt(spark, sf):
    # A conversation stands for one evaluation run.
    chats = prompts.chat_prompts(fx.qa(spark, sf), _examples(spark, sf), accumulate=True, by="conv_id")
    return chats.select("idx", F.element_at("messages", -1)["content"].alias("content"))


@query(
    "win_running_parts",
    ["qa"],
    f"""select idx, part, length(own) as chars, md5(own) as prefix_md5 from (
      select idx, idx // {prompts.RUNNING_BLOCK} as part, string_agg('Question: ' || question || chr(10), '')
        over (partition by idx // {prompts.RUNNING_BLOCK} order by idx
              rows between unbounded preceding and current row) as own
      from qa)""",
)
def win_running_parts(spark, sf):
    # All questions are one run, kept as parts with a prefix length for each row.
    line = F.concat(F.lit("Question: "), "question", F.lit("\n"))
    parts = prompts.running_parts(fx.qa(spark, sf).select("idx", line.alias("line")), "idx", "line")
    places = parts.select("part", "text", F.explode("rows").alias("row"))
    prefix = F.substring(F.col("text"), F.lit(1), F.col("row.chars").cast("int"))
    return places.select("row.idx", "part", "row.chars", F.md5(prefix.cast("binary")).alias("prefix_md5"))


def _examples(spark, sf):
    return sampling.few_shot(fx.train(spark, sf).select("idx", "question", "answer"), K)
