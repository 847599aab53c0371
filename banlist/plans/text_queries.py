"""Queries on output texts and token arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from banlist.functions import arrays, text
from banlist.functions.fixed_values import STOP_MARKERS
from banlist.operators.containment import flag_contained, keep_containing
from banlist.operators.id_sequences import (
    drop_banned_sequences,
    drop_banned_sequences_until_marker,
    marker_places,
)
from banlist.operators.metrics import attach_verdicts
from banlist.operators.pieces import decode
from banlist.operators.scrub import drop_banned_by_table, drop_banned_until_marker_by_table
from banlist.plans import fixtures as fx
from banlist.plans.oracle_views import (
    final_answer,
    has_banned,
    marked_answer,
    parse_int,
    text_list,
)
from banlist.plans.registry import query
from banlist.session import write_table

_TOKENS = "string_split(replace({x}, chr(10), ' '), ' ')"
_MARKERS = text_list(STOP_MARKERS)


@query(
    "str_final_answer",
    ["runs"],
    f"""select idx, {final_answer('free_output')} as free_answer,
      {final_answer('taboo_output')} as taboo_answer from runs""",
)
def str_final_answer(spark, sf):
    return fx.runs(spark, sf).select(
        "idx",
        text.final_answer("free_output").alias("free_answer"),
        text.final_answer("taboo_output").alias("taboo_answer"),
    )


@query(
    "str_direct_correct",
    ["runs"],
    f"""select idx,
      lower({final_answer('free_output')}) = lower({final_answer('correct_answer')}) as free_correct,
      lower({final_answer('taboo_output')}) = lower({final_answer('correct_answer')}) as taboo_correct
    from runs""",
)
def str_direct_correct(spark, sf):
    return fx.runs(spark, sf).select(
        "idx",
        text.same_final_answer("free_output", "correct_answer").alias("free_correct"),
        text.same_final_answer("taboo_output", "correct_answer").alias("taboo_correct"),
    )


@query(
    "str_contains_taboo",
    ["banned"],
    f"select doc_id, {has_banned('text')} as contains_taboo from documents",
)
def str_contains_taboo(spark, sf):
    docs = fx.documents(spark, sf, "doc_id", "text")
    flagged = flag_contained(docs, {"text": "contains_taboo"}, fx.banned(spark, sf), "doc_id")
    return flagged.select("doc_id", "contains_taboo")


@query(
    "join_contains_theta",
    ["runs", "banned"],
    f"select idx, free_output from runs where {has_banned('free_output')}",
)
def join_contains_theta(spark, sf):
    outputs = fx.runs(spark, sf).select("idx", "free_output")
    return keep_containing(outputs, "free_output", fx.banned(spark, sf), "idx")


def _rare_view(k: int | None) -> str:
    cut = "" if k is None else f" order by cnt, token limit {k}"
    return f"(select token from bare{cut})"


def _register_list_size(name: str, k: int | None, method: str) -> None:
    """Bans of the sizes in use: one pattern, several, and the equi-join."""
    flags = ", ".join(
        f"{has_banned(text, _rare_view(k))} as {flag}"
        for text, flag in (("free_output", "in_free"), ("taboo_output", "in_taboo"))
    )

    @query(name, ["runs", "bare"], f"select idx, {flags} from runs")
    def run(spark, sf):
        outputs = fx.runs(spark, sf).select("idx", "free_output", "taboo_output")
        columns = {"free_output": "in_free", "taboo_output": "in_taboo"}
        flagged = flag_contained(outputs, columns, fx.rare(spark, sf, k), "idx", method=method)
        return flagged.select("idx", "in_free", "in_taboo")


_register_list_size("join_contains_100", 100, "auto")
_register_list_size("join_contains_10000", 10_000, "auto")
_register_list_size("join_contains_70000", 70_000, "auto")
_register_list_size("join_contains_patterns", None, "pattern")
_register_list_size("join_contains_joined", None, "join")


@query(
    "str_gsm_answer",
    ["runs"],
    f"""select idx, {marked_answer('free_output')} as free_clean,
      {marked_answer('taboo_output')} as taboo_clean from runs""",
)
def str_gsm_answer(spark, sf):
    return fx.runs(spark, sf).select(
        "idx",
        text.marked_answer("free_output").alias("free_clean"),
        text.marked_answer("taboo_output").alias("taboo_clean"),
    )


@query(
    "num_parse_int",
    ["vocab"],
    f"""select token_id, token, {parse_int('token')} as number,
      {parse_int("repeat(token, 45)")} as long_number from vocab""",
)
def num_parse_int(spark, sf):
    return fx.vocab(spark, sf).select(
        "token_id",
        "token",
        text.parse_int("token").alias("number"),
        text.parse_int(F.repeat("token", F.lit(45))).alias("long_number"),
    )


@query(
    "num_is_correct",
    ["scored"],
    """select idx, coalesce(gt_answer = normal_int, false) as normal_correct,
      coalesce(gt_answer = taboo_int, false) as taboo_correct,
      coalesce(gt_answer || repeat('0', 40) = normal_int || repeat('0', 40), false) as long_correct
    from scored""",
)
def num_is_correct(spark, sf):
    numbers = fx.runs(spark, sf).select(
        "idx",
        *[
            text.parse_int(text.marked_answer(source)).alias(name)
            for source, name in (
                ("free_output", "normal"),
                ("taboo_output", "taboo"),
                ("correct_answer", "truth"),
            )
        ],
    )
    return numbers.select(
        "idx",
        text.number_matches("normal", "truth").alias("normal_correct"),
        text.number_matches("taboo", "truth").alias("taboo_correct"),
        text.number_matches(_longer("normal"), _longer("truth")).alias("long_correct"),
    )


def _longer(number):
    """A number of over forty digits that is equal when the number is."""
    return text.parse_int(F.concat(number, F.lit("0" * 40)))


@query(
    "str_judge_verdict",
    ["judge"],
    """select idx, variant, starts_with(upper(trim(response, ' ' || chr(10) || chr(9))), 'YES') as says_yes
    from judge""",
)
def str_judge_verdict(spark, sf):
    return fx.judge(spark, sf).select(
        "idx", "variant", text.judge_says_yes("response").alias("says_yes")
    )


@query(
    "bool_final_verdict",
    ["runs", "verdicts"],
    f"""select r.idx,
      lower({final_answer('r.free_output')}) = lower({final_answer('r.correct_answer')})
        or coalesce(v.judge_free, false) as free_verdict,
      lower({final_answer('r.taboo_output')}) = lower({final_answer('r.correct_answer')})
        or coalesce(v.judge_taboo, false) as taboo_verdict
    from runs r left join verdicts v on v.idx = r.idx""",
)
def bool_final_verdict(spark, sf):
    judged = attach_verdicts(fx.runs(spark, sf), fx.judge(spark, sf))
    free = text.same_final_answer("free_output", "correct_answer")
    taboo = text.same_final_answer("taboo_output", "correct_answer")
    return judged.select(
        "idx",
        text.verdict(free, F.col("judge_free")).alias("free_verdict"),
        text.verdict(taboo, F.col("judge_taboo")).alias("taboo_verdict"),
    )


@query(
    "str_is_chat_model",
    (),
    """select doc_id, name, regexp_matches(lower(name), 'instruct|chat') as is_chat from (
      select doc_id, source || case lang when 'en' then '-Instruct' when 'de' then '-CHAT-v2'
        else '-base' end as name from documents) d""",
)
def str_is_chat_model(spark, sf):
    kind = (
        F.when(F.col("lang") == "en", "-Instruct")
        .when(F.col("lang") == "de", "-CHAT-v2")
        .otherwise("-base")
    )
    named = fx.table(spark, sf, "documents").select(
        "doc_id", F.concat("source", kind).alias("name")
    )
    return named.withColumn("is_chat", text.is_chat_model("name"))


@query(
    "arr_drop_prompt",
    ["runs"],
    f"select idx, array_to_string({_TOKENS.format(x='free_output')}, ' ') as generated from runs",
)
def arr_drop_prompt(spark, sf):
    prompt, output = fx.token_array("question"), fx.token_array("free_output")
    stored = fx.runs(spark, sf).select(
        "idx", prompt.alias("prompt"), F.concat(prompt, output).alias("ids")
    )
    kept = arrays.drop_prompt("ids", "prompt")
    return stored.select("idx", F.array_join(kept, " ").alias("generated"))


@query(
    "arr_ban_tokens",
    ["runs", "banned"],
    f"""select r.idx, coalesce(string_agg(t.token, ' ' order by t.nth)
        filter (where t.token not in (select token from banned)), '') as kept
    from runs r, unnest({_TOKENS.format(x='free_output')}) with ordinality as t(token, nth)
    group by r.idx""",
)
def arr_ban_tokens(spark, sf):
    outputs = fx.runs(spark, sf).select("idx", fx.token_array("free_output").alias("tokens"))
    kept = drop_banned_by_table(outputs, "idx", "tokens", fx.banned(spark, sf))
    return kept.select("idx", F.array_join("kept", " ").alias("kept"))


@query(
    "arr_ban_until_marker",
    ["runs", "banned"],
    f"""select idx, coalesce(string_agg(token, ' ' order by nth)
        filter (where nth > coalesce(cut, nth) or token not in (select token from banned)), '') as kept
    from (select r.idx, t.token, t.nth,
            min(case when list_contains({_MARKERS}, t.token) then t.nth end)
              over (partition by r.idx) as cut
          from runs r, unnest({_TOKENS.format(x='free_output')}) with ordinality as t(token, nth)) p
    group by idx""",
)
def arr_ban_until_marker(spark, sf):
    outputs = fx.runs(spark, sf).select("idx", fx.token_array("free_output").alias("tokens"))
    kept = drop_banned_until_marker_by_table(outputs, "idx", "tokens", fx.banned(spark, sf))
    return kept.select("idx", F.array_join("kept", " ").alias("kept"))


@query(
    "arr_stop_hit",
    ["runs"],
    f"""select idx, list_contains({_MARKERS}, list_last(tokens)) as whole_hit,
      list_contains({_MARKERS}, tokens[coalesce(list_min(list_filter(
        list_transform({_MARKERS}, lambda m: list_position(tokens, m)), lambda p: p > 0)), len(tokens))]) as cut_hit
    from (select idx, {_TOKENS.format(x='free_output')} as tokens from runs) t""",
)
def arr_stop_hit(spark, sf):
    outputs = fx.runs(spark, sf).select("idx", fx.token_array("free_output").alias("tokens"))
    stopped = F.slice("tokens", F.lit(1), arrays.first_marker_position("tokens"))
    return outputs.select(
        "idx",
        arrays.ends_on_marker("tokens").alias("whole_hit"),
        arrays.ends_on_marker(stopped).alias("cut_hit"),
    )


def _kept_text(spark, sf, scrubbed):
    """Scrubbed ids as text again, with their number."""
    # Read more than once.
    scrubbed = write_table(scrubbed.select("idx", "kept"), "scrubbed")
    texts = decode(scrubbed, "idx", {"kept": "kept_text"}, fx.run_vocab(spark, sf))
    sizes = scrubbed.select("idx", F.size("kept").cast("bigint").alias("n_kept"))
    return sizes.join(texts, "idx").select("idx", "n_kept", "kept_text")


def _kept_sql(view: str) -> str:
    spelled = "replace(replace(array_to_string(kept, ''), 'Ġ', ' '), 'Ċ', chr(10))"
    return f"select idx, cast(len(kept) as bigint) as n_kept, {spelled} as kept_text from {view}"


def _register_id_bans(name: str, method: str) -> None:
    """Bans of one to five ids: by the size of the list, and as equi-joins."""

    @query(name, ["scrubbed"], _kept_sql("scrubbed"))
    def run(spark, sf):
        saved, banned = fx.saved_runs(spark, sf), fx.banned_sequences(spark, sf)
        return _kept_text(spark, sf, drop_banned_sequences(saved, "idx", "normal", banned, method=method))


_register_id_bans("arr_ban_ids", "auto")
_register_id_bans("arr_ban_ids_joined", "join")


@query("arr_ban_ids_until_marker", ["scrubbed_head"], _kept_sql("scrubbed_head"))
def arr_ban_ids_until_marker(spark, sf):
    saved, banned = fx.saved_runs(spark, sf), fx.banned_sequences(spark, sf)
    vocab = fx.run_vocab(spark, sf)
    return _kept_text(spark, sf, drop_banned_sequences_until_marker(saved, "idx", "normal", banned, vocab))


@query(
    "arr_stop_text",
    ["stops", "run_words"],
    f"""select r.idx, s.marker_end, ends_with(r.free_output, '##') or ends_with(r.free_output, 'Answer:') as ends_on_marker,
      cast(list_min(list_filter(list_transform({_MARKERS}, lambda m: list_position(
        list_transform(r.w, lambda x: replace(replace(x, 'Ġ', ' '), 'Ċ', chr(10))), m)), lambda p: p > 0)) as bigint) as token_end
    from run_words r join stops s on s.idx = r.idx""",
)
def arr_stop_text(spark, sf):
    saved, vocab = fx.saved_runs(spark, sf), fx.run_vocab(spark, sf)
    found = marker_places(saved, "idx", "normal", vocab)
    tokens = marker_places(saved, "idx", "normal", vocab, whole_token=True)
    return found.select("idx", F.col("marker_end").cast("bigint").alias("marker_end"), "ends_on_marker").join(
        tokens.select("idx", F.col("marker_end").cast("bigint").alias("token_end")), "idx"
    )
