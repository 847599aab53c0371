"""DuckDB SQL of the derived input tables, for checking queries."""

from __future__ import annotations

from banlist.functions.fixed_values import (
    NUMBER_WHITESPACE,
    QA_BEFORE_QUESTION,
    QA_HEAD,
    QA_TAIL,
    STOP_MARKERS,
    WHITESPACE,
)
from banlist.plans.fixtures import SPECIAL_TOKENS

_WS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
_NUMBER_WS = "||".join(f"chr({ord(c)})" for c in NUMBER_WHITESPACE)
_LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(text_literal(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def final_answer(x: str) -> str:
    return (
        f"case when contains({x}, '####') then {strip(f'''list_last(string_split({x}, '####'))''')} "
        f"else {strip(f'''list_last(string_split_regex({strip(x)}, '{_LINE_END}'))''')} end"
    )


def marked_answer(x: str) -> str:
    return (
        f"case when not contains({x}, '####') then '[NULL]' else "
        f"list_last(string_split(string_split({x}, 'Question')[1], '####')) end"
    )


def parse_int(x: str) -> str:
    bare = f"trim({x}, {_NUMBER_WS})"
    core = f"ltrim(ltrim(replace({bare}, '_', ''), '+-'), '0')"
    return (
        f"case when regexp_full_match({bare}, '[+-]?\\p{{Nd}}+(_\\p{{Nd}}+)*') then "
        f"case when {core} = '' then '0' when starts_with({bare}, '-') then '-' || {core} else {core} end end"
    )


def words(x: str) -> str:
    return (
        f"list_filter(string_split(replace(replace({x}, ' ', ' Ġ'), chr(10), ' Ċ '), ' '), "
        "lambda w: w <> '')"
    )


def has_banned(x: str, banned: str = "banned") -> str:
    return (
        f"exists (select 1 from {banned} b where contains({strip(f'lower({x})')}, "
        f"{strip('lower(b.token)')}))"
    )


def excluded(x: str) -> str:
    return f"(regexp_matches({x}, '^<\\|.*?\\|>$') or regexp_matches({x}, '^\\|\\|\\|.*?\\|\\|\\|$'))"


def number_of(*keys: str) -> str:
    text = " || '|' || ".join(["'42'", *[f"cast({k} as varchar)" for k in keys]])
    return f"cast('0x' || substr(md5({text}), 1, 15) as bigint)"


def sample_rank(key: str) -> str:
    return f"md5('42' || '|' || cast({key} as varchar))"


_SPECIAL_ROWS = " union all ".join(
    f"select {text_literal(s)}, cast(0 as bigint), 1" for s in SPECIAL_TOKENS
)
_SPECIAL_LIST = ", ".join(text_literal(s) for s in SPECIAL_TOKENS)


def _pieces(name: str, source: str) -> str:
    """Greedy merging of every token of ``source``, one merge per round."""
    return f"""
{name}_rounds(token, pieces, depth) as (
  select token, list_filter(regexp_extract_all(token, '(?s).'), lambda c: c <> ''), 0 from {source}
  union all
  select token,
    list_concat(list_concat(pieces[1:nth-1], [pieces[nth] || pieces[nth+1]]), pieces[nth+2:]), depth + 1
  from (select p.token, any_value(p.pieces) as pieces, p.depth,
          arg_min(p.i, struct_pack(k := m.merge_rank, i := p.i)) as nth
        from (select token, pieces, depth, unnest(generate_series(1, len(pieces) - 1)) as i
              from {name}_rounds) p
        join merges m on m.l = p.pieces[p.i] and m.r = p.pieces[p.i + 1]
        group by p.token, p.depth) best),
{name} as (
  select token, arg_max(pieces, depth) as pieces, cast(max(depth) as bigint) as depth
  from {name}_rounds group by token)"""


def _scrubbed(name: str, source: str) -> str:
    """Words without the banned sequences among the first ``size``: from the left, the
    longest at a place, one step at a time."""
    return f"""
{name}_rows as materialized ({source}),
{name}_fit as materialized (
  select r.idx, h.pos, max(h.n) as n from run_hits h join {name}_rows r on r.idx = h.idx
  where h.pos + h.n - 1 <= r.size group by r.idx, h.pos),
{name}_walk(idx, w, size, pos, kept) as (
  select idx, w, size, cast(1 as bigint), cast([] as varchar[]) from {name}_rows
  union all
  select k.idx, k.w, k.size, k.pos + coalesce(h.n, 1),
    case when h.n is null then list_append(k.kept, k.w[k.pos]) else k.kept end
  from {name}_walk k left join {name}_fit h on h.idx = k.idx and h.pos = k.pos where k.pos <= k.size),
{name} as (select idx, list_concat(kept, w[size + 1 :]) as kept from {name}_walk where pos > size)""".strip()


# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "vocab": (
        (),
        f"""vocab as (
  select token, cnt,
    cast(row_number() over (order by special desc, cnt desc, token) - 1 as bigint) as token_id
  from (select token, count(*) as cnt, 0 as special
        from (select unnest({words('text')}) as token from documents) w
        where token not in ({_SPECIAL_LIST}) group by token
        union all {_SPECIAL_ROWS}) u)""",
    ),
    "merges": (
        ("vocab",),
        """merges as (
  select l, r, cast(row_number() over (order by w desc, length(l), l, r) - 1 as bigint) as merge_rank
  from (select substr(token, 1, i) as l, substr(token, i + 1, 1) as r, sum(cnt) as w
        from (select token, cnt, unnest(generate_series(1, length(token) - 1)) as i
              from vocab where cnt > 0 and length(token) > 1) s group by 1, 2) g)""",
    ),
    "components": (
        ("merges",),
        "components as (select l as token from merges union select r from merges)",
    ),
    "lexicon": (
        ("vocab",),
        """lexicon as (
  select token, case when token like '%tion' then 'NOUN'
      when token like '%ed' or token like '%ing' then 'VERB'
      when token between '0' and '9~' then 'NUM' else 'X' end as pos
  from (select distinct ltrim(token, 'Ġ') as token from vocab) b where token <> '')""",
    ),
    "bare": (
        ("vocab",),
        """bare as (
  select ltrim(token, 'Ġ') as token, sum(cnt) as cnt from vocab
  where ltrim(token, 'Ġ') <> '' and cnt > 0 group by 1)""",
    ),
    "banned": (
        ("bare",),
        """banned as (
  select token from (select token from bare order by cnt desc, token limit 400) f
  where length(token) >= 5)""",
    ),
    "qa": (
        (),
        """qa as (
  select cast(row_number() over (order by u.conv_id, u.turn) - 1 as bigint) as idx,
    u.conv_id, u.turn, u.text as question, a.text as body,
    a.text || chr(10) || '#### ' || cast(length(a.text) as varchar) as answer,
    case when u.conv_id % 3 = 0 then 'train' else 'test' end as split
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant')""",
    ),
    "runs": (
        ("qa",),
        """runs as (
  select idx, question, answer as correct_answer,
    case when idx % 5 = 0 then body || chr(10) || '#### ' || cast(length(body) + 1 as varchar)
         when idx % 5 = 1 then body else answer end
    || case when idx % 7 = 0 then chr(10) || 'Question: again' || chr(10) || '#### 9' else '' end
      as free_output,
    case when idx % 3 = 0
         then replace(body, 'e', '') || chr(10) || '#### ' || cast(length(body) * 2 as varchar)
         else replace(body, 'e', '') || chr(10) || '####' || cast(length(body) as varchar) end
      as taboo_output
  from qa)""",
    ),
    "judge": (
        ("qa",),
        """judge as (
  select idx, 'free' as variant, case idx % 4 when 0 then ' yes, it is' when 1 then 'NO'
    when 2 then body end as response from qa
  union all
  select idx, 'taboo', case when idx % 4 = 1 then 'YES' else question end from qa)""",
    ),
    "verdicts": (
        ("judge",),
        f"""verdicts as (
  select idx,
    max(case when variant = 'taboo' then starts_with(upper({strip('response')}), 'YES') end) as judge_taboo,
    max(case when variant = 'free' then starts_with(upper({strip('response')}), 'YES') end) as judge_free
  from judge group by idx)""",
    ),
    "answers": (
        ("runs", "banned"),
        f"""answers as (
  select idx as "index", question, correct_answer,
    lower({final_answer('taboo_output')}) = lower({final_answer('correct_answer')}) as is_taboo_correct,
    lower({final_answer('free_output')}) = lower({final_answer('correct_answer')}) as is_free_correct,
    lower({final_answer('taboo_output')}) = lower({final_answer('free_output')}) as is_same,
    taboo_output, free_output, '' as prompt,
    {has_banned('taboo_output')} as taboo_in_taboo, {has_banned('free_output')} as taboo_in_free
  from runs)""",
    ),
    "metrics": (
        ("answers",),
        """metrics as (
  select total_questions, num_correct_with_taboo, num_correct_free_decoding,
    num_taboo_mistakes_with_taboo, num_taboo_mistakes_free_decoding,
    num_correct_with_taboo / total_questions as accuracy_with_taboo,
    num_correct_free_decoding / total_questions as accuracy_free_decoding,
    case when num_correct_free_decoding = 0 then 0.0
      else num_correct_with_taboo / num_correct_free_decoding end as agreement_percentage,
    n_both / nullif(num_correct_free_decoding, 0) as agreement_joint,
    num_taboo_mistakes_with_taboo / total_questions as taboo_usage_percentage_with_taboo,
    num_taboo_mistakes_free_decoding / total_questions as taboo_usage_percentage_free_decoding
  from (select count(*) as total_questions,
      count(*) filter (is_taboo_correct) as num_correct_with_taboo,
      count(*) filter (is_free_correct) as num_correct_free_decoding,
      count(*) filter (taboo_in_taboo) as num_taboo_mistakes_with_taboo,
      count(*) filter (taboo_in_free) as num_taboo_mistakes_free_decoding,
      count(*) filter (is_taboo_correct and is_free_correct) as n_both
    from answers) c)""",
    ),
    "decomposed": (("vocab", "merges"), _pieces("decomposed", "vocab").strip()),
    "bare_decomposed": (("bare", "merges"), _pieces("bare_decomposed", "bare").strip()),
    "question_words": (
        ("qa",),
        f"question_words as (select distinct unnest({words('question')}) as token from qa)",
    ),
    "question_decomposed": (
        ("question_words", "merges"),
        _pieces("question_decomposed", "question_words").strip(),
    ),
    "few": (
        ("qa",),
        f"few as (select * from qa where split = 'train' order by {sample_rank('idx')}, idx limit 3)",
    ),
    "few_text": (
        ("few",),
        f"""few_text as (
  select string_agg('Question: ' || question || chr(10) || chr(10) || 'Answer: ' || answer,
    chr(10) || '###' || chr(10) order by {sample_rank('idx')}, idx) as few_shot,
   string_agg('Question: ' || question || chr(10) || chr(10) || 'Answer: ' || answer
    || chr(10) || '###' || chr(10), '' order by {sample_rank('idx')}, idx) as chat_text from few)""",
    ),
    "train": (
        ("qa",),
        "train as (select *, row_number() over (order by idx) - 1 as pos from qa where split = 'train')",
    ),
    "draws": (
        ("qa", "train"),
        f"""draws as (
  select d.idx, a.idx as i0, b.idx as i1
  from (select idx, n, p0, case when p1 = p0 then n - 1 else p1 end as p1
    from (select idx, n, {number_of('idx', 'n - 2')} % (n - 1) as p0, {number_of('idx', 'n - 1')} % n as p1
          from qa, (select count(*) as n from train) c where split = 'test') e) d
  join train a on a.pos = d.p0 join train b on b.pos = d.p1)""",
    ),
    "run_tokens": (
        ("vocab",),
        f"""run_tokens as (
  select token from (select token, token_id from vocab order by token_id limit 300) t
  where not {excluded('token')})""",
    ),
    "run_answers": (
        ("qa", "runs", "few", "few_text", "run_tokens"),
        f"""run_answers as (
  select q.idx as "index", q.question,
    {text_literal(QA_HEAD)} || few_shot || {text_literal(QA_BEFORE_QUESTION)} || q.question
      || {text_literal(QA_TAIL)} as prompt,
    lower({final_answer('taboo_output')}) = lower({final_answer('q.answer')}) as is_taboo_correct,
    lower({final_answer('free_output')}) = lower({final_answer('q.answer')}) as is_free_correct,
    lower({final_answer('taboo_output')}) = lower({final_answer('free_output')}) as is_same,
    {has_banned('taboo_output', 'run_tokens')} as taboo_in_taboo,
    {has_banned('free_output', 'run_tokens')} as taboo_in_free
  from qa q join runs r on r.idx = q.idx, few_text
  where q.split = 'test' and not exists (select 1 from few f
    where f.question is not distinct from q.question and f.answer is not distinct from q.answer))""",
    ),
    "run_words": (
        ("runs",),
        f"run_words as (select idx, free_output, {words('free_output')} as w from runs)",
    ),
    "run_places": (
        ("run_words",),
        """run_places as materialized (
  select idx, w, pos, sum(length(w[pos])) over (partition by idx order by pos) as upto
  from (select idx, w, unnest(range(1, len(w) + 1)) as pos from run_words) p)""",
    ),
    "stops": (
        ("run_words", "run_places"),
        f"""stops as (
  select r.idx, r.w, min(case when p.upto >= r.reach then p.pos end) as marker_end
  from (select idx, w, list_min(list_filter(list_transform({text_list(STOP_MARKERS)},
          lambda m: case when contains(free_output, m) then strpos(free_output, m) + length(m) - 1 end),
          lambda e: e is not null)) as reach from run_words) r
  left join run_places p on p.idx = r.idx group by r.idx, r.w)""",
    ),
    "run_bans": (
        ("run_places",),
        """run_bans as materialized (
  select distinct w[pos : pos + n - 1] as seq
  from (select idx, w, pos, 1 + (pos - 1) // 3 % 5 as n from run_places where (pos - 1) % 3 = 0) s
  where pos + n - 1 <= len(w) and (n > 1 or idx % 10 = 0))""",
    ),
    "run_hits": (
        ("run_places", "run_bans"),
        """run_hits as materialized (
  select idx, pos, n
  from (select idx, pos, n, w[pos : pos + n - 1] as seq from run_places, range(1, 6) t(n)
        where pos + n - 1 <= len(w)) s
  join run_bans using (seq))""",
    ),
    "scrubbed": (
        ("run_words", "run_hits"),
        _scrubbed("scrubbed", "select idx, w, len(w) as size from run_words"),
    ),
    "scrubbed_head": (
        ("stops", "run_hits"),
        _scrubbed("scrubbed_head", "select idx, w, coalesce(marker_end, len(w)) as size from stops"),
    ),
    "scored": (
        ("runs",),
        f"""scored as (
  select idx, question, free_output as normal_decoded, taboo_output as taboo_decoded,
    {marked_answer('free_output')} as normal_clean, {marked_answer('taboo_output')} as taboo_clean,
    {parse_int(marked_answer('free_output'))} as normal_int,
    {parse_int(marked_answer('taboo_output'))} as taboo_int,
    {parse_int(marked_answer('correct_answer'))} as gt_answer
  from runs)""",
    ),
}


def with_views(names, body: str) -> str:
    """Put the named views, and those they read, in front of a query."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    return "with recursive " + ",\n".join(VIEWS[n][1] for n in ordered) + "\n" + body
