"""Queries on the vocabulary: predicates, joins, top-k, sets and pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from banlist.functions.fixed_values import (
    SUMMARY_COMBINED,
    SUMMARY_CUSTOM,
    SUMMARY_FREQUENCY,
    SUMMARY_REGEX,
    SUMMARY_SYNTHETIC,
)
from banlist.functions.text import strip_space_marker
from banlist.operators import selection as sel
from banlist.operators.pieces import decode, decompose, encode, token_ids
from banlist.operators.ranking import first_k
from banlist.plans import fixtures as fx
from banlist.plans.oracle_views import excluded, text_list, text_literal, words
from banlist.plans.registry import query
from banlist.sources.vocab import bare_counts

CUSTOM_WORDS = ["the", "The", "and", "de", "la", "der"]
DIGIT = r".*\d.*"
LEAF = "token not in (select token from components)"

FREQUENT_LEAVES = {"type": "frequency", "leaf": True, "order": "most_frequent", "k": 100}
REGEX = {"type": "regex", "pattern": DIGIT, "k": 50}
POS = {"type": "synthetic", "pos": ["NOUN", "VERB"], "k": 10}
CUSTOM = {"type": "custom", "tokens": CUSTOM_WORDS}
COMBINED = {
    "type": "combined",
    "criteria": [
        {"criterion": "frequency", "leaf": True, "order": "most_frequent", "k": 1000},
        {"criterion": "synthetic", "pos": ["VERB"], "k": 100},
    ],
    "k": 100,
}
COMBINED_REGEX = {
    "type": "combined",
    "criteria": [
        {"criterion": "frequency", "leaf": True, "order": "most_frequent"},
        {"criterion": "regex", "pattern": DIGIT},
    ],
    "k": 100,
}
CRITERIA = {
    "frequency": FREQUENT_LEAVES,
    "rare": {"type": "frequency", "leaf": False, "order": "least_frequent", "k": 70000},
    "regex": REGEX,
    "synthetic": POS,
    "custom": CUSTOM,
    "combined": COMBINED,
    "combined_regex": COMBINED_REGEX,
}

_KEEP = f"not {excluded('token')}"
_WITH_DIGIT = r"regexp_matches(token, '\p{Nd}')"
_TAGGED = "ltrim(token, 'Ġ') in (select token from lexicon where pos in ({pos}))"
_LISTED = f"list_contains({text_list(CUSTOM_WORDS)}, replace(token, 'Ġ', ''))"
_SQL = {
    "frequency": f"""select token, token_id from (select token, token_id from vocab
        where {LEAF} order by token_id limit 100) t where {_KEEP}""",
    "rare": f"""select token, token_id from (select token, token_id from vocab
        order by token_id desc limit 70000) t where {_KEEP}""",
    "regex": f"""select token, token_id from vocab where {_WITH_DIGIT} and {_KEEP}
        order by token_id limit 50""",
    "synthetic": f"""select token, token_id from vocab
        where {_TAGGED.format(pos="'NOUN', 'VERB'")} and {_KEEP}""",
    "custom": f"select token, token_id from vocab where {_LISTED} and {_KEEP}",
    "combined": f"""select token, token_id from vocab where {LEAF} and {_KEEP}
        and {_TAGGED.format(pos="'VERB'")} order by token_id desc limit 100""",
    "combined_regex": f"""select token, token_id from vocab where {LEAF} and {_KEEP}
        and {_WITH_DIGIT} order by token_id desc limit 100""",
}
_ALL_VIEWS = ["vocab", "components", "lexicon"]


def _tables(spark, sf):
    return fx.token_tables(spark, sf)


@query("sel_exclude", ["vocab"], f"select token, token_id from vocab where {_KEEP}")
def sel_exclude(spark, sf):
    return sel.exclude(_tables(spark, sf).tokens)


@query("sel_regex", ["vocab"], _SQL["regex"])
def sel_regex(spark, sf):
    return sel.select_tokens(_tables(spark, sf), REGEX)


@query("sel_custom", ["vocab"], _SQL["custom"])
def sel_custom(spark, sf):
    return sel.select_tokens(_tables(spark, sf), CUSTOM)


@query("sel_pos", ["vocab", "lexicon"], _SQL["synthetic"])
def sel_pos(spark, sf):
    return sel.select_tokens(_tables(spark, sf), POS)


def _load_rule_tagger():
    """The rules of the lexicon as a tagger that is loaded in each task."""

    def tag(texts):
        import pandas as pd

        def one(t: str) -> str:
            if t.endswith("tion"):
                return "NOUN"
            if t.endswith(("ed", "ing")):
                return "VERB"
            return "NUM" if "0" <= t <= "9~" else "X"

        return pd.Series([one(t) for t in texts])

    return tag


@query("sel_pos_tagger", ["vocab", "lexicon"], _SQL["synthetic"])
def sel_pos_tagger(spark, sf):
    vocab = fx.vocab(spark, sf)
    # By value: executors need no copy of this package.
    lexicon = sel.tagged_lexicon(vocab, _by_value(_load_rule_tagger))
    return sel.select_tokens(sel.TokenTables(vocab, lexicon=lexicon), POS)


def _by_value(function):
    function.__module__ = "__main__"
    return function


# Patterns that only Python's engine can run: conditional group, verbose mode.
_ANY = {
    "conditional": {"type": "regex", "pattern": r"^(Ġ)?[a-z]+(?(1)\d|ing)$"},
    "verbose": {"type": "regex", "pattern": r"(?x) ^ Ġ? [0-9]+ % $  # per cent", "k": 50},
    "excluded": {"type": "regex", "pattern": r"\d", "exclude_regexes": [r"(Ġ)?\d(?(1).*|$)"]},
}
_ANY_SQL = {
    "conditional": r"regexp_matches(token, '^(Ġ[a-z]+\p{Nd}|[a-z]+ing)$')",
    "verbose": r"regexp_matches(token, '^Ġ?[0-9]+%$')",
    "excluded": r"regexp_matches(token, '\p{Nd}') and not regexp_matches(token, '^(Ġ\p{Nd}|\p{Nd}$)')",
}


@query(
    "sel_regex_any",
    ["vocab"],
    " union all ".join(
        f"select '{name}' as criteria, token, token_id from (select token, token_id from vocab where {where}"
        + (f" and {_KEEP}" if name != "excluded" else "")
        + f" order by token_id{' limit 50' if name == 'verbose' else ''}) q_{name}"
        for name, where in _ANY_SQL.items()
    ),
)
def sel_regex_any(spark, sf):
    return sel.select_many(sel.TokenTables(fx.vocab(spark, sf)), _ANY)


@query(
    "sel_all_pos",
    ["vocab", "lexicon"],
    f"select token, token_id from vocab where {_TAGGED.format(pos="'NOUN', 'VERB'")}",
)
def sel_all_pos(spark, sf):
    tables = _tables(spark, sf)
    return sel.all_synthetic(tables.tokens, tables, POS)


@query(
    "sel_all_custom",
    ["vocab"],
    f"""select c.token, v.token_id from (select distinct unnest({text_list(CUSTOM_WORDS + ['the', 'zzzz'])}) as token) c
    left join vocab v on v.token = c.token""",
)
def sel_all_custom(spark, sf):
    # The raw list, with the ids of those of its texts that are tokens.
    listed = sel.custom_values(spark, {"tokens": CUSTOM_WORDS + ["the", "zzzz"]})
    tokens = _tables(spark, sf).tokens
    known = sel.all_custom(tokens, {"tokens": CUSTOM_WORDS + ["zzzz"]})
    return listed.join(known, "token", "left")


@query(
    "sel_lstrip_marker",
    ["vocab"],
    "select token_id, token, ltrim(token, 'Ġ') as bare from vocab",
)
def sel_lstrip_marker(spark, sf):
    return fx.vocab(spark, sf).select(
        "token_id", "token", strip_space_marker("token").alias("bare")
    )


@query(
    "join_leaf_anti",
    ["vocab", "components"],
    f"select token, token_id from vocab where {LEAF} order by token_id",
)
def join_leaf_anti(spark, sf):
    return sel.leaf_tokens(_tables(spark, sf).tokens, fx.merges(spark, sf))


@query("top_frequency", ["vocab", "components"], _SQL["frequency"])
def top_frequency(spark, sf):
    return sel.select_tokens(_tables(spark, sf), FREQUENT_LEAVES)


@query(
    "top_frequency_all",
    ["vocab", "components"],
    f"select token, token_id from vocab where {LEAF} and {_KEEP} order by token_id",
)
def top_frequency_all(spark, sf):
    tables = _tables(spark, sf)
    return sel.all_frequency(tables.tokens, tables, {"leaf": True, "order": "least_frequent"})


@query(
    "top_vocab_head", ["vocab"], "select token, token_id from vocab order by token_id limit 100"
)
def top_vocab_head(spark, sf):
    return first_k(_tables(spark, sf).tokens, [F.asc("token_id")], 100)


@query(
    "top_merges_head",
    ["merges"],
    "select l, r, merge_rank from merges order by merge_rank limit 100",
)
def top_merges_head(spark, sf):
    return first_k(fx.merges(spark, sf), [F.asc("merge_rank")], 100)


@query("set_combined", _ALL_VIEWS, _SQL["combined"])
def set_combined(spark, sf):
    return sel.select_tokens(_tables(spark, sf), COMBINED)


@query(
    "sel_dispatch",
    _ALL_VIEWS,
    " union all ".join(
        f"select '{name}' as criteria, token, token_id from ({sql}) q_{name}"
        for name, sql in _SQL.items()
    ),
)
def sel_dispatch(spark, sf):
    return sel.select_many(fx.marked_tables(spark, sf), CRITERIA)


def _summary_sql(template: str, **values) -> str:
    """A fixed summary text as SQL that puts the count ``n`` in."""
    before, _, after = template.format(n="\0", **values).partition("\0")
    return f"{text_literal(before)} || n || {text_literal(after)}"


_SUMMARY_SQL = {
    "frequency": _summary_sql(SUMMARY_FREQUENCY, leaf=True, order="most_frequent"),
    "rare": _summary_sql(SUMMARY_FREQUENCY, leaf=False, order="least_frequent"),
    "regex": _summary_sql(SUMMARY_REGEX, pattern=DIGIT),
    "synthetic": _summary_sql(SUMMARY_SYNTHETIC, pos=["NOUN", "VERB"]),
    "custom": _summary_sql(SUMMARY_CUSTOM),
    "combined": _summary_sql(SUMMARY_COMBINED),
    "combined_regex": _summary_sql(SUMMARY_COMBINED),
}


def _uncut(name: str) -> str:
    return _SQL[name].split("order by")[0] if name.startswith("combined") else _SQL[name]


@query(
    "agg_token_count",
    _ALL_VIEWS,
    " union all ".join(
        f"select '{name}' as criteria, n as n_tokens, {_SUMMARY_SQL[name]} as summary "
        f"from (select count(*) as n from ({_uncut(name)}) q) c"
        for name in _SQL
    ),
)
def agg_token_count(spark, sf):
    return sel.summarise(fx.marked_tables(spark, sf), CRITERIA)


@query(
    "bpe_decompose",
    ["decomposed"],
    "select token, array_to_string(pieces, ' ') as pieces, depth from decomposed",
)
def bpe_decompose(spark, sf):
    found = decompose(fx.vocab(spark, sf), fx.merges(spark, sf))
    return found.select("token", F.array_join("pieces", " ").alias("pieces"), "depth")


_DEPTHS = (
    "(select v.token, v.token_id, d.depth, d.depth = 0 as is_leaf "
    "from vocab v join decomposed d on d.token = v.token) t"
)


@query("bpe_depth", ["vocab", "decomposed"], f"select * from {_DEPTHS}")
def bpe_depth(spark, sf):
    return fx.depths(spark, sf)


def _deepest():
    return [F.desc("depth"), F.asc("token_id")]


def _shallowest():
    return [F.asc("depth"), F.desc("token_id")]


@query(
    "top_merge_depth",
    ["vocab", "decomposed"],
    f"""select token, depth, case when is_leaf then 'Leaf' else 'Non-leaf' end as status
    from {_DEPTHS} order by depth desc, token_id limit 20""",
)
def top_merge_depth(spark, sf):
    status = F.when(F.col("is_leaf"), "Leaf").otherwise("Non-leaf")
    top = first_k(fx.depths(spark, sf), _deepest(), 20)
    return top.select("token", "depth", status.alias("status"))


@query(
    "bottom_merge_depth",
    ["vocab", "decomposed"],
    f"select token, depth from {_DEPTHS} order by depth, token_id desc limit 20",
)
def bottom_merge_depth(spark, sf):
    return first_k(fx.depths(spark, sf), _shallowest(), 20).select("token", "depth")


@query(
    "slice_merge_depth",
    ["vocab", "decomposed"],
    f"select token, depth from {_DEPTHS} order by depth, token_id desc limit 200 offset 1800",
)
def slice_merge_depth(spark, sf):
    # The rows 2000 to 1801 from the end of the list by falling depth.
    ordered = fx.depths(spark, sf).orderBy(*_shallowest())
    return ordered.offset(1800).limit(200).select("token", "depth")


@query(
    "top_leaf_tokens",
    ["vocab", "decomposed"],
    f"select token, token_id from {_DEPTHS} where is_leaf order by token_id desc limit 10000",
)
def top_leaf_tokens(spark, sf):
    leaves = fx.depths(spark, sf).where("is_leaf")
    return first_k(leaves, [F.desc("token_id")], 10000).select("token", "token_id")


@query(
    "join_token_ids",
    ["vocab", "bare", "bare_decomposed"],
    """select token, coalesce(string_agg(cast(token_id as varchar), ' ' order by nth), '') as ids from (
      select b.token, 1 as nth, v.token_id from bare b join vocab v on v.token = b.token
      union all
      select p.token, p.nth, v.token_id
      from (select token, unnest(pieces) as piece, unnest(generate_series(1, len(pieces))) as nth
            from bare_decomposed where token not in (select token from vocab)) p
      left join vocab v on v.token = p.piece) t group by token""",
)
def join_token_ids(spark, sf):
    bare = bare_counts(fx.vocab(spark, sf))
    found = token_ids(bare, fx.vocab(spark, sf), fx.merges(spark, sf))
    return found.select("token", F.array_join("ids", " ").alias("ids"))


@query(
    "ids_encode",
    ["vocab", "qa", "question_decomposed"],
    f"""select q.idx, coalesce(string_agg(cast(coalesce(v.token_id, 0) as varchar), ' '
        order by q.nth, p.nth), '') as ids
    from (select idx, unnest({words('question')}) as token,
            unnest(generate_series(1, len({words('question')}))) as nth from qa) q
    join (select token, unnest(pieces) as piece, unnest(generate_series(1, len(pieces))) as nth
          from question_decomposed) p on p.token = q.token
    left join vocab v on v.token = p.piece group by q.idx""",
)
def ids_encode(spark, sf):
    questions = fx.qa(spark, sf).select("idx", "question")
    ids = encode(
        questions, "idx", "question", fx.vocab(spark, sf), fx.merges(spark, sf), unknown_id=0
    )
    return ids.select("idx", F.array_join("ids", " ").alias("ids"))


@query("ids_decode", ["runs"], "select idx, free_output as normal, taboo_output as taboo from runs")
def ids_decode(spark, sf):
    saved = fx.saved_runs(spark, sf)
    texts = {"normal": "normal_text", "taboo": "taboo_text"}
    decoded = decode(saved, "idx", texts, fx.run_vocab(spark, sf))
    return decoded.select(
        "idx", F.col("normal_text").alias("normal"), F.col("taboo_text").alias("taboo")
    )
