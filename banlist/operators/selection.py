"""Selecting banned tokens from a vocabulary table by criteria.

A vocabulary is ``(token, token_id)``; ids rise as tokens get rarer. Merge
rules are ``(l, r, merge_rank)``. A lexicon is ``(token, pos)`` by bare token.
Criteria are plain dictionaries, as read from JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banlist.functions import fixed_values as fixed
from banlist.functions.text import (
    regex_match_start,
    regex_search,
    remove_space_marker,
    strip_space_marker,
)
from banlist.operators.ranking import first_k, with_index
from banlist.session import write_table

# Lists up to this length stay in the plan as a hash set; longer ones are joined.
_LITERAL_VALUES = 5_000

_IS_LEAF = "__is_leaf"
_TAGS = "__tags"

Criteria = Mapping[str, Any]


@dataclass(frozen=True)
class TokenTables:
    """The tables a selection reads. ``tagger`` may stand in for the lexicon."""

    vocab: DataFrame
    merges: DataFrame | None = None
    lexicon: DataFrame | None = None
    tagger: Callable[[pd.Series], pd.Series] | None = None

    @property
    def tokens(self) -> DataFrame:
        marks = [c for c in (_IS_LEAF, _TAGS) if c in self.vocab.columns]
        return self.vocab.select("token", "token_id", *marks)

    def marked(self, leaf: bool, tags: bool) -> TokenTables:
        """Tables whose vocabulary carries leaf marks and tags as columns.

        Many criteria then share one join each, and are plain filters.
        """
        vocab = self.tokens
        if leaf and self.merges is not None:
            parts = merge_components(self.merges).withColumn(_IS_LEAF, F.lit(False))
            vocab = vocab.join(parts, "token", "left").withColumn(
                _IS_LEAF, F.coalesce(_IS_LEAF, F.lit(True))
            )
        if tags and self.tagger is not None:
            tag = F.pandas_udf(self.tagger, "string")(strip_space_marker("token"))
            vocab = vocab.withColumn(_TAGS, F.array(tag))
        elif tags and self.lexicon is not None:
            by_token = self.lexicon.groupBy(F.col("token").alias("__bare")).agg(
                F.collect_set("pos").alias(_TAGS)
            )
            vocab = (
                vocab.withColumn("__bare", strip_space_marker("token"))
                .join(by_token, "__bare", "left")
                .drop("__bare")
            )
        return replace(self, vocab=write_table(vocab, "marked-vocabulary"))


def tagged_lexicon(vocab: DataFrame, load: Callable[[], Callable[[pd.Series], pd.Series]]) -> DataFrame:
    """A stored lexicon ``(token, pos)`` of the distinct bare tokens, by a loaded tagger.

    ``load`` gives the tagger, a function of a batch of texts. It is called once a task,
    on the executor, so a tagger with a large model is loaded as often as there are
    tasks and not as there are batches; each bare token is tagged once.
    """

    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = load()
        for batch in batches:
            yield tagger(batch)

    tag.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    bare = vocab.select(strip_space_marker("token").alias("token")).where(F.col("token") != "").distinct()
    return write_table(bare.withColumn("pos", F.pandas_udf(tag, "string")("token")), "tagged-lexicon")


def parse_criteria(criteria: str | Criteria) -> Criteria:
    if isinstance(criteria, str):
        try:
            criteria = json.loads(criteria)
        except json.JSONDecodeError as error:
            raise ValueError("Failed to parse criteria.") from error
    return {k: v for k, v in criteria.items() if v is not None}


def not_excluded(patterns: Sequence[str] | None = None, token: str = "token") -> Column:
    """True for tokens that no exclusion pattern matches at their start."""
    if patterns is None:
        patterns = fixed.DEFAULT_EXCLUDE_REGEXES
    keep = F.lit(True)
    for pattern in patterns:
        keep = keep & ~regex_match_start(token, pattern)
    return keep


def exclude(df: DataFrame, patterns: Sequence[str] | None = None) -> DataFrame:
    return df.where(not_excluded(patterns))


def _where_in(df: DataFrame, value: Column, values: Sequence[str]) -> DataFrame:
    values = sorted(set(values))
    if len(values) <= _LITERAL_VALUES:
        return df.where(value.isin(values))
    listed = df.sparkSession.createDataFrame([(v,) for v in values], "__value string")
    return (
        df.withColumn("__value", value).join(listed, "__value", "left_semi").drop("__value")
    )


def merge_components(merges: DataFrame) -> DataFrame:
    """Every token that some merge rule takes as its left or right part."""
    parts = F.explode(F.array("l", "r")).alias("token")
    return merges.select(parts).distinct()


def leaf_tokens(df: DataFrame, merges: DataFrame) -> DataFrame:
    """Tokens that are no component of any merge rule."""
    return df.join(merge_components(merges), "token", "left_anti")


def _leaves(df: DataFrame, tables: TokenTables) -> DataFrame:
    if _IS_LEAF in df.columns:
        return df.where(_IS_LEAF)
    return leaf_tokens(df, _require(tables.merges, "merge rules"))


def _require(table: Any, what: str) -> Any:
    if table is None:
        raise ValueError(f"this criterion needs {what}")
    return table


def _descending(order: str) -> bool:
    return order.lower() == "least_frequent"


def _by_id(descending: bool) -> list[Column]:
    return [F.desc("token_id") if descending else F.asc("token_id")]


def _tagged(df: DataFrame, tables: TokenTables, pos: Sequence[str]) -> DataFrame:
    if not pos:
        return df.where(F.lit(False))
    bare = strip_space_marker("token")
    if _TAGS in df.columns:
        wanted_tags = F.array(*[F.lit(p) for p in pos])
        return df.where((bare != "") & F.arrays_overlap(_TAGS, wanted_tags))
    if tables.tagger is not None:
        tag = F.pandas_udf(tables.tagger, "string")
        return df.where((bare != "") & tag(bare).isin(list(pos)))
    lexicon = _require(tables.lexicon, "a lexicon or a tagger")
    wanted = lexicon.where(F.col("pos").isin(list(pos))).select(F.col("token").alias("__bare"))
    return (
        df.withColumn("__bare", bare)
        .where(F.col("__bare") != "")
        .join(wanted, "__bare", "left_semi")
        .drop("__bare")
    )


def select_frequency(tables: TokenTables, criteria: Criteria) -> DataFrame:
    """First k tokens by id, optionally leaves only. The cut comes before the
    exclusion, so fewer than k tokens may be left."""
    tokens = tables.tokens
    if criteria.get("leaf", False):
        tokens = _leaves(tokens, tables)
    order = criteria.get("order", fixed.DEFAULT_ORDER)
    tokens = first_k(tokens, _by_id(_descending(order)), criteria.get("k"))
    return exclude(tokens, criteria.get("exclude_regexes"))


def select_synthetic(tables: TokenTables, criteria: Criteria) -> DataFrame:
    """Tokens with one of the wanted tags. ``k`` is not used."""
    tagged = _tagged(tables.tokens, tables, criteria.get("pos", []))
    return exclude(tagged, criteria.get("exclude_regexes"))


def select_custom(tables: TokenTables, criteria: Criteria) -> DataFrame:
    """Tokens whose text without any word-start marker is listed."""
    bare = remove_space_marker("token")
    listed = _where_in(tables.tokens, bare, criteria.get("tokens", []))
    return exclude(listed, criteria.get("exclude_regexes"))


def select_regex(
    tables: TokenTables, criteria: Criteria, exclude_regexes: Sequence[str] | None = None
) -> DataFrame:
    """Tokens the pattern is found in; the cut to k comes after the exclusion."""
    pattern = criteria.get("pattern")
    if not pattern:
        return tables.tokens.where(F.lit(False))
    found = tables.tokens.where(regex_search("token", pattern))
    patterns = exclude_regexes if exclude_regexes is not None else criteria.get("exclude_regexes")
    return first_k(exclude(found, patterns), [F.asc("token_id")], criteria.get("k"))


def all_frequency(
    candidates: DataFrame,
    tables: TokenTables,
    criteria: Criteria,
    exclude_regexes: Sequence[str] | None = None,
) -> DataFrame:
    """Candidates that pass a frequency sub-criterion. No cut is made, and the
    exclusion only applies when an order is given."""
    if criteria.get("leaf", False):
        candidates = _leaves(candidates, tables)
    if criteria.get("order"):
        candidates = exclude(candidates, exclude_regexes)
    return candidates


def all_synthetic(candidates: DataFrame, tables: TokenTables, criteria: Criteria) -> DataFrame:
    """Candidates with one of the wanted tags; nothing is excluded."""
    return _tagged(candidates, tables, criteria.get("pos", []))


def all_custom(candidates: DataFrame, criteria: Criteria) -> DataFrame:
    """Candidates that are listed exactly as spelled."""
    return _where_in(candidates, F.col("token"), criteria.get("tokens", []))


def custom_values(spark, criteria: Criteria) -> DataFrame:
    """The distinct listed texts themselves, whether in the vocabulary or not."""
    values = [(v,) for v in criteria.get("tokens", [])]
    return spark.createDataFrame(values, "token string").distinct()


def select_combined(tables: TokenTables, criteria: Criteria) -> DataFrame:
    """Tokens that pass every sub-criterion, highest ids first, cut to k.

    The intersection is a chain of filters and semi joins over one scan of the
    vocabulary, so no set is built or shuffled just to be intersected.
    """
    subs = criteria.get("criteria") or []
    candidates = tables.tokens
    if not subs:
        return candidates.where(F.lit(False))
    patterns = criteria.get("exclude_regexes")
    for sub in map(parse_criteria, subs):
        kind = sub.get("criterion")
        if kind == "frequency":
            candidates = all_frequency(candidates, tables, sub, patterns)
        elif kind == "synthetic":
            candidates = all_synthetic(candidates, tables, sub)
        elif kind == "custom":
            candidates = all_custom(candidates, sub)
        elif kind == "regex" and sub.get("k") is None and sub.get("pattern"):
            candidates = exclude(
                candidates.where(regex_search("token", sub["pattern"])), patterns
            )
        elif kind == "regex":
            own = {k: v for k, v in sub.items() if k != "exclude_regexes"}
            chosen = select_regex(tables, own, patterns).select("token")
            candidates = candidates.join(chosen, "token", "left_semi")
        else:
            candidates = candidates.where(F.lit(False))
    return first_k(candidates, _by_id(True), criteria.get("k"))


_SELECTORS = {
    "frequency": select_frequency,
    "synthetic": select_synthetic,
    "custom": select_custom,
    "regex": select_regex,
    "combined": select_combined,
}


def select_tokens(tables: TokenTables, criteria: str | Criteria) -> DataFrame:
    """``(token, token_id)`` of the tokens one criterion selects."""
    criteria = parse_criteria(criteria)
    kind = criteria.get("type")
    if kind not in _SELECTORS:
        raise ValueError("Invalid selection type.")
    return _SELECTORS[kind](tables, criteria).select("token", "token_id")


def list_order(criteria: str | Criteria) -> list[Column]:
    """The order in which a criterion lists its tokens."""
    criteria = parse_criteria(criteria)
    kind = criteria.get("type")
    if kind == "combined":
        return _by_id(True)
    if kind == "frequency":
        return _by_id(_descending(criteria.get("order", fixed.DEFAULT_ORDER)))
    return _by_id(False)


def with_shared_marks(
    tables: TokenTables, criteria: Mapping[str, str | Criteria]
) -> TokenTables:
    """Mark the vocabulary once with what the criteria ask for: leaves and tags."""
    parsed = [parse_criteria(one) for one in criteria.values()]
    single = [part for one in parsed for part in (one, *one.get("criteria", []))]
    columns = tables.vocab.columns
    leaf = _IS_LEAF not in columns and any(part.get("leaf") for part in single)
    tags = _TAGS not in columns and any(part.get("pos") for part in single)
    return tables.marked(leaf, tags) if leaf or tags else tables


@dataclass(frozen=True)
class _Filter:
    """A criterion as a condition on a marked token, with an optional cut.

    The cut takes the first k that meet ``found`` by falling or rising id;
    ``kept`` is asked of those that are left.
    """

    found: Column
    kept: Column
    descending: bool = False
    k: int | None = None


def _leaf_condition(tables: TokenTables) -> Column:
    _require(tables.merges, "merge rules")
    return F.col(_IS_LEAF)


def _tag_condition(tables: TokenTables, pos: Sequence[str]) -> Column:
    if not pos:
        return F.lit(False)
    if tables.tagger is None:
        _require(tables.lexicon, "a lexicon or a tagger")
    wanted = F.array(*[F.lit(p) for p in pos])
    found = F.coalesce(F.arrays_overlap(_TAGS, wanted), F.lit(False))
    return (strip_space_marker("token") != "") & found


def _listed_condition(value: Column, values: Sequence[str]) -> Column | None:
    values = sorted(set(values))
    return value.isin(values) if len(values) <= _LITERAL_VALUES else None


def _as_filter(tables: TokenTables, one: Criteria) -> _Filter | None:
    """The criterion as a filter of the marked vocabulary, if it is one."""
    kind, always = one.get("type"), F.lit(True)
    patterns = one.get("exclude_regexes")
    if kind == "frequency":
        found = _leaf_condition(tables) if one.get("leaf", False) else always
        order = _descending(one.get("order", fixed.DEFAULT_ORDER))
        return _Filter(found, not_excluded(patterns), order, one.get("k"))
    if kind == "synthetic":
        found = _tag_condition(tables, one.get("pos", []))
        return _Filter(found & not_excluded(patterns), always)
    if kind == "custom":
        found = _listed_condition(remove_space_marker("token"), one.get("tokens", []))
        return None if found is None else _Filter(found & not_excluded(patterns), always)
    if kind == "regex":
        if not one.get("pattern"):
            return _Filter(F.lit(False), always)
        found = regex_search("token", one["pattern"]) & not_excluded(patterns)
        return _Filter(found, always, False, one.get("k"))
    if kind != "combined":
        raise ValueError("Invalid selection type.")
    found = F.lit(bool(one.get("criteria")))
    for sub in map(parse_criteria, one.get("criteria") or []):
        part = always
        if sub.get("criterion") == "frequency":
            part = _leaf_condition(tables) if sub.get("leaf", False) else always
            part = part & not_excluded(patterns) if sub.get("order") else part
        elif sub.get("criterion") == "synthetic":
            part = _tag_condition(tables, sub.get("pos", []))
        elif sub.get("criterion") == "custom":
            part = _listed_condition(F.col("token"), sub.get("tokens", []))
        elif sub.get("criterion") == "regex" and not sub.get("pattern"):
            part = F.lit(False)
        elif sub.get("criterion") == "regex":
            # A cut inside a combination is a selection of its own.
            cut = sub.get("k") is not None
            part = None if cut else regex_search("token", sub["pattern"]) & not_excluded(patterns)
        else:
            part = F.lit(False)
        if part is None:
            return None
        found = found & part
    return _Filter(found, always, True, one.get("k"))


def selected_rows(tables: TokenTables, criteria: Mapping[str, str | Criteria]) -> DataFrame:
    """``(criteria, token, token_id, within)`` for a whole set of named criteria.

    One scan of the marked vocabulary asks every criterion, and one numbering
    of the rows found makes all cuts to k. ``within`` is false for what a
    combined criterion finds beyond its cut, which its summary counts. Criteria
    with very long lists, or with a cut inside, are selected on their own.
    """
    if not criteria:
        raise ValueError("no criteria given")
    parsed = {name: parse_criteria(one) for name, one in criteria.items()}
    tables = with_shared_marks(tables, parsed)
    filters = {name: _as_filter(tables, one) for name, one in parsed.items()}
    parts = [_selected_alone(tables, name, parsed[name]) for name, f in filters.items() if f is None]
    shared = {name: f for name, f in filters.items() if f is not None}
    if any(f.k is not None and f.k < 0 for f in shared.values()):
        raise ValueError("k must not be negative")
    if shared:
        found = F.array(
            *[
                F.when(
                    f.found if f.k is not None else f.found & f.kept,
                    F.struct(
                        F.lit(name).alias("criteria"),
                        (-F.col("token_id") if f.descending else F.col("token_id")).alias("key"),
                        f.kept.alias("kept"),
                        F.lit(f.k is not None).alias("cut"),
                    ),
                )
                for name, f in shared.items()
            ]
        )
        rows = tables.tokens.select("token", "token_id", F.inline(F.filter(found, lambda x: x.isNotNull())))
        parts.append(rows.where(~F.col("cut")).select("criteria", "token", "token_id", F.lit(True).alias("within")))
        cuts = {name: f.k for name, f in shared.items() if f.k is not None}
        if cuts:
            combined = [name for name in cuts if parsed[name].get("type") == "combined"]
            placed = with_index(rows.where("cut"), ["criteria", "key"], "__place")
            starts = placed.groupBy("criteria").agg(F.min("__place").alias("__start"))
            limits = tables.vocab.sparkSession.createDataFrame([*cuts.items()], "criteria string, __k long")
            # As many rows as criteria.
            limits = F.broadcast(starts.join(limits, "criteria"))
            within = F.col("__place") - F.col("__start") < F.col("__k")
            parts.append(
                placed.join(limits, "criteria")
                .select("criteria", "token", "token_id", within.alias("within"), "kept")
                .where(F.col("kept") & (F.col("within") | F.col("criteria").isin(combined)))
                .drop("kept")
            )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _selected_alone(tables: TokenTables, name: str, one: Criteria) -> DataFrame:
    chosen = select_tokens(tables, one).withColumn("within", F.lit(True))
    if one.get("type") == "combined" and one.get("k") is not None:
        whole = select_tokens(tables, {k: v for k, v in one.items() if k != "k"})
        chosen = whole.join(chosen.select("token_id", "within"), "token_id", "left")
        chosen = chosen.withColumn("within", F.coalesce("within", F.lit(False)))
    return chosen.select(F.lit(name).alias("criteria"), "token", "token_id", "within")


def select_many(tables: TokenTables, criteria: Mapping[str, str | Criteria]) -> DataFrame:
    """``(criteria, token, token_id)`` for a whole set of named criteria."""
    return selected_rows(tables, criteria).where("within").drop("within")


def _summary_format(criteria: Criteria) -> str:
    kind = criteria.get("type")
    if kind == "frequency":
        return fixed.SUMMARY_FREQUENCY.format(
            n="%d",
            leaf=criteria.get("leaf", False),
            order=criteria.get("order", fixed.DEFAULT_ORDER),
        )
    if kind == "synthetic":
        return fixed.SUMMARY_SYNTHETIC.format(n="%d", pos=list(criteria.get("pos", [])))
    if kind == "custom":
        return fixed.SUMMARY_CUSTOM
    if kind == "regex":
        return fixed.SUMMARY_REGEX if criteria.get("pattern") else fixed.SUMMARY_NO_PATTERN
    return fixed.SUMMARY_COMBINED if criteria.get("criteria") else fixed.SUMMARY_NO_SUB_CRITERIA


def summarise(
    tables: TokenTables, criteria: Mapping[str, str | Criteria], selected: DataFrame | None = None
) -> DataFrame:
    """``(criteria, n_tokens, summary)``: the size of each selection, in words.

    A combined criterion counts the tokens before its own cut to k. Rows of
    ``selected_rows`` that are there already are not selected again.
    """
    texts = []
    for name, one in criteria.items():
        one = parse_criteria(one)
        parts = _summary_format(one).replace("%d", "{n}")
        parts = parts.replace("{pattern}", str(one.get("pattern")))
        before, found, after = parts.partition("{n}")
        texts.append((name, before, bool(found), after))
    rows = selected_rows(tables, criteria) if selected is None else selected
    counts = rows.groupBy("criteria").agg(F.count(F.lit(1)).alias("n"))
    spark = tables.vocab.sparkSession
    words = spark.createDataFrame(
        texts, "criteria string, before string, counted boolean, after string"
    )
    n_tokens = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return words.join(counts, "criteria", "left").select(
        "criteria",
        n_tokens.alias("n_tokens"),
        F.when(F.col("counted"), F.concat("before", n_tokens.cast("string"), "after"))
        .otherwise(F.col("before"))
        .alias("summary"),
    )


def compare_selections(
    saved: DataFrame, fresh: DataFrame, reference_rule: bool = False
) -> DataFrame:
    """One row: tokens only in the saved list, only in the fresh one, and
    whether the lists count as different.

    By default any difference counts. ``reference_rule`` asks for differences
    in both directions.
    """
    # One full pass with partial counts instead of two set differences.
    sides = saved.select("token", F.lit(1).alias("s"), F.lit(0).alias("f")).unionByName(
        fresh.select("token", F.lit(0).alias("s"), F.lit(1).alias("f"))
    )
    per_token = sides.groupBy("token").agg(F.max("s").alias("s"), F.max("f").alias("f"))
    counts = per_token.agg(
        F.count_if((F.col("s") == 1) & (F.col("f") == 0)).alias("only_saved"),
        F.count_if((F.col("s") == 0) & (F.col("f") == 1)).alias("only_fresh"),
    )
    gone, new = F.col("only_saved") > 0, F.col("only_fresh") > 0
    return counts.withColumn("differs", (gone & new) if reference_rule else (gone | new))
