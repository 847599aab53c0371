"""URL verdicts from a tree of path templates per host.

Segments that are numbers, long hexadecimal strings, dates and the like become
wildcards at once, where the urls are read, so a host's pages shrink to a few
counted shapes before any shuffle. The tree is then built level by level:

1. Below a node with many different children, children that each have only a
   small share become one wildcard.
2. Sibling branches are merged in the order of their share of good labels, as
   long as it does not change significantly; each merged branch is one. Branches
   without any label are one of their own: nothing says whom they are like.

A template's purity is its share of good labels, smoothed towards the share of
all pages; templates below a bar are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.llm.registry import query, table
from banlist.operators.lookup import lookup
from banlist.session import write_table

# A node with more children than this has variable ones.
MOST_CHILDREN = 50
# ... unless a child has at least this share of the node's pages.
OWN_SHARE = 0.1
# Branches whose shares are within so many standard errors are alike.
ALIKE = 2.0
SMOOTHING = 20.0
LEAST_PURITY = 0.5
# Levels of the tree; what lies deeper is one segment, spelled in full.
MOST_SEGMENTS = 12
_DEEPER = "\x00"

# Rules of the query, longest fitting one wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: str) -> tuple[Column, Column]:
    """The text between the first ``://`` and the next of ``/ ? #``, A-Z
    lower-cased, and the rest up to ``?`` or ``#``; both empty without ``://``."""
    raw = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", raw)
    rest = F.when(at > 0, F.substring(raw, at + 3, F.length(raw))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def rule_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    fitting_rule = fitting = F.lit(None).cast("string")
    for verdict, own_host, own_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        inside = (host == own_host) | host.endswith("." + own_host)
        fits = inside & path.startswith(own_path)
        fitting_rule = F.when(fits, F.lit(own_host + own_path)).otherwise(fitting_rule)
        fitting = F.when(fits, F.lit(verdict)).otherwise(fitting)
    return fitting_rule, fitting


def segment_shape(segment: Column) -> Column:
    """A segment with variable parts as wildcards; an extension stays."""
    kinds = (
        (r"^[0-9]+$", "{n}"),
        (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"),
        (r"^(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", "{uuid}"),
        (r"^(?i)(?=.*[0-9])[0-9a-f]{8,}$", "{hex}"),
        (r"^.*[0-9].*[0-9].*$", "{id}"),
    )
    stem = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", 1)
    extension = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", 2)
    shape = stem
    for pattern, name in reversed(kinds):
        shape = F.when(stem.rlike(pattern), F.lit(name)).otherwise(shape)
    return F.concat(shape, extension)


def path_shape(path: Column) -> Column:
    """All segments' shapes. Those deeper than MOST_SEGMENTS stay together as one, so
    paths that differ there only still have shapes of their own."""
    shapes = F.transform(F.split(path, "/", -1), segment_shape)
    deeper = F.array_join(F.slice(shapes, F.lit(MOST_SEGMENTS + 1), F.size(shapes)), _DEEPER)
    head = F.array_join(F.slice(shapes, F.lit(1), F.lit(MOST_SEGMENTS)), "/")
    return F.when(F.size(shapes) > MOST_SEGMENTS, F.concat_ws("/", head, deeper)).otherwise(head)


def _merge_alike(branches: Column) -> Column:
    """Sorted branches as merged ones ``(names, labelled, good)``.

    In order of their good share, a branch joins the merged one before it unless
    the two shares differ significantly, or only one of them has labels.
    """
    none = F.expr("cast(array() as array<struct<names:array<string>,labelled:bigint,good:double>>)")

    def single(b: Column) -> Column:
        return F.struct(F.array(b["named"]).alias("names"), b["labelled"].alias("labelled"), b["good"].alias("good"))

    def step(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        labelled, good = last["labelled"] + b["labelled"], last["good"] + b["good"]
        share = (good + 1) / (labelled + 2)
        error = F.sqrt(share * (1 - share) * (1 / last["labelled"] + 1 / b["labelled"]))
        far = F.abs(b["good"] / b["labelled"] - last["good"] / last["labelled"]) > ALIKE * error
        both = (last["labelled"] > 0) & (b["labelled"] > 0)
        apart = F.when(both, far).otherwise((last["labelled"] > 0) | (b["labelled"] > 0))
        joined = F.struct(F.array_append(last["names"], b["named"]).alias("names"), labelled.alias("labelled"), good.alias("good"))
        return F.when(F.size(done) == 0, F.array(single(b))).otherwise(
            F.when(apart, F.array_append(done, single(b))).otherwise(
                F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), joined)
            )
        )

    return F.aggregate(branches, none, step)


def build_tree(shapes: DataFrame) -> DataFrame:
    """``(host, shape, template)`` from counted shapes
    ``(host, shape, pages, labelled, good)``.

    Each level is one pass over the shapes' counts and is written below the
    checkpoint folder. A very large host is no group of its own here: shapes
    are pre-aggregated by node and child, and once the variable children of a
    node are one, it has at most MOST_CHILDREN + 1 / OWN_SHARE + 1 branches.
    """
    deepest = shapes.agg(F.max(F.size(F.split("shape", "/")))).first()[0] or 0
    sums = ("pages", "labelled", "good")
    state = shapes.withColumn("node", F.lit("")).withColumn("parts", F.split("shape", "/"))
    for level in range(deepest):
        step = state.withColumn("child", F.get("parts", F.lit(level)))
        children = step.where(F.col("child").isNotNull()).groupBy("host", "node", "child")
        children = write_table(children.agg(*[F.sum(c).alias(c) for c in sums]), "url-children")
        nodes = children.groupBy("host", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("pages").alias("all_pages"))
        variable = (F.col("n") > MOST_CHILDREN) & (F.col("pages") < OWN_SHARE * F.col("all_pages"))
        named = children.join(nodes, ["host", "node"]).withColumn(
            "named", F.when(variable, F.lit("*")).otherwise(F.col("child"))
        )
        branches = named.groupBy("host", "node", "named").agg(*[F.sum(c).alias(c) for c in sums])
        ordered = F.struct(
            (F.col("good") / F.nullif(F.col("labelled"), F.lit(0))).alias("share"), "named", "labelled", "good"
        )
        merged = branches.groupBy("host", "node").agg(F.array_sort(F.collect_list(ordered)).alias("branches"))
        merged = merged.select("host", "node", _merge_alike(F.col("branches")).alias("m"))
        exploded = merged.select("host", "node", F.size("m").alias("n"), F.explode("m.names").alias("names"))
        segment = (
            F.when(F.size("names") == 1, F.element_at("names", 1))
            .when(F.col("n") == 1, F.lit("*"))
            .otherwise(F.concat(F.lit("("), F.array_join(F.array_sort("names"), "|"), F.lit(")")))
        )
        renamed = exploded.select("host", "node", segment.alias("segment"), F.explode("names").alias("named"))
        mapping = named.join(renamed, ["host", "node", "named"]).select("host", "node", "child", "segment")
        state = write_table(
            step.join(mapping, ["host", "node", "child"], "left").withColumn(
                "node",
                F.when(F.col("child").isNull(), F.col("node")).otherwise(
                    F.concat_ws("/", "node", "segment") if level else F.col("segment")
                ),
            ).drop("child", "segment"),
            "url-nodes",
        )
    return state.select("host", "shape", F.col("node").alias("template"))


def judge(
    pages: DataFrame, key: str = "page_id", url: str = "url", label: str = "label", rules=RULES
) -> DataFrame:
    """``(key, host, path, rule, verdict, template, purity)`` of every page.

    ``label`` is 1 for a good page, 0 for a bad one, null where unknown. A null
    url, or one without ``://``, has an empty host and path and is judged as
    such. Repeated rows and null keys stay rows of their own; an empty table
    gives an empty result. Without any label every template is allowed.
    """
    host, path = host_and_path(url)
    split = pages.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"), host.alias("host"), path.alias("path"))
    shaped = split.withColumn("shape", path_shape(F.col("path")))
    shapes = write_table(
        shaped.groupBy("host", "shape").agg(
            F.count(F.lit(1)).alias("pages"),
            F.count("label").alias("labelled"),
            F.coalesce(F.sum("label"), F.lit(0.0)).alias("good"),
        ),
        "url-shapes",
    )
    tree = write_table(build_tree(shapes), "url-tree")
    total = shapes.agg(F.sum("good") / F.nullif(F.sum("labelled"), F.lit(0))).first()[0]
    base = 1.0 if total is None else total
    purity = (F.sum("good") + F.lit(SMOOTHING * base)) / (F.sum("labelled") + F.lit(SMOOTHING))
    templates = (
        shapes.join(tree, ["host", "shape"]).groupBy("host", "template").agg(purity.alias("purity"))
    )
    # One row per shape, found by one key; the urls themselves are not shuffled
    # while the shapes fit a broadcast, and very common shapes are salted beyond.
    by_shape = write_table(
        tree.join(templates, ["host", "template"]).select(
            F.concat_ws(" ", "host", "shape").alias("place"), "template", "purity"
        ),
        "url-verdicts",
    )
    found = lookup(shaped.withColumn("place", F.concat_ws(" ", "host", "shape")), by_shape, "place")
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow")
    return found.select(
        F.col("key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.translate("template", _DEEPER, "/").alias("template"), "purity"
    )


@query("op1_url_template_verdicts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the quality of the document its last path number names."""
    _, path = host_and_path("url")
    number = F.regexp_extract(path, r"([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    pages = pages.withColumn("named", F.when(number != "", number.cast("bigint")))
    quality = (
        table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.avg("quality").alias("label")).withColumnRenamed("doc_id", "named")
    )
    return judge(pages.join(quality, "named", "left"))
