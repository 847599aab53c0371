"""Prompt texts and chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from banlist.functions.fixed_values import (
    BLOCK_SEPARATOR,
    QA_BEFORE_QUESTION,
    QA_HEAD,
    QA_TAIL,
    SAMPLE_SEED,
    SYSTEM_MESSAGE,
)
from banlist.functions.text import example_text, strip
from banlist.operators.lookup import lookup
from banlist.operators.ranking import with_index
from banlist.operators.sampling import sample_per_row, sample_rank
from banlist.session import write_table

# Rows per part of a running text, and parts that are joined at a time when it is written out.
RUNNING_BLOCK = 512
RUNNING_FAN = 32


def text_or_empty(df: DataFrame, name: str) -> Column:
    """A text column, or empty text where the table or the row has none."""
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def full_answer(df: DataFrame, reference_concat: bool = True) -> Column:
    """The answer shown in prompts and tables: both answer columns joined.

    Tables that carry the same answer in both columns show it twice; pass
    ``reference_concat=False`` to take the first one that has text.
    """
    first, second = text_or_empty(df, "correct_answer"), text_or_empty(df, "answer")
    if reference_concat:
        return F.concat(first, second)
    return F.when(first != "", first).otherwise(second)


def _block(df: DataFrame, reference_concat: bool) -> Column:
    return F.concat(
        F.lit("Question: "), text_or_empty(df, "question"),
        F.lit("\n"), text_or_empty(df, "chain_of_thought"),
        F.lit("\nAnswer: "), full_answer(df, reference_concat),
    )


def _ordered_blocks(examples: DataFrame, seed: int, idx: str, reference_concat: bool) -> Column:
    # The examples are the few rows of one few-shot sample, in sampling order.
    place = F.struct(
        sample_rank(seed, idx).alias("r"),
        F.col(idx).alias("i"),
        _block(examples, reference_concat).alias("block"),
    )
    return F.sort_array(F.collect_list(place))["block"]


def few_shot_text(
    examples: DataFrame, seed: int = SAMPLE_SEED, idx: str = "idx", reference_concat: bool = True
) -> DataFrame:
    """One row, ``few_shot``: the example blocks as one text."""
    blocks = _ordered_blocks(examples, seed, idx, reference_concat)
    return examples.agg(F.array_join(blocks, BLOCK_SEPARATOR).alias("few_shot"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def few_shot_chat(
    examples: DataFrame, seed: int = SAMPLE_SEED, idx: str = "idx", reference_concat: bool = True
) -> DataFrame:
    """One row, ``messages``: a system message and, when there are examples,
    one user message with every block."""
    blocks = _ordered_blocks(examples, seed, idx, reference_concat)
    closed = F.array_join(F.transform(blocks, lambda b: F.concat(b, F.lit(BLOCK_SEPARATOR))), "")
    system = message("system", F.lit(SYSTEM_MESSAGE))
    return examples.agg(
        F.when(F.count(F.lit(1)) > 0, F.array(system, message("user", closed)))
        .otherwise(F.array(system))
        .alias("messages")
    )


def qa_prompt(few_shot: Column, question: Column) -> Column:
    return F.concat(
        F.lit(QA_HEAD), few_shot, F.lit(QA_BEFORE_QUESTION), question, F.lit(QA_TAIL)
    )


def with_qa_prompt(rows: DataFrame, examples: DataFrame, **options) -> DataFrame:
    """Rows with ``prompt``: the shared examples and the row's own question."""
    shared = few_shot_text(examples, **options).scalar()
    return rows.withColumn("prompt", qa_prompt(shared, text_or_empty(rows, "question")))


def kshot_prompts(
    rows: DataFrame,
    pool: DataFrame,
    k: int,
    seed: int = SAMPLE_SEED,
    key: str = "idx",
    sep: str = "\n",
) -> DataFrame:
    """``(key, prompt)``: k examples drawn for the row, then its question.

    ``sep`` follows each example: a newline, or nothing.
    """
    own = example_text("question", "answer")
    examples = pool.select(
        F.col(key).alias("__pool"), F.concat(own, F.lit(sep)).alias("example")
    )
    drawn = sample_per_row(rows.select(key), examples, k, key, seed, "__pool")
    heads = drawn.groupBy(key).agg(
        F.array_join(
            F.sort_array(F.collect_list(F.struct("draw", "example")))["example"], ""
        ).alias("head")
    )
    question = F.concat(F.lit("Question: "), strip("question"), F.lit("\nAnswer:"))
    return rows.join(heads, key, "left").select(
        key, F.concat(F.coalesce("head", F.lit("")), question).alias("prompt")
    )


def running_parts(
    df: DataFrame, idx: str, text: str, by: str | None = None, block: int = RUNNING_BLOCK
) -> DataFrame:
    """``(run, part, text, rows)``: running texts in the space of the texts alone.

    A run's rows, by ``idx``, fall into parts of at most ``block`` rows. A part
    has its rows' texts joined, and for each row ``(idx, chars)``: the row's
    running text is all earlier parts of the run and this part's first
    ``chars`` code points. ``by`` names the run a row belongs to, without it all
    rows are one; rows with a null there are a run as well, and null texts are
    empty. ``run`` is the place of the run's first row among all rows. No task
    holds more than a part, so a run may have any number of rows.
    """
    key = F.to_json(F.struct(F.col(by).alias("k"))) if by else F.lit("")
    rows = df.select(key.alias("key"), F.col(idx).alias("idx"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    numbered = with_index(rows, ["key", "idx", "t"], "at")
    starts = numbered.groupBy("key").agg(F.min("at").alias("run"))
    placed = lookup(numbered, starts, "key").withColumn(
        "part", F.floor((F.col("at") - F.col("run")) / F.lit(block)).cast("bigint")
    )
    inside = Window.partitionBy("run", "part").orderBy("at")
    parts = placed.withColumn("chars", F.sum(F.length("t")).over(inside)).groupBy("run", "part").agg(
        F.array_sort(F.collect_list(F.struct("at", "idx", "chars", "t"))).alias("own")
    )
    places = F.transform("own", lambda r: F.struct(r["idx"].alias("idx"), r["chars"].alias("chars")))
    return write_table(
        parts.select("run", "part", F.array_join("own.t", "").alias("text"), places.alias("rows")), "running-parts"
    )


def expand_running(parts: DataFrame, idx: str = "idx", out: str = "text") -> DataFrame:
    """``(idx, out)``: every row's whole running text, from `running_parts`.

    The output grows with the square of a run's rows: that is its definition.
    """
    last = parts.agg(F.max("part")).first()[0] or 0
    whole = parts.join(_texts_before(parts.select("run", "part", "text"), last), ["run", "part"])
    prefix = F.substring(F.col("text"), F.lit(1), F.col("row.chars").cast("int"))
    return whole.select("before", "text", F.explode("rows").alias("row")).select(
        F.col("row.idx").alias(idx), F.concat("before", prefix).alias(out)
    )


def _texts_before(parts: DataFrame, last: int) -> DataFrame:
    """``(run, part, before)``: the texts of all parts before joined. Some parts at
    a time are joined to larger ones, until a run is one."""
    if last == 0:
        return parts.select("run", "part", F.lit("").alias("before"))
    larger = parts.groupBy("run", F.floor(F.col("part") / F.lit(RUNNING_FAN)).cast("bigint").alias("above")).agg(
        F.array_sort(F.collect_list(F.struct("part", "text"))).alias("own")
    )
    inside = larger.select("run", "above", "own", F.posexplode("own").alias("at", "row")).select(
        "run",
        "above",
        F.col("row.part").alias("part"),
        F.array_join(F.slice(F.col("own.text"), F.lit(1), F.col("at")), "").alias("head"),
    )
    joined = larger.select("run", F.col("above").alias("part"), F.array_join("own.text", "").alias("text"))
    earlier = _texts_before(joined, last // RUNNING_FAN).withColumnRenamed("part", "above")
    return inside.join(earlier, ["run", "above"]).select("run", "part", F.concat("before", "head").alias("before"))


def running_text(
    df: DataFrame, idx: str, text: str, out: str, block: int = RUNNING_BLOCK, by: str | None = None
) -> DataFrame:
    """``(idx, out)``: every row's text joined after the texts of all rows before
    (of its run, with ``by``), written out."""
    return expand_running(running_parts(df, idx, text, by, block), idx, out)


def running_chat(
    rows: DataFrame,
    examples: DataFrame,
    idx: str = "idx",
    block: int = RUNNING_BLOCK,
    by: str | None = None,
    **options,
) -> DataFrame:
    """``(idx, messages)``: chat prompts that carry every earlier question too.

    This is what appending to one shared message does. Without examples the
    questions are appended to the system message. ``by`` names the run a row
    belongs to; texts then accumulate inside each run, else over all rows.
    """
    line = F.concat(F.lit("Question: "), text_or_empty(rows, "question"), F.lit("\n"))
    joined = running_text(rows.withColumn("line", line), idx, "line", "tail", block, by)
    return _append_to_last(joined, few_shot_chat(examples, idx=idx, **options), idx)


def chat_prompts(
    rows: DataFrame, examples: DataFrame, idx: str = "idx", accumulate: bool = False, **options
) -> DataFrame:
    """``(idx, messages)``: chat prompts, one question each unless ``accumulate``."""
    if accumulate:
        return running_chat(rows, examples, idx, **options)
    tail = F.concat(F.lit("Question: "), text_or_empty(rows, "question"), F.lit("\n"))
    lines = rows.select(idx, tail.alias("tail"))
    return _append_to_last(lines, few_shot_chat(examples, idx=idx, **options), idx)


def _append_to_last(rows: DataFrame, shared: DataFrame, idx: str) -> DataFrame:
    messages = shared.scalar()
    last = F.element_at(messages, -1)
    longer = F.struct(
        last["role"].alias("role"), F.concat(last["content"], F.col("tail")).alias("content")
    )
    kept = F.slice(messages, F.lit(1), F.size(messages) - 1)
    return rows.select(idx, F.concat(kept, F.array(longer)).alias("messages"))
