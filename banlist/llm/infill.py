"""Fill-in-middle: cut texts into prefix, middle and suffix and put the middle last.

A text's bytes lie in blocks of fixed size. A Fenwick tree over the blocks holds
how many units (code points, words or lines) and how many code points start in
each. Binary lifting walks down the tree to the block in which a cut falls, and
only that block is searched for the byte of the boundary; the same walk gives the
number of code points before it. Texts stay byte buffers throughout.

What is drawn for a text depends on the seed and its key alone, so it is the same
on every run and cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.llm.registry import query, table
from banlist.llm.workers import ship, slices

ship(__name__)

BLOCK = 1024
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


class Settings(NamedTuple):
    """Markers before prefix, suffix and middle; what is cut between; shares in percent."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "chars"
    fim_percent: int = 90
    spm_percent: int = 20
    seed: str = "1"


def checked(settings: Settings) -> Settings:
    """Markers must be told apart where they meet text: each one starts with a
    letter that occurs nowhere else in the three."""
    marks = settings[:3]
    heads = {m[:1] for m in marks}
    inner = "".join(m[1:] for m in marks)
    if len(set(marks)) < 3 or "" in heads or any(h in inner for h in heads):
        raise ValueError(f"markers {marks} cannot be told apart from text around them")
    if settings.unit not in ("chars", "words", "lines"):
        raise ValueError(f"unknown unit {settings.unit!r}")
    return settings


def char_starts(raw: np.ndarray) -> np.ndarray:
    return (raw & 0xC0) != 0x80


def unit_starts(raw: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes start a unit. A word takes the white space before it with it, and
    the last one what follows; a line ends with its line feed."""
    if unit == "chars":
        return char_starts(raw)
    starts = np.zeros(len(raw), bool)
    if unit == "lines":
        starts[1:] = raw[:-1] == 10
    else:
        space = _SPACES[raw]
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        words = np.flatnonzero(~space)
        starts[ends[ends < words[-1]] if len(words) else ends[:0]] = True
    starts[:1] = True
    return starts


class BlockTree:
    """Fenwick tree of the units and code points that start in blocks of a text."""

    def __init__(self, raw: np.ndarray, unit: str) -> None:
        self.starts = unit_starts(raw, unit)
        self.chars = char_starts(raw)
        self.size = len(raw)
        edges = np.arange(0, len(raw), BLOCK)
        self.blocks = len(edges)
        self.tree = np.zeros((self.blocks + 1, 2), np.int64)
        if self.blocks:
            self.tree[1:, 0] = np.add.reduceat(self.starts, edges, dtype=np.int64)
            self.tree[1:, 1] = np.add.reduceat(self.chars, edges, dtype=np.int64)
        self.units, self.n_chars = self.tree.sum(axis=0).tolist()
        step = 1
        while 2 * step <= self.blocks:
            at = np.arange(2 * step, self.blocks + 1, 2 * step)
            self.tree[at] += self.tree[at - step]
            step *= 2

    def cut(self, units: int) -> tuple[int, int]:
        """The byte that follows the first ``units`` units, and the code points before it."""
        if units >= self.units:
            return self.size, self.n_chars
        block = before = chars = 0
        step = 1 << max(self.blocks.bit_length() - 1, 0)
        while step:
            if block + step <= self.blocks and before + self.tree[block + step, 0] <= units:
                block += step
                before += int(self.tree[block, 0])
                chars += int(self.tree[block, 1])
            step >>= 1
        low = block * BLOCK
        byte = low + int(np.flatnonzero(self.starts[low : low + BLOCK])[units - before])
        return byte, chars + int(np.count_nonzero(self.chars[low:byte]))


def draws(key: Column, seed: str) -> list[Column]:
    """Four numbers of 32 bits for a key; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """``(key, n_units, form, prefix_chars, middle_chars, output)`` of every row.

    ``form`` is ``psm``, ``spm`` or ``plain``; a plain output is the text, and its
    two lengths are null. Plain are: a null or empty text, one that contains a
    marker, and the share that is not drawn. Rows with equal keys draw the same
    numbers, a null key counts as the empty one. A text of any length is worked on
    in memory of some bytes per byte; other columns of ``docs`` play no role.
    """
    settings = checked(settings)
    kind = docs.schema[key].dataType.simpleString()
    marks = [m.encode() for m in settings[:3]]

    def one(value: bytes, h: list[int]) -> tuple:
        if settings.unit == "chars" and not value:
            return 0, "plain", None, None, value
        tree = BlockTree(np.frombuffer(value, np.uint8), settings.unit)
        n = tree.units
        if not value or h[2] % 100 >= settings.fim_percent or any(m in value for m in marks):
            return n, "plain", None, None, value
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        (a, a_chars), (b, b_chars) = tree.cut(low), tree.cut(high)
        head, middle, tail = value[:a], value[a:b], value[b:]
        p, s, m = marks
        if h[3] % 100 < settings.spm_percent:
            form, parts = "spm", (s, tail, p, head, m, middle)
        else:
            form, parts = "psm", (p, head, s, tail, m, middle)
        return n, form, a_chars, b_chars - a_chars, b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            hashes = zip(*(batch.column(i).to_pylist() for i in range(2, 6)))
            made = list(zip(*(one(t or b"", h) for t, h in zip(texts, hashes))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(v, k) for v, k in zip(made, kinds)]
            columns[-1] = columns[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], ["k", "n_units", "form", "prefix_chars", "middle_chars", "output"]
            )

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *draws(F.col(key), settings.seed))
    made = rows.mapInArrow(
        run, f"k {kind}, n_units long, form string, prefix_chars long, middle_chars long, output string"
    )
    return made.withColumnRenamed("k", key)


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text of an output: its parts are found by their markers and put back."""

    def after(value: Column, mark: str) -> Column:
        head = F.substring_index(value, mark, 1)
        return F.substr(value, F.length(head) + len(mark) + 1)

    p, s, m = checked(settings)[:3]

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        one, rest = F.substring_index(rest, second, 1), after(rest, second)
        return one, F.substring_index(rest, m, 1), after(rest, m)

    head, tail, middle = parts(p, s)
    psm = F.concat(head, middle, tail)
    tail, head, middle = parts(s, p)
    spm = F.concat(head, middle, tail)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


@query(
    "op11_fill_in_middle",
    sql="""
with d as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n,
    sha256('1:' || cast(doc_id as varchar)) as h
  from documents
), h as (
  select doc_id, t, n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
  from d
), f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90
      then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from h
), o as (
  select *, substring(t, 1, a) as p, substring(t, a + 1, b - a) as m, substring(t, b + 1) as s from f
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars,
  case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from o
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
