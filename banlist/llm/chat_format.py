"""Conversations as one training text each, assembled column by column.

The template writes a turn as ``<s>[INST] role [/INST]``, a line feed, the text,
``</s>`` and a line feed. Where a text or role holds one of the control strings
``<s> </s> [INST] [/INST]``, also with backslashes behind its first character,
one more backslash is put there; reading takes one away. An escaped text
therefore holds no control string, and escaping can be undone exactly.

A batch is assembled in numpy: the lengths of all segments give their offsets,
every content byte gets its place in one preallocated buffer, and all bytes are
written there at once. The buffer becomes an Arrow string column as it is.

A conversation may be of any length: its turns come in sorted and leave in parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.llm.registry import query, table
from banlist.llm.workers import ship

ship(__name__)

HEAD, MIDDLE, TAIL = b"<s>[INST] ", b" [/INST]\n", b"</s>\n"
_CONTROL = re.compile(rb"<\\*/?s>|\[\\*/?INST\]")
_ESCAPED = re.compile(rb"(?<=<)\\(?=\\*/?s>)|(?<=\[)\\(?=\\*/?INST\])")
_TURN = re.compile(rb"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.DOTALL)
BATCH_BYTES = 8_000_000


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and its n + 1 offsets into them."""
    column = strings.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _escapes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a backslash goes: before these bytes."""
    found = [(m.start(), m.end()) for m in _CONTROL.finditer(raw.tobytes())]
    if not found:
        return np.empty(0, np.int64)
    starts, ends = np.array(found, np.int64).T
    # A match across the border of two contents is none.
    same = np.searchsorted(offsets, starts, "right") == np.searchsorted(offsets, ends - 1, "right")
    return starts[same] + 1


def assemble(
    turns: np.ndarray, roles: pa.Array, texts: pa.Array, assistant: np.ndarray
) -> tuple[pa.Array, pa.Array]:
    """Format many conversations: their numbers of turns, and all turns' roles,
    texts and loss marks. Returns the texts and their loss spans in bytes."""
    contents = [(*_bytes_of(roles),), (*_bytes_of(texts),)]
    n = len(roles)
    lengths = np.zeros((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(HEAD), len(MIDDLE), len(TAIL)
    inserted = []
    for column, (raw, offsets) in zip((1, 3), contents):
        places = _escapes(raw, offsets)
        more = np.zeros(len(raw) + 1, np.int64)
        more[places] = 1
        before = np.cumsum(more)  # backslashes up to and before each byte
        own = before[offsets[1:]] - before[offsets[:-1]]
        # The first byte of a content never has one, so the difference counts its own.
        lengths[:, column] = np.diff(offsets) + own
        inserted.append((places, before))
    ends = np.cumsum(lengths.ravel()).reshape(n, 5) if n else lengths
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for column, mark in ((0, HEAD), (2, MIDDLE), (4, TAIL)):
        out[starts[:, column, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for column, (raw, offsets), (places, before) in zip((1, 3), contents, inserted):
        shift = starts[:, column] - offsets[:-1] - before[offsets[:-1]]
        target = np.arange(len(raw)) + before[: len(raw)] + np.repeat(shift, np.diff(offsets))
        out[target] = raw
        out[target[places] - 1] = ord("\\")
    last = np.cumsum(turns)
    borders = np.append(0, ends[:, -1])[np.append(0, last)]
    formatted = pa.LargeStringArray.from_buffers(len(turns), pa.py_buffer(borders), pa.py_buffer(out)).cast(pa.string())
    owner = np.repeat(np.arange(len(turns)), turns)
    spans = pa.StructArray.from_arrays(
        [
            pa.array((starts[:, 3] - borders[owner])[assistant].astype(np.int32)),
            pa.array(lengths[assistant, 3].astype(np.int32)),
        ],
        ["start", "length"],
    )
    counts = np.bincount(owner[assistant], minlength=len(turns))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), spans)
    return formatted, lists


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES of roles and texts, or of one turn."""
    ends = np.cumsum(sum(pc.binary_length(batch.column(i)).to_numpy().astype(np.int64) for i in (1, 2)))
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right"))
        stop = max(stop, at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def _same(a, b) -> bool:
    return a is b or a == b or (a != a and b != b)


def _lists(spans: pa.Array, rows: np.ndarray, more: int, kind: pa.DataType) -> pa.Array:
    """Span lists that begin at these list rows, with starts as ``kind``; those of
    the first row are moved by ``more``."""
    values = spans.flatten()
    offsets = spans.offsets.to_numpy() - spans.offsets[0].as_py()
    start = values.field(0).to_numpy().astype(np.int64)
    start[: offsets[1] if len(offsets) > 1 else 0] += more
    both = pa.StructArray.from_arrays([pa.array(start, kind), values.field(1).cast(pa.int32())], ["start", "length"])
    return pa.ListArray.from_arrays(pa.array(offsets[rows], pa.int32()), both)


def format_parts(
    turns: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn_from: str = "assistant",
) -> DataFrame:
    """``(key, part, formatted, loss_spans)``: every conversation in consecutive
    rows of one partition, which together are its text.

    Turns are dealt out by key and sorted, on disk if need be, and are assembled
    as they come in, so a task never holds more of a conversation than
    BATCH_BYTES or one turn, however long it is. ``part`` counts from 0;
    ``loss_spans`` start from the conversation's first byte. Rows are treated as
    in `format_conversations`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, offset = None, -1, 0  # of the conversation that may go on
        for whole in batches:
            for batch in _parts(whole):
                keys, roles, texts = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
                fresh = [part < 0 or not _same(last, keys[0])]
                fresh += [not _same(a, b) for a, b in zip(keys, keys[1:])]
                if fresh[0]:
                    part, offset = -1, 0
                starts = np.flatnonzero([True, *fresh[1:]])
                counts = np.diff(np.append(starts, len(keys)))
                learn = np.array([r == learn_from for r in roles.to_pylist()], bool)
                formatted, spans = assemble(counts, roles, texts, learn)
                numbers = np.zeros(len(starts), np.int64)
                numbers[0] = part + 1
                size = pc.binary_length(formatted)[-1].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(starts)),
                        pa.array(numbers),
                        formatted,
                        _lists(spans, np.arange(len(starts) + 1), offset, pa.int64()),
                    ],
                    ["k", "part", "formatted", "loss_spans"],
                )
                offset = offset + size if len(starts) == 1 else size
                last, part = keys[-1], int(numbers[-1])

    kind = turns.schema[key].dataType.simpleString()
    clean = turns.select(
        F.col(key).alias("k"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.col(turn).alias("turn"),
    )
    # The order within a conversation is that of its turns; nulls come first.
    rows = clean.repartition("k").sortWithinPartitions("k", "turn", "role", "text").select("k", "role", "text")
    schema = f"k {kind}, part long, formatted string, loss_spans array<struct<start:long,length:int>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Whole conversations from consecutive parts; the first row begins one."""
    if sum(b.column(2).nbytes for b in batches) >= 1 << 31:
        raise ValueError("a conversation of 2 GB or more is no single value: use format_parts")
    table = pa.Table.from_batches(batches).combine_chunks()
    key, part, text, spans = (c.chunk(0) for c in table.columns)
    rows = np.flatnonzero(part.to_numpy() == 0)
    ends = np.append(rows, len(part))
    raw, offsets = _bytes_of(text)
    formatted = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(offsets[ends]), pa.py_buffer(raw))
    return pa.RecordBatch.from_arrays(
        [key.take(pa.array(rows)), formatted.cast(pa.string()), _lists(spans, ends, 0, pa.int32())],
        ["k", "formatted", "loss_spans"],
    )


def format_conversations(
    turns: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn_from: str = "assistant",
) -> DataFrame:
    """``(key, formatted, loss_spans)`` of every conversation.

    ``loss_spans`` are the byte ranges of the escaped texts of role
    ``learn_from``. Turns are in order of ``turn`` (null first), then role, then
    text; repeated rows are turns of their own. Null roles and texts are empty
    ones; rows with a null key form one conversation. Only conversations that
    have rows are returned. Other columns are ignored. One shuffle by key.

    A conversation is one value here, so it must be held, and one of 2 GB or
    more is refused; `format_parts` has no such limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the parts of one conversation that may go on
        for batch in batches:
            fresh = np.flatnonzero(batch.column(1).to_numpy() == 0)
            if not len(fresh):
                held.append(batch)
                continue
            if fresh[0]:
                held.append(batch.slice(0, fresh[0]))
            if held:
                yield _joined(held)
            if fresh[-1] > fresh[0]:
                yield _joined([batch.slice(fresh[0], fresh[-1] - fresh[0])])
            held = [batch.slice(fresh[-1])]
        if held:
            yield _joined(held)

    kind = turns.schema[key].dataType.simpleString()
    schema = f"k {kind}, formatted string, loss_spans array<struct<start:int,length:int>>"
    parts = format_parts(turns, key, turn, role, text, learn_from)
    return parts.withColumnRenamed(key, "k").mapInArrow(run, schema).withColumnRenamed("k", key)


def unescape(raw: bytes) -> bytes:
    return _ESCAPED.sub(b"", raw)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


class _Digest:
    """What a conversation's parts hold, read in order."""

    def __init__(self, key) -> None:
        self.key = key
        self.turns = self.size = self.learnt = self.chars = 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, text: str, spans: list[dict]) -> None:
        raw = text.encode("utf-8", "surrogatepass")
        for role, own in parse(raw):
            self.turns += 1
            self.whole.update(role + b"\n" + own + b"\n")
        for s in spans:
            start = s["start"] - self.size
            own = unescape(raw[start : start + s["length"]])
            self.loss.update(own)
            self.learnt += len(own.decode("utf-8", "surrogatepass"))
        self.size += len(raw)
        self.chars += len(text)

    def values(self) -> tuple:
        return self.key, self.turns, self.whole.hexdigest(), self.learnt, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of what formatted conversations hold, from their texts and spans
    alone. With a column ``part`` rows are those of `format_parts`, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def done(digests: list[_Digest], kind: pa.DataType) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = zip(*(d.values() for d in digests))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["k", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            ended = []
            for k, part, text, spans in zip(*(batch.column(i) for i in range(4))):
                if not part.as_py():
                    if now:
                        ended.append(now)
                    now = _Digest(k.as_py())
                now.read(text.as_py(), spans.as_py())
            if ended:
                yield done(ended, batch.column(0).type)
        if now:
            yield done([now], batch.column(0).type)

    kind = formatted.schema[key].dataType.simpleString()
    schema = (
        f"k {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    part = F.col("part") if "part" in formatted.columns else F.lit(0)
    rows = formatted.select(F.col(key).alias("k"), part.cast("long").alias("part"), "formatted", "loss_spans")
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


@query("op7_chat_format")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(words).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return read_back(format_parts(turns))
