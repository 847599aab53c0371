"""Texts as word numbers, in cells that ask about their words.

A cell is some megabytes of texts of one task: its distinct words, and each token as
a place in them. What is known about a word all over the corpus comes to a cell by
an exchange: it sends each distinct word once, with its count, to the part that owns
the word's hash, and gets one value back. A word that makes up a third of the
corpus so reaches its part as one entry a cell. Words and numbers travel packed,
many to a row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banlist.llm.workers import ship

ship(__name__)

CELL_BYTES = 12_000_000
# Entries that one part of an exchange takes, about.
PART_ENTRIES = 400_000
# The token that ends a text or piece. Words hold no line feeds.
STOP = b"\n"


def pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True) + values.nbytes.to_bytes(8, "little")


def unpack(blob: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(blob[-8:], "little")
    return np.frombuffer(pa.decompress(blob[:-8], size, codec="zstd", asbytes=True), dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=keys[:1] * 0))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def pack_words(words: pa.Array) -> bytes:
    return b" ".join(words.to_pylist())


def unpack_words(blob: bytes) -> pa.Array:
    """The words of a blob of at least one word."""
    return pa.array(blob.split(b" "), pa.binary())


def tokens(joined: bytes) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and the tokens as places in them, of words apart by blanks."""
    parts = pc.split_pattern(pa.array([joined], pa.large_binary()), pattern=" ").flatten()
    encoded = parts.filter(pc.greater(pc.binary_length(parts), 0)).dictionary_encode()
    return encoded.dictionary.cast(pa.binary()), encoded.indices.to_numpy().astype(np.int32)


class Numbers:
    """Numbers for the cells of a task: no two tasks give the same one."""

    def __init__(self) -> None:
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 32

    def take(self) -> int:
        self.next += 1
        return self.next - 1


def by_part(owners: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each owner and the places of its entries, in order."""
    order = np.argsort(owners, kind="stable")
    ranked = owners[order]
    cuts = np.flatnonzero(np.diff(ranked)) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(owners[at[0]]), at


def word_owners(words: pa.Array, parts: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words.to_pylist()), np.uint32, len(words)).astype(np.int64) % parts


def mixed(keys: np.ndarray) -> np.ndarray:
    """64-bit numbers with every bit spread."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_count(rows: DataFrame, entries: str) -> int:
    """How many parts an exchange of so many entries needs; only the sum is collected."""
    total = rows.agg(F.sum(entries)).first()[0] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(total / PART_ENTRIES))


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(","))])
