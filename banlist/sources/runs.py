"""Saved runs: generated id sequences with their prompts."""

from __future__ import annotations

import gzip
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "idx bigint, normal array<bigint>, taboo array<bigint>, prompt string"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All saved runs below a folder; the folder's partitions become columns."""
    return spark.read.parquet(path)


def read_stored_runs(spark: SparkSession, path: str) -> DataFrame:
    """``(file, idx, normal, taboo, prompt)`` of runs stored as gzip pickles.

    ``path`` is a file, a folder or a pattern of files. A file holds a mapping of
    indices to outputs and is read by one task: piece by piece where ``pack_runs`` made
    it, else whole, as a pickle may refer back to anything before.
    """
    files = spark.read.format("binaryFile").load(path)
    return unpack_runs(files.select(F.col("path").alias("file"), "content"))


def unpack_runs(files: DataFrame) -> DataFrame:
    """The same from ``(file, content)``, or from ``pack_runs`` in parts.

    Only lists, tuples, mappings, whole numbers, texts and nulls are read. A file that
    names any class or function is refused with that name before it is called, and so
    is one of another shape; the error says which file it is.
    """
    in_parts, first, head = "part" in files.columns, _FIRST, _HEAD

    # Nested, so that executors need no copy of this package.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import io
        import itertools
        import pickle
        import zlib

        class Plain(pickle.Unpickler):
            def find_class(self, module: str, name: str):
                raise ValueError(f"it holds a {module}.{name}")

            def persistent_load(self, pid):
                raise ValueError("it refers to an object outside")

        def ids(value, what: str) -> list[int] | None:
            if value is not None and not (isinstance(value, (list, tuple)) and all(type(i) is int for i in value)):
                raise ValueError(f"{what} is not a list of whole numbers")
            return value if value is None else list(value)

        def members(content: bytes) -> Iterator[bytes]:
            left = memoryview(content)
            while left:
                one = zlib.decompressobj(wbits=31)
                yield one.decompress(left) + one.flush()
                if not one.eof:
                    raise ValueError("it ends early")
                left = left[len(left) - len(one.unused_data) :]

        def pickles(content: bytes) -> Iterator[bytes]:
            pieces = in_parts or content.startswith(first)
            for raw in members(content) if pieces else [gzip.decompress(content)]:
                # The entries of a part refer to nothing outside, so they are a mapping of their own.
                yield head + raw.removeprefix(head).removesuffix(pickle.STOP) + pickle.STOP if pieces else raw

        def rows(content: bytes) -> Iterator[tuple]:
            for raw in pickles(content):
                stored = Plain(io.BytesIO(raw)).load()
                if type(stored) is not dict or any(type(k) is not int or type(v) is not dict for k, v in stored.items()):
                    raise ValueError("it is not a mapping of indices to outputs")
                for idx, one in stored.items():
                    if not isinstance(one.get("prompt"), (str, type(None))):
                        raise ValueError("a prompt is not a text")
                    yield idx, ids(one.get("normal"), "normal"), ids(one.get("taboo"), "taboo"), one.get("prompt")

        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = rows(content.as_py())
                while True:
                    try:
                        columns = list(zip(*itertools.islice(found, 1000)))
                    except Exception as error:
                        raise ValueError(f"{name}: not a stored run: {error}") from error
                    if not columns:
                        break
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(columns[0]), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                        ["file", "idx", "normal", "taboo", "prompt"],
                    )

    return files.select("file", "content").mapInArrow(run, f"file string, {RUN_SCHEMA}")


# How a pickle of a mapping begins. Its entries follow and a STOP.
_HEAD = pickle.PROTO + b"\x03" + pickle.EMPTY_DICT
# The gzip member that a run of pack_runs begins with.
_FIRST = gzip.compress(_HEAD, mtime=0)
_LAST = gzip.compress(pickle.STOP, mtime=0)
# Pickled bytes of a part, about, before they are compressed.
PART_BYTES = 4_000_000


def _run_parts(runs: DataFrame, file: str) -> DataFrame:
    """``(file, part, content)``: the runs of each value of ``file`` as one gzip pickle,
    which is the contents of its parts in the order of ``part``, one behind another.

    The rows are dealt out by file and index, so the parts of a long run are made by
    many tasks, and no task holds more than a part of it.
    """
    part_bytes = PART_BYTES

    # Nested, so that executors need no copy of this package.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import io
        import pickle

        names = ["file", "part", "content"]

        def entries(r: dict) -> bytes:
            out = io.BytesIO()
            pickler = pickle.Pickler(out, protocol=3)
            pickler.fast = True  # no references back: entries can be cut anywhere
            pickler.dump({r["idx"]: {"normal": r["normal"], "taboo": r["taboo"], "prompt": r["prompt"]}})
            return out.getvalue()[3:-1]  # without the mapping's beginning and STOP

        def rows() -> Iterator[dict]:
            for batch in batches:
                for at in range(0, batch.num_rows, 100):
                    yield from batch.slice(at, 100).to_pylist()

        def part(held: list[bytes], of: dict) -> pa.RecordBatch:
            content = gzip.compress(b"".join(held), mtime=0)
            columns = [pa.array([of["file"]], pa.string()), pa.array([of["part"]], pa.int64()), pa.array([content], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        held, size, of, last = [], 0, None, None
        for r in rows():
            if last is not None and (r["file"], r["idx"]) != (last["file"], last["idx"]):
                held.append(entries(last))  # of rows of one index the last is kept
                size += len(held[-1])
                if size >= part_bytes or r["file"] != last["file"]:
                    yield part(held, of)
                    held, size, of = [], 0, None
            of, last = of or r, r
        if last is not None:
            yield part([*held, entries(last)], of)

    own = runs.select(F.col(file).cast("string").alias("file"), "idx", "normal", "taboo", "prompt")
    order = [F.asc("file"), F.asc_nulls_last("idx")]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    # A part has the place of its first row; the numbers rise with file and index.
    parts = dealt.withColumn("part", F.monotonically_increasing_id()).mapInArrow(run, "file string, part bigint, content binary")
    ends = F.array(
        F.struct(F.lit(-1).cast("bigint").alias("part"), F.lit(_FIRST).alias("content")),
        F.struct(F.lit((1 << 63) - 1).alias("part"), F.lit(_LAST).alias("content")),
    )
    return parts.unionByName(own.select("file").distinct().select("file", F.inline(ends)))


def pack_runs(runs: DataFrame, file: str, in_parts: bool = False) -> DataFrame:
    """``(file, content)``: the runs of each value of ``file`` as one gzip pickle.

    A stored run is one value here, so its compressed parts meet in one task; it is
    meant for runs of the size that one program made and one program will load. For
    longer ones, ``in_parts`` leaves the parts apart: ``(file, part, content)``.
    """
    if in_parts:
        return _run_parts(runs, file)

    def run(key: tuple, parts: pa.Table) -> pa.Table:
        content = b"".join(parts.sort_by("part").column("content").to_pylist())
        return pa.table({"file": pa.array([key[0].as_py()], pa.string()), "content": pa.array([content], pa.binary())})

    return _run_parts(runs, file).groupBy("file").applyInArrow(run, "file string, content binary")


def pair_runs(normal: DataFrame, taboo: DataFrame, idx: str = "idx") -> DataFrame:
    """Free and constrained outputs of one prompt in one row."""
    return normal.withColumnRenamed("output", "free_output").join(
        taboo.withColumnRenamed("output", "taboo_output"), idx
    )
