"""What the batch functions of this folder share."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle


def ship(module_name: str) -> None:
    """Send a module's functions to the executors by value.

    The executors then need Python and its installed libraries, but no copy of
    this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def slices(
    batches: Iterator[pa.RecordBatch], text: str, rows: int = 512, size: int = 4_000_000
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has at most ``rows`` rows and, unless it is a
    single row, at most about ``size`` bytes in its text column."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64))
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, before + size, side="right"))
            stop = min(max(stop, at + 1), at + rows, n)
            yield batch.slice(at, stop - at)
            at = stop


def ragged(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of pool[start : start + length] over all pairs."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    place = np.repeat(starts - (ends - lengths), lengths)
    place += np.arange(total, dtype=place.dtype)
    return pool[place]


class Pool:
    """A growing array of variable-length entries."""

    def __init__(self, dtype) -> None:
        self.values = np.empty(1 << 16, dtype)
        self.starts = np.empty(1 << 12, np.int64)
        self.lengths = np.empty(1 << 12, np.int64)
        self.used = self.entries = 0

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(values), len(lengths)
        while self.used + n > len(self.values):
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        while self.entries + m > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        self.values[self.used : self.used + n] = values
        self.lengths[self.entries : self.entries + m] = lengths
        self.starts[self.entries : self.entries + m] = self.used + np.cumsum(lengths) - lengths
        self.used += n
        self.entries += m

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries' values one after another, and each entry's length."""
        lengths = self.lengths[entries]
        return ragged(self.values, self.starts[entries], lengths), lengths
