"""Arrow-batch maps with bounded memory: batches are cut into pieces of a few megabytes of text."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from .bytescan import column_bytes

PIECE = 2 << 20


def release() -> None:
    """Give back to the system what this process has freed: a worker is kept for later tasks, its peak should not be."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most about ``limit`` bytes in ``column``, one row at least."""
    if not batch.num_rows:
        return
    _, offsets, _ = column_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def map_text(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """``each`` over the pieces of every Arrow batch of ``df``; None adds no rows."""

    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, column):
                out = each(piece)
                if out is not None and out.num_rows:
                    yield out
        release()

    return df.mapInArrow(run, schema)


def filter_text(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray], column: str = "text") -> DataFrame:
    """The rows of ``df`` for which ``keep`` says so, with all columns as they are; no shuffle."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, column):
                out = piece.filter(pa.array(keep(piece), pa.bool_()))
                if out.num_rows:
                    yield out
        release()

    return df.mapInArrow(run, df.schema)
