"""Shared helpers of the operators: session set-up, size-checked joins, text as byte arrays, hashes.

Operators take and return DataFrames. Python tasks see Arrow batches, cut to a byte size here, so a
batch of very long texts never has to fit in memory at once; a single text is the smallest unit.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import materialize, ship_package

__all__ = ["materialize", "ready", "documents", "join_checked", "table_bytes"]

CHUNK_BYTES = 1 << 18  # text worked on at once inside a task
BROADCAST_BYTES = 16 << 20  # largest table, in stored bytes, that is sent to every executor
WORD = r"[^ \x09-\x0D]+"  # the words of the contracts


def ready(spark: SparkSession) -> SparkSession:
    """Make this package importable in tasks and keep Arrow batches small in bytes, not only in rows."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > 512:
        spark.conf.set(key, "512")
    return spark


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def table_bytes(df: DataFrame) -> int:
    """Size of a written table as Spark's optimizer sees it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join that sends ``small`` (a written table) to the executors only if it is at most
    ``BROADCAST_BYTES``; a larger one is joined by a shuffle, with the same rows."""
    if table_bytes(small) <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


# --- text as bytes ------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the offsets of its rows (null: empty)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_libc = ctypes.CDLL(None)


def release() -> None:
    """Give freed memory back to the system: workers live on, and others need it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def chunks(batch: pa.RecordBatch, field: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes of ``field``, or one row."""
    _, offsets = flat(batch.column(field))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
    release()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the space-separated words, and per row the index of its first word
    (one more entry closes the last row)."""
    ink = ~SPACE[data]
    starts, ends = ink.copy(), ink.copy()
    starts[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[filled] = ink[filled]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = ink[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def join_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, per_row: np.ndarray) -> pa.Array:
    """Strings of the words at these places, ``per_row`` of them each, joined by one space."""
    size = ends - starts + 1
    upto = np.cumsum(size)
    total = int(upto[-1]) if len(upto) else 0
    take = np.arange(total) + np.repeat(starts - (upto - size), size)
    last = upto - 1
    take[last] = 0
    out = data[take] if total else np.zeros(0, np.uint8)
    out[last] = 0x20
    bounds = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(per_row)])]
    keep = np.ones(total, bool)
    keep[bounds[1:][per_row > 0] - 1] = False
    bounds = bounds - np.concatenate([[0], np.cumsum(per_row > 0)])
    made = pa.LargeStringArray.from_buffers(
        len(per_row), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out[keep]))
    )
    return made.cast(pa.string())


# --- hashes -------------------------------------------------------------------------------------

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (the public SplitMix64 finalizer, fixed values)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUE = mix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64


_powers: list[np.ndarray] = []  # of the base and of its inverse, as many as were needed so far


def powers(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:

        def table(base):
            out = np.ones(1 << max(16, n.bit_length()), U)
            out[1:] = U(base)
            return np.multiply.accumulate(out)

        _powers[:] = [table(_BASE), table(pow(_BASE, -1, 1 << 64))]
    return _powers


class SpanHash:
    """Hashes of spans of one array, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.total = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(U) * U(0x9E3779B97F4A7C15)
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + length)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span."""
    return SpanHash(values)(starts, ends)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
