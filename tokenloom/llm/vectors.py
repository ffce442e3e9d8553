"""Vector columns: which rows take part, and their values as one array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not zero, no null or non-finite component."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    nonzero = F.exists(vector, lambda x: x.cast("double") != 0.0)
    return F.coalesce(finite & nonzero, F.lit(False))


def same_length(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has the most frequent length (the shorter one on a tie): others cannot be
    compared with them."""
    sizes = rows.groupBy(F.size(vector).alias("d")).count()
    top = sizes.orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size(vector) == top[0]["d"]) if top else rows


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(rows).ravel())
    )
