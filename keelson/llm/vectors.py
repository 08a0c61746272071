"""Which rows of an embeddings table take part, and their vectors as Arrow carries them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, with no null or non-finite component, and not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def dimensions(vectors: DataFrame, column: str) -> dict[int, int]:
    """Usable vectors of each length, the most frequent length first; vectors of different lengths have nothing to do with each other."""
    rows = vectors.where(usable(F.col(column))).groupBy(F.size(column).alias("d")).count().collect()  # one row a length
    return {r["d"]: r["count"] for r in sorted(rows, key=lambda r: (-r["count"], r["d"]))}


def by_length(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their float64 rows) for each length of the lists of a column, whose components are all finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, matrix(column if len(at) == len(sizes) else column.take(pa.array(at)), d)


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """float64 rows of a list column whose lists all have d finite values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled before squaring, so that neither huge nor tiny components are lost."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
