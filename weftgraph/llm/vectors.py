"""Checks and arrays shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Neither null nor zero, and no null, NaN or infinite component."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def common_length(df: DataFrame, vector: str) -> int:
    """The most frequent number of components, ties to the smaller; vectors of other lengths take no part. 0 for no rows."""
    row = df.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row["n"] if row else 0


def matrix(a: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as doubles."""
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    n = len(a)
    return np.asarray(a.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in doubles; the same for equal rows wherever they stand."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
