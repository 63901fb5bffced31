"""Embedding columns: which rows take part, and unit vectors in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, vec) of the rows whose vector has a direction.

    Null, empty and zero vectors and those with null or non-finite components
    take no part, nor do vectors of another length than the commonest (the
    longest of equally common ones).
    """
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.select(F.col(vec_id).cast("long").alias("id"), v.alias("vec")).filter(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    common = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return own.filter(F.size("vec") == (common[0] if common else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The lists of ``column``, all of one length, as rows of doubles."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(c), -1) for c in chunks if len(c)]
    return np.concatenate(parts) if parts else np.zeros((0, 1))


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very large and very small components."""
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of paired rows; equal rows give equal results."""
    return (a * b).sum(1)
