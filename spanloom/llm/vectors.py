"""Shared handling of vector columns in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable_vectors(df: DataFrame, id_: str, kind: str, vector: str, version: str | None = None) -> DataFrame:
    """``id, kind, vec`` with one row per id: the latest version that has a vector.

    Rows with a null id, and vectors that are null, empty, all zero or hold a null, NaN or infinity,
    take no part.  A null kind is a kind of its own, and so is every width of vectors within a kind.
    Other columns are ignored.
    """
    v = F.col(vector)
    good = v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    name = F.concat_ws("#", F.coalesce(F.col(kind), F.lit("")), F.size(v).cast("string"))
    order: Column = F.struct(F.col(version) if version else F.lit(0), name.alias("kind"))
    rows = df.filter(F.col(id_).isNotNull() & good).select(F.col(id_).alias("id"), name.alias("kind"), v.cast("array<float>").alias("vec"), order.alias("o"))
    return rows.groupBy("id").agg(F.max_by(F.struct("kind", "vec"), "o").alias("b")).select("id", "b.kind", "b.vec")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal widths as a float32 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float32).reshape(n, -1) if n else np.zeros((0, 0), np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_kind(batch: pa.RecordBatch) -> list[tuple[str, np.ndarray]]:
    """Kinds in a batch with the positions of their rows."""
    kinds = batch.column("kind").to_numpy(zero_copy_only=False)
    return [(k, np.flatnonzero(kinds == k)) for k in dict.fromkeys(kinds)]
