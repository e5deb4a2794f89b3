"""Vectors of an Arrow column as exact integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Components from this size on would take squared distances out of 64 bits.
LIMIT = 1 << 24


def selected(vectors: DataFrame, id_col: str, vector_col: str, **more: Column) -> DataFrame:
    """``vec_id``, ``v`` (doubles) and further columns, whatever other columns there are."""
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), *(c.alias(n) for n, c in more.items()))


def usable(v: str = "v") -> Column:
    """Whether a vector is there, not empty, and all of its components are finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite, F.lit(False))


def floors(x: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``, exact; all floors go down."""
    out = np.floor(x * SCALE)
    if out.size and max(out.max(), -out.min()) >= LIMIT:
        raise ValueError(f"components of {LIMIT // SCALE} or more aren't supported")
    return out.astype(np.int64)


def integer_groups(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the positions of the usable vectors (see ``usable``) of that
    length in the column, and a matrix of their components as ``floors``."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(size) - size
    bad = np.zeros(len(size), bool)
    bad[np.repeat(np.arange(len(size)), size)[~np.isfinite(values)]] = True
    out = {}
    for dims in np.unique(size[(size > 0) & ~bad]).tolist():
        rows = np.flatnonzero((size == dims) & ~bad)
        out[dims] = rows, floors(values[begin[rows][:, None] + np.arange(dims)])
    return out
