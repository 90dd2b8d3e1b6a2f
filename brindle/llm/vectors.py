"""What the operators on embeddings share: reading vectors into matrices, which of them take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def modal_width(vectors: DataFrame, column: str = "embedding") -> int:
    """The most frequent length of a vector, the smaller of two; vectors of other lengths take no part."""
    top = vectors.filter(F.size(column) > 0).groupBy(F.size(column).alias("w")).count().orderBy(F.desc("count"), "w").first()
    return top["w"] if top else 0


def usable(width: int, column: str = "embedding") -> Column:
    """True for vectors of that width without null or non-finite components, and not zero."""
    x = F.col(column).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(column) == width) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an array<double> column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def dot_in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up from the first component to the last, in double precision."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total
