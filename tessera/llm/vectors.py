"""Vector columns: which take part, and how they reach numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, not all zero, and without null or non-finite components."""
    def sound(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))

    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, sound) & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_rows(df: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(vec_id long, embedding array<float>, ...) of the rows with an id whose vector is usable."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), *more)
    return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))


def matrix(column) -> np.ndarray:
    """Rows of equal length as doubles."""
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))
