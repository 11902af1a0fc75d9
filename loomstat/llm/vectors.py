"""Vectors as Spark arrays: which take part, and numpy views of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null or zero and holds only finite numbers."""
    e = F.col(column)
    fine = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(e.isNotNull() & (F.size(e) > 0)).where(fine & F.exists(e, lambda x: x != 0))


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The most frequent length (ties: the smaller); 0 without rows. One row a length is collected."""
    got = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return got["d"] if got else 0


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.empty((0, dim))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in one fixed order: equal rows give equal results."""
    return (a * b).sum(axis=1)
