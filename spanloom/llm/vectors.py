"""Reading vector columns: which rows take part, and blocks of rows as matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite components and with a length above zero (in double precision)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    clean = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: F.coalesce(bad(x.cast("double")), F.lit(True)))
    return F.coalesce(clean & F.exists(vector, lambda x: x.cast("double") != 0), F.lit(False))


def usable_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)`` of rows that take part; a null id takes no part."""
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows with very large or small components are scaled first."""
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of every row of ``a`` with the row of ``b`` at its place."""
    return np.einsum("ij,ij->i", unit(a), unit(b))
