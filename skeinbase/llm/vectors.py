"""Vectors as whole numbers: what whitening and compression share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted


def finite(col: Column) -> Column:
    """Whether a vector is there and all its entries are numbers."""
    number = col.isNotNull() & F.forall(col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(number, F.lit(False))


def whole_numbers(col: Column, scale: int, limit: int) -> Column:
    """floor(scale * entry) of each entry, as int; beyond ``limit`` either way it is that limit."""
    return F.transform(col, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(limit))), F.lit(-float(limit)))).cast("int"))


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int, limit: int, width: int, *more: Column) -> DataFrame:
    """(id, x, more...) of the rows whose vector is there and finite; shorter ones end in zeros, up to ``width``."""
    vector = F.col(quoted(vector_col))
    x = F.concat(whole_numbers(vector, scale, limit), F.array_repeat(F.lit(0), F.lit(width) - F.size(vector)))
    return df.where(finite(vector)).select(F.col(quoted(id_col)).alias("id"), x.alias("x"), *more)


def longest(df: DataFrame, vector_col: str) -> int:
    """Entries of the longest vector that is there and finite; 0 if there is none."""
    vector = F.col(quoted(vector_col))
    return df.where(finite(vector)).agg(F.max(F.size(vector))).first()[0] or 0


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of ``width`` numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
