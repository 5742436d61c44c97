"""Vectors of whole numbers from embeddings, and their blocks in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def complete(vector: str) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    infinite = float("inf")
    return F.col(vector).isNotNull() & F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite),
    )


def whole_numbers(vector: str, scale: int, most: int) -> Column:
    """floor(scale * x) of every component, x as double; an error where that is not within ``most``."""
    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < most, F.floor(scaled)).otherwise(
            F.raise_error(F.lit(f"a vector component times {scale} is not below {most}, so scores would not fit into 64 bits")),
        ).cast("int")

    return F.transform(F.col(vector), whole)


def block(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix of ``dims`` columns; shorter vectors end in zeros."""
    lengths = np.asarray(column.value_lengths())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dims).all():
        return values.reshape(len(column), dims)
    rows = np.zeros((len(column), dims), np.int64)
    rows[np.arange(dims) < lengths[:, None]] = values
    return rows


def root(squares: np.ndarray) -> np.ndarray:
    """Whole part of the square root, exactly."""
    found = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    found -= found * found > squares
    return found + ((found + 1) * (found + 1) <= squares)
