"""Vectors as integer rows: which rows count, their longest length, and their matrix in a task."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components whose scaled value needs more bits have no 64-bit integer with room to subtract: they count as non-finite.
LARGEST = 2.0 ** 61


def sound(vec: Column, scale: float) -> Column:
    """True if the vector is there and all its components are, finite and within ``LARGEST`` when scaled."""
    return F.coalesce(vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) > LARGEST)),
                      F.lit(False))


def sound_rows(rows: DataFrame, scale: float, id_col: str, vec_col: str, *others: Column) -> DataFrame:
    """id, vec and the other columns of the rows that count."""
    return rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), *others
                       ).where(sound(F.col("vec"), scale))


def padded(vectors: Iterable[np.ndarray], width: int) -> np.ndarray:
    """The vectors as rows of doubles, shorter ones filled up with zeros."""
    vectors = list(vectors)
    if all(len(v) == width for v in vectors):
        return np.array(vectors, dtype=np.float64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def floors(vectors: Iterable[np.ndarray], width: int, scale: float) -> np.ndarray:
    """floor(scale * component) of every vector, as 64-bit integers."""
    return np.floor(scale * padded(vectors, width)).astype(np.int64)
