"""What the vector operators share: valid vectors as numpy matrices, random rotations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def keyed_vectors(vectors: DataFrame, id_col: str, vec_col: str, *others: str) -> DataFrame:
    """_key (long; the id, or a number in order of (id, vector) if ids repeat or are null), id, vector
    as array<double>, others."""
    rows = vectors.select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col), *others)
    odd = rows.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count()
    if not odd:
        return rows.select(F.col(id_col).cast("bigint").alias("_key"), "*")
    ordered = rows.orderBy(F.col(id_col).asc_nulls_first(), F.col(vec_col).asc_nulls_first(), *others)
    return stored(ordered.select(F.monotonically_increasing_id().alias("_key"), "*"))


def valid(vec_col: str):
    """Not null, no null or non-finite component, not zero."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def by_dimension(column: pa.ListArray) -> list[np.ndarray]:
    """Row numbers grouped by the lists' length."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    return [np.flatnonzero(size == d) for d in np.unique(size)]


def rotation(dimension: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.RandomState(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))
