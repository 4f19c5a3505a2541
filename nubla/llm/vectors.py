"""What the vector operators share: which vectors count, and their numbers as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor zero and has finite components only."""
    v = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def matrices(vectors: pa.ListArray):
    """For each length among the rows: (row numbers, float64 matrix). Each vector is divided by a power of two, such that its
    largest component lies between 0.5 and 1: that changes no digit of a cosine, and no square passes what doubles hold."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        found = flat[(ends[rows] - n)[:, None] + np.arange(n)]
        largest = np.abs(found).max(1, initial=0.0)
        yield rows, np.ldexp(found, -np.frexp(largest)[1][:, None])
