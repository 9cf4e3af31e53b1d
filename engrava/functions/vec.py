"""Column functions over numeric arrays. Distances are squared Euclid, never rooted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def _double(v) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return v.cast("array<double>")


def total(v) -> Column:
    return F.aggregate(_double(v), F.lit(0.0), lambda acc, x: acc + x)


def l2sq(a, b) -> Column:
    return total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def dot(a, b) -> Column:
    return total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(total(F.transform(_double(v), lambda x: x * x)))


def normalize(v) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(v)
    return F.when(n == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / n))


def residual(v, centroid) -> Column:
    return F.zip_with(_double(v), _double(centroid), lambda x, y: x - y)


def hamming(a, b) -> Column:
    """Positions of two codes that differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda acc, x: acc + x)


def margin_features(distances) -> Column:
    """(f0, f1, f2, f3) of centroid distances: nearest, ratio, difference, and mean of the eight nearest over the nearest.

    No distances give zeros; a single one counts as its own second.
    """
    d = F.array_sort(_double(distances))
    n = F.size(d)
    first = F.coalesce(F.get(d, F.lit(0)), F.lit(0.0))
    second = F.coalesce(F.get(d, F.lit(1)), first)
    head = F.slice(d, 1, F.least(n, F.lit(8)))
    mean = F.when(n > 0, total(head) / F.size(head)).otherwise(0.0)
    floor = first + F.lit(1e-9)
    return F.struct(
        first.alias("f0"), (second / floor).alias("f1"), (second - first).alias("f2"), (mean / floor).alias("f3")
    )


#: Offset basis and prime of the 64-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


@F.pandas_udf(LongType())
def _fnv1a(vectors: pd.Series) -> pd.Series:
    out = np.full(len(vectors), FNV_BASIS, np.uint64)
    sizes = np.array([-1 if v is None else len(v) for v in vectors])
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == size)
        data = np.array([np.asarray(vectors.iloc[i], "<f4") for i in rows]).reshape(len(rows), size).view(np.uint8)
        hashed = out[rows]
        for byte in data.T:
            hashed = (hashed ^ byte) * np.uint64(FNV_PRIME)
        out[rows] = hashed
    return pd.Series(out.view(np.int64)).where(sizes >= 0)


def fnv1a(v) -> Column:
    """FNV-1a over the little-endian 32-bit floats of a vector, as a signed long; null for null."""
    return _fnv1a(F.col(v) if isinstance(v, str) else v)
