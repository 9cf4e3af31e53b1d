"""Usable vectors and exact cosine blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _usable(dim: int):
    schema = pa.schema([("id", pa.int64()), ("grp", pa.int64()), ("vec", pa.binary())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            column = batch.column(2)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            right = np.flatnonzero(size == dim)
            start = (np.cumsum(size) - size)[right]
            x = flat[start[:, None] + np.arange(dim)] if len(right) else np.empty((0, dim), np.float32)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            x, right = np.ascontiguousarray(x[good]), right[good]
            data = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right)), batch.column(1).take(pa.array(right)), data], schema=schema)

    return run


def usable_vectors(records: DataFrame, id_col: str, vec_col: str, group_col: str | None = None, dim: int = 64) -> DataFrame:
    """(id, grp, vec) with one row per id whose vector has ``dim`` finite numbers, not all zero.

    ``vec`` holds the numbers as written, as 32-bit floats. Null ids are left out, a null
    group is group -1 - 2**62, ids that occur again count once (any of their equal
    records); other columns are ignored.
    """
    group = F.lit(0).cast("long") if group_col is None else F.coalesce(F.col(group_col).cast("long"), F.lit(-1 - 2**62))
    rows = records.select(F.col(id_col).cast("long").alias("id"), group.alias("grp"), F.col(vec_col).cast("array<float>").alias("vec"))
    usable = rows.filter(F.col("id").isNotNull() & (F.size("vec") == dim)).mapInArrow(_usable(dim), "id long, grp long, vec binary")
    return usable.dropDuplicates(["id"])


def matrix(column, dim: int) -> np.ndarray:
    """The vectors of a binary column scaled to unit length, in double precision."""
    parts = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    x = np.frombuffer(b"".join(parts), np.float32).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def top_k(queries: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, neighbour id and cosine of the k highest cosines, itself left out; ties: smaller id."""
    out_q, out_n, out_c = [], [], []
    order = np.argsort(ids, kind="stable")
    ids, base = ids[order], base[order]
    low = base.astype(np.float32)
    step = max(1, min(2048, 8_000_000 // max(1, len(ids))))
    for lo in range(0, len(queries), step):
        q = queries[lo : lo + step]
        close = q.astype(np.float32) @ low.T
        at = np.searchsorted(ids, query_ids[lo : lo + step])
        own = np.flatnonzero((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == query_ids[lo : lo + step]))
        close[own, at[own]] = -4
        if close.shape[1] > k:
            bar = np.partition(close, close.shape[1] - k, axis=1)[:, close.shape[1] - k] - 1e-5
        else:
            bar = np.full(len(q), -3.0)
        row, col = np.nonzero(close >= np.maximum(bar, -3)[:, None])
        exact = np.einsum("ij,ij->i", q[row], base[col])
        best = np.lexsort((col, -exact, row))
        row, col, exact = row[best], col[best], exact[best]
        first = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - first[row] < k
        out_q.append(row[keep] + lo)
        out_n.append(ids[col[keep]])
        out_c.append(exact[keep])
    return np.concatenate(out_q), np.concatenate(out_n), np.concatenate(out_c)
