"""Quantisers: Lloyd's k-means, product quantisation, anisotropic codebooks, rotations.

Model tables (centroids, codebooks) have a fixed size set by their configuration and live
with the driver; data are assigned and encoded in Arrow batches where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrava.operators.knn import squared, vectors_of

#: Rows a model is fitted on at most.
TRAIN_ROWS = 65_536


def sample_matrix(vectors: DataFrame, vec_col: str, dim: int, rows: int = TRAIN_ROWS, id_col: str = "vec_id", seed: int = 0) -> np.ndarray:
    """At most ``rows`` vectors chosen by a hash of their id: the same whatever the partitioning."""
    chosen = vectors.select(id_col, vec_col).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(rows).toArrow()
    _, x = vectors_of(chosen.column(1).combine_chunks() if chosen.num_rows else pa.array([], pa.list_(pa.float32())), dim)
    return x


def nearest_rows(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid (ties: lower index) and the squared distance."""
    at = squared(x, centroids).argmin(1)
    return at, ((x - centroids[at]) ** 2).sum(1)


def kmeans_pp(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k-means++ seeding: each further centre is drawn with probability in proportion to its squared distance."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        weight = d.sum()
        centres.append(x[rng.choice(len(x), p=d / weight) if weight > 0 else rng.integers(len(x))])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    return np.array(centres)


def farthest_points(x: np.ndarray, k: int) -> np.ndarray:
    """Deterministic seeding: the first point, then always the one farthest from all chosen."""
    centres = [x[0]]
    d = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(k, len(x)):
        centres.append(x[int(d.argmax())])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    return np.array(centres)


def lloyd(x: np.ndarray, centroids: np.ndarray, iterations: int, seed: int = 0, reseed: bool = True) -> np.ndarray:
    """Lloyd steps until nothing moves; an empty cluster takes a random point, or keeps its centre."""
    rng, before, c = np.random.default_rng(seed), None, centroids.copy()
    for _ in range(iterations):
        at, _ = nearest_rows(x, c)
        if before is not None and (at == before).all():
            break
        before = at
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if reseed:
            for empty in np.flatnonzero(n == 0):
                c[empty] = x[rng.integers(len(x))]
    return c


def _partial(centroids, dim: int):
    schema = pa.schema([("cell", pa.int32()), ("pos", pa.int32()), ("total", pa.float64()), ("n", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        sums, n = np.zeros_like(c), np.zeros(len(c), np.int64)
        for batch in stream:
            _, x = vectors_of(batch.column(0), dim)
            if len(x):
                at, _ = nearest_rows(x, c)
                np.add.at(sums, at, x)
                n += np.bincount(at, minlength=len(c))
        cell, pos = np.divmod(np.arange(c.size, dtype=np.int32), c.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(sums.ravel()), pa.array(np.repeat(n, c.shape[1]))], schema=schema)

    return run


def lloyd_distributed(vectors: DataFrame, centroids: np.ndarray, iterations: int, vec_col: str = "embedding", digits: int = 9) -> np.ndarray:
    """Lloyd steps over all rows: one sum per task and component is shuffled. Empty cells keep their centroid.

    Centroids are rounded each step, so the order of summation does not show.
    """
    spark, c = vectors.sparkSession, centroids.astype(np.float64)
    for _ in range(iterations):
        sums = vectors.select(vec_col).mapInArrow(_partial(spark.sparkContext.broadcast(c), c.shape[1]), "cell int, pos int, total double, n long")
        rows = sums.groupBy("cell", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        c = c.copy()
        for r in rows:
            if r["n"]:
                c[r["cell"], r["pos"]] = round(r["total"] / r["n"], digits)
    return c


def _partial_parts(books, dim: int):
    schema = pa.schema([("at", pa.int32()), ("total", pa.float64()), ("n", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = books.value
        sums, n = np.zeros_like(c), np.zeros(c.shape[:2], np.int64)
        for batch in stream:
            _, x = vectors_of(batch.column(0), dim)
            parts = x.reshape(len(x), c.shape[0], -1)
            for m in range(c.shape[0] if len(x) else 0):
                at, _ = nearest_rows(parts[:, m], c[m])
                np.add.at(sums[m], at, parts[:, m])
                n[m] += np.bincount(at, minlength=c.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(c.size, dtype=np.int32)), pa.array(sums.ravel()), pa.array(np.repeat(n.ravel(), c.shape[2]))], schema=schema)

    return run


def lloyd_parts(vectors: DataFrame, books: Codebooks, iterations: int, vec_col: str = "residual", digits: int = 9) -> Codebooks:
    """Lloyd steps of all parts' codebooks at once over all rows: one pass a step. Empty entries keep their value."""
    spark, c = vectors.sparkSession, books.values.astype(np.float64)
    for _ in range(iterations):
        sums = vectors.select(vec_col).mapInArrow(_partial_parts(spark.sparkContext.broadcast(c), c.shape[0] * c.shape[2]), "at int, total double, n long")
        flat = c.ravel().copy()
        for r in sums.groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # as many lines as the codebooks have numbers
            if r["n"]:
                flat[r["at"]] = round(r["total"] / r["n"], digits)
        c = flat.reshape(c.shape)
    return Codebooks(c)


def _assign(centroids, dim: int):
    schema = pa.schema([("vec_id", pa.int64()), ("cell", pa.int32()), ("dist", pa.float64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows, x = vectors_of(batch.column(1), dim)
            at, d = nearest_rows(x, centroids.value) if len(x) else (np.empty(0, np.int64), np.empty(0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(at.astype(np.int32)), pa.array(d)], schema=schema)

    return run


def assign(vectors: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cell, dist) of each usable vector."""
    model = vectors.sparkSession.sparkContext.broadcast(centroids)
    return vectors.select(F.col(id_col).cast("long"), vec_col).mapInArrow(_assign(model, centroids.shape[1]), "vec_id long, cell int, dist double")


@dataclass(frozen=True)
class Codebooks:
    """M codebooks of K sub-vectors each: array (M, K, D / M)."""

    values: np.ndarray

    @property
    def m(self) -> int:
        return self.values.shape[0]

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts = x.reshape(len(x), self.m, -1)
        return np.stack([nearest_rows(parts[:, m], self.values[m])[0] for m in range(self.m)], 1).astype(np.int16)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.values[np.arange(self.m)[None], codes].reshape(len(codes), -1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Distances (query, M, K) of each query's parts to all codebook entries."""
        parts = q.reshape(len(q), self.m, 1, -1)
        return ((parts - self.values[None]) ** 2).sum(-1)

    def adc(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (query, code): table look-ups summed over the parts."""
        t = self.tables(q)
        return sum(t[:, m][:, codes[:, m]] for m in range(self.m))


def check_shape(dim: int, m: int, k: int) -> None:
    if dim <= 0 or m <= 0 or dim % m or not 1 <= k <= 256:
        raise ValueError("need dim > 0, m > 0 dividing dim, and 1 <= k <= 256")


def train_codebooks(x: np.ndarray, m: int, k: int, iterations: int = 25, seed: int = 0) -> Codebooks:
    """Independent k-means per part; fewer rows than k are an error."""
    check_shape(x.shape[1], m, k)
    if len(x) < k:
        raise ValueError("fewer training rows than codebook entries")
    parts = x.reshape(len(x), m, -1)
    return Codebooks(np.stack([lloyd(parts[:, i], kmeans_pp(parts[:, i], k, seed + i + 1), iterations, seed + i + 1) for i in range(m)]))


def anisotropic_codebooks(x: np.ndarray, m: int, k: int, h: float = 1.0, iterations: int = 10, seed: int = 0) -> Codebooks:
    """Codebooks under the loss |e|^2 + (h - 1) (e . x/|x|)^2 of each part's error e; h = 1 is plain k-means."""
    check_shape(x.shape[1], m, k)
    if len(x) < k:
        raise ValueError("fewer training rows than codebook entries")
    rng, parts, out = np.random.default_rng(seed), x.reshape(len(x), m, -1), []
    for i in range(m):
        p = parts[:, i]
        size = np.linalg.norm(p, axis=1, keepdims=True)
        u = np.divide(p, size, out=np.zeros_like(p), where=size > 0)
        c = p[rng.choice(len(p), k, replace=False)].copy()
        for _ in range(iterations):
            along = u @ c.T - (u * p).sum(1)[:, None]
            at = (squared(p, c) + (h - 1) * along**2).argmin(1)
            for j in range(k):
                mine = at == j
                if mine.any():
                    system = mine.sum() * np.eye(p.shape[1]) + (h - 1) * u[mine].T @ u[mine]
                    wanted = p[mine].sum(0) + (h - 1) * (u[mine] * (u[mine] * p[mine]).sum(1, keepdims=True)).sum(0)
                    c[j] = np.linalg.solve(system, wanted)
        out.append(c)
    return Codebooks(np.stack(out))


def random_rotation(dim: int, seed: int = 0) -> np.ndarray:
    """A uniformly random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _encode(books: Codebooks, dim: int):
    schema = pa.schema([("vec_id", pa.int64()), ("code", pa.list_(pa.int16()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows, x = vectors_of(batch.column(1), dim)
            codes = books.encode(x) if len(x) else np.empty((0, books.m), np.int16)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), books.m).cast(pa.list_(pa.int16()))], schema=schema)

    return run


def encode(vectors: DataFrame, books: Codebooks, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, code array<short>)."""
    return vectors.select(F.col(id_col).cast("long"), vec_col).mapInArrow(_encode(books, dim), "vec_id long, code array<short>")
