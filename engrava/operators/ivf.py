"""Inverted-file search over residual codes, addressed by content.

Entries lie in a table (hash, vec_id, cell, code); models (coarse centroids, codebooks) have
the size their configuration names. A query's probed cells and look-up tables are computed
once; entries are scanned where they lie and only the best of each task are shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.operators.knn import query_blocks, squared, vectors_of
from engrava.operators.quant import Codebooks, check_shape, kmeans_pp, lloyd, nearest_rows, sample_matrix, train_codebooks


#: Queries broadcast at once.
QUERY_BLOCK = 4096


@dataclass(frozen=True)
class IvfConfig:
    dim: int
    nlist: int = 64
    m: int = 8
    k: int = 64
    iterations: int = 25
    coarse_iterations: int = 10
    sample: int = 65_536
    seed: int = 1

    def __post_init__(self):
        check_shape(self.dim, self.m, self.k)
        if self.nlist <= 0 or self.iterations <= 0 or self.coarse_iterations <= 0 or self.sample <= 0:
            raise ValueError("nlist, iterations and sample must be positive")


def recommended(dim: int) -> tuple[IvfConfig, int, int]:
    """Configuration, probed cells and re-ranked hits found best for embeddings whose size 96 divides."""
    if dim % 96:
        raise ValueError("the preset needs a dimension divisible by 96")
    return IvfConfig(dim, 64, 96, 64, 25, 10, 65_536, 1), 32, 200


def probe(q: np.ndarray, coarse: np.ndarray, nprobe: int) -> np.ndarray:
    """The nprobe nearest cells of each query, by (distance, cell)."""
    return np.argsort(squared(q, coarse), axis=1, kind="stable")[:, : min(nprobe, len(coarse))]


def _entries(coarse: np.ndarray, books: Codebooks, dim: int):
    schema = pa.schema([("hash", pa.int64()), ("vec_id", pa.int64()), ("cell", pa.int32()), ("code", pa.list_(pa.int16()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows, x = vectors_of(batch.column(2), dim)
            at = nearest_rows(x, coarse)[0] if len(x) else np.empty(0, np.int64)
            codes = books.encode(x - coarse[at]) if len(x) else np.empty((0, books.m), np.int16)
            take = pa.array(rows)
            code = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), books.m).cast(pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), code], schema=schema)

    return run


def _scan(asked, coarse: np.ndarray, books: Codebooks, k: int, tolerance: int | None = None):
    """Best k entries per query among those in its probed cells (and whose code is within the tolerance of the query's own)."""
    schema = pa.schema([("qid", pa.int64()), ("hash", pa.int64()), ("vec_id", pa.int64()), ("dist", pa.float64()), ("hamming", pa.int32())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, depth = asked.value
        order = np.argsort(squared(q, coarse), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(coarse)), order.shape), 1)
        for batch in stream:
            if not batch.num_rows:
                continue
            cells = batch.column(2).to_numpy()
            codes = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, books.m)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for cell in np.unique(cells):
                here, who = np.flatnonzero(cells == cell), np.flatnonzero(rank[:, cell] < depth)
                if not len(who):
                    continue
                apart = q[who] - coarse[cell]
                d, far = books.adc(apart, codes[here]), None
                if tolerance is not None:
                    far = (books.encode(apart)[:, None] != codes[here][None]).sum(2)
                    d = np.where(far <= tolerance, d, np.inf)
                keep = min(k, d.shape[1])
                limit = np.partition(d, keep - 1, axis=1)[:, keep - 1]
                i, j = np.nonzero(d <= limit[:, None])
                fine = np.isfinite(d[i, j])
                i, j = i[fine], j[fine]
                out.append((who[i], here[j], d[i, j], far[i, j] if far is not None else np.zeros(len(i), np.int64)))
            if not out:
                continue
            i, j, d, h = (np.concatenate(c) for c in zip(*out, strict=True))
            best = np.lexsort((batch.column(1).to_numpy()[j], d, i))
            i, j, d, h = i[best], j[best], d[best], h[best]
            top = np.arange(len(i)) - np.searchsorted(i, np.arange(len(q)))[i] < k
            yield pa.RecordBatch.from_arrays([pa.array(qids[i[top]]), batch.column(0).take(pa.array(j[top])), batch.column(1).take(pa.array(j[top])), pa.array(d[top]), pa.array(h[top].astype(np.int32))], schema=schema)

    return run


class IvfIndex:
    def __init__(self, config: IvfConfig, coarse: np.ndarray | None = None, books: Codebooks | None = None, entries: DataFrame | None = None):
        self.config, self.coarse, self.books, self.entries = config, coarse, books, entries

    def train(self, learn: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> IvfIndex:
        """Coarse centroids and residual codebooks from a bounded sample."""
        c = self.config
        x = sample_matrix(learn, vec_col, c.dim, c.sample, id_col, c.seed)
        if len(x) < max(c.k, 1):
            raise ValueError("fewer training rows than codebook entries")
        self.coarse = lloyd(x, kmeans_pp(x, c.nlist, c.seed + 1), c.coarse_iterations, c.seed + 1)
        self.books = train_codebooks(x - self.coarse[nearest_rows(x, self.coarse)[0]], c.m, c.k, c.iterations, c.seed + 2)
        return self

    def add(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """Add vectors; returns (vec_id, hash, status, prior): content already known is not stored again.

        The first by id stores a content; status is 'Inserted' or 'ExactDuplicate', and prior
        the id that holds the content.
        """
        if self.coarse is None or self.books is None:
            raise ValueError("train first")
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).withColumn("hash", F.xxhash64("v"))
        first = rows.groupBy("hash").agg(F.min("vec_id").alias("first_id"))
        if self.entries is None:
            known = first.withColumn("prior", F.col("first_id"))
        else:
            known = first.join(self.entries.select("hash", F.col("vec_id").alias("stored")), "hash", "left").withColumn("prior", F.coalesce("stored", "first_id"))
            first = first.join(self.entries.select("hash"), "hash", "left_anti")
        fresh = rows.join(first.select(F.col("first_id").alias("vec_id")), "vec_id", "left_semi").select("hash", "vec_id", "v")
        stored = fresh.mapInArrow(_entries(self.coarse, self.books, self.config.dim), "hash long, vec_id long, cell int, code array<short>")
        self.entries = stored if self.entries is None else self.entries.unionByName(stored)
        status = F.when(F.col("vec_id") == F.col("prior"), "Inserted").otherwise("ExactDuplicate")
        return rows.join(known.select("hash", "prior"), "hash").select("vec_id", "hash", status.alias("status"), "prior")

    def _asked(self, table: pa.Table):
        at, q = vectors_of(table.column("v").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64())), self.config.dim)
        depth = np.minimum(table.column("p").to_numpy()[at], len(self.coarse)) if len(at) else np.empty(0, np.int64)
        return table.column("qid").to_numpy()[at], q, depth

    def _scanned(self, queries: DataFrame, nprobe: int, k: int, id_col: str, vec_col: str, depth_col: str | None, tolerance: int | None = None) -> DataFrame:
        """The best k of each task and query, block by block of queries; cells no query probes are not read."""
        spark = self.entries.sparkSession
        depth = F.lit(nprobe) if depth_col is None else F.col(depth_col).cast("int")
        rows = queries.select(F.col(id_col).cast("long").alias("qid"), F.col(vec_col).cast("array<double>").alias("v"), depth.alias("p"))
        entries, found = self.entries.select("hash", "vec_id", "cell", "code"), None
        for table in query_blocks(rows, "qid", QUERY_BLOCK):
            asked = self._asked(table)
            part = entries
            if len(asked[1]):
                probed = probe(asked[1], self.coarse, int(asked[2].max()))
                cells = np.unique(probed[np.arange(probed.shape[1])[None] < asked[2][:, None]])
                if len(cells) < len(self.coarse):
                    part = entries.filter(F.col("cell").isin(cells.tolist()))  # at most nlist values
            part = part.mapInArrow(_scan(spark.sparkContext.broadcast(asked), self.coarse, self.books, k, tolerance), "qid long, hash long, vec_id long, dist double, hamming int")
            found = part if found is None else found.unionByName(part)
        return found

    def search(self, queries: DataFrame, nprobe: int, k: int, id_col: str = "vec_id", vec_col: str = "embedding", depth_col: str | None = None) -> DataFrame:
        """(qid, rank, hash, vec_id, dist) by (dist, vec_id); ``depth_col`` gives each query its own number of cells.

        Queries go in blocks of ``QUERY_BLOCK``, so any number of them may be asked.
        """
        if k <= 0 or nprobe <= 0:
            return self.entries.sparkSession.createDataFrame([], "qid long, rank int, hash long, vec_id long, dist double")
        found = self._scanned(queries, nprobe, k, id_col, vec_col, depth_col)
        order = Window.partitionBy("qid").orderBy("dist", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "hash", "vec_id", "dist")

    def rerank(self, hits: DataFrame, queries: DataFrame, originals: DataFrame, k: int, rerank_k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """Exact distances for the first ``rerank_k`` hits, which are ordered anew by (dist, hash); the tail stays.

        Hits whose original is missing keep their estimate. Without a positive rerank_k the hits stay as they are.
        """
        from engrava.functions.vec import l2sq

        if rerank_k <= 0:
            return hits.filter(F.col("rank") <= k)
        head = hits.filter(F.col("rank") <= rerank_k)
        exact = (
            head.join(originals.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("_v")), "vec_id", "left")
            .join(queries.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("_q")), "qid")
            .select("qid", "hash", "vec_id", F.coalesce(l2sq("_q", "_v"), "dist").alias("dist"), F.lit(0).alias("tail"), F.lit(0).alias("_at"))
        )
        tail = hits.filter(F.col("rank") > rerank_k).select("qid", "hash", "vec_id", "dist", F.lit(1).alias("tail"), F.col("rank").alias("_at"))
        order = Window.partitionBy("qid").orderBy("tail", "_at", "dist", "hash", "vec_id")
        return exact.unionByName(tail).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "hash", "vec_id", "dist")

    def tiered(self, queries: DataFrame, tier: DataFrame, nprobe: int, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """Search in which the vectors of ``tier`` (resident originals) always compete with exact distances."""
        from engrava.operators.knn import nearest

        resident = tier.join(self.entries.select(F.col("vec_id").alias(id_col)), id_col, "left_semi")
        size = resident.count()
        if not size:
            return self.search(queries, nprobe, k, id_col, vec_col)
        # Residents never come from codes, so k of the others are enough.
        outside = IvfIndex(self.config, self.coarse, self.books, self.entries.join(resident.select(F.col(id_col).alias("vec_id")), "vec_id", "left_anti"))
        coded = outside.search(queries, nprobe, k, id_col, vec_col)
        asked = queries.withColumn(id_col, -1 - F.col(id_col))  # a query may find itself here
        exact = nearest(resident, asked, k, id_col, vec_col, dim=self.config.dim)
        exact = exact.select((-1 - F.col("qid")).alias("qid"), F.col("id").alias("vec_id"), "dist")
        exact = exact.join(self.entries.select("vec_id", "hash"), "vec_id")
        both = coded.select("qid", "hash", "vec_id", "dist").unionByName(exact.select("qid", "hash", "vec_id", "dist"))
        order = Window.partitionBy("qid").orderBy("dist", "hash", "vec_id")
        return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "hash", "vec_id", "dist")

    def recall(self, queries: DataFrame, tolerance: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(qid, vec_id, hamming, dist): nearest entry of the query's own cell whose code differs in at most ``tolerance`` parts."""
        found = self._scanned(queries, 1, 1, id_col, vec_col, None, tolerance)
        order = Window.partitionBy("qid").orderBy("dist", "vec_id")
        return found.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("qid", "vec_id", "hamming", "dist")

    def save(self, path: str) -> None:
        """Write models and entries as tables below ``path``."""
        spark = self.entries.sparkSession
        spark.createDataFrame([(json.dumps(asdict(self.config)),)], "config string").write.mode("overwrite").parquet(f"{path}/config")
        flat = [(0, i, c.tolist()) for i, c in enumerate(self.coarse)] + [(1 + m, i, c.tolist()) for m, book in enumerate(self.books.values) for i, c in enumerate(book)]
        spark.createDataFrame(flat, "part int, entry int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/models")
        self.entries.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/entries")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        config = IvfConfig(**json.loads(spark.read.parquet(f"{path}/config").first()["config"]))
        parts: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/models").orderBy("part", "entry").collect():
            parts.setdefault(r["part"], []).append(r["centroid"])
        coarse = np.array(parts.pop(0))
        return cls(config, coarse, Codebooks(np.array([parts[p] for p in sorted(parts)])), spark.read.parquet(f"{path}/entries").select("hash", "vec_id", "cell", "code"))
