"""Exact nearest neighbours, pairs within a radius, recall with gap cut, duplicate lookup and recall metrics.

Queries go in blocks of bounded size to where the base lies; each task keeps its best k per
query, so only k rows a query and task are shuffled. Base rows with a null or wrongly sized
vector are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.session import materialize

#: Queries broadcast at once, and rows of one side of a compared block.
QUERY_BLOCK = 32768
PAIR_BLOCK = 2048


def vectors_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose list has ``dim`` finite numbers, and those numbers."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.flatnonzero(size == dim)
    start = (np.cumsum(size) - size)[rows]
    x = flat[start[:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim))
    fine = np.isfinite(x).all(1)
    return rows[fine], x[fine]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, summed difference by difference where small."""
    d = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    return np.maximum(d, 0)


def query_blocks(queries: DataFrame, key: str = "id", size: int | None = None) -> Iterator[pa.Table]:
    """The queries as Arrow tables of at most about ``size`` rows each, by hash of their key."""
    size = size or QUERY_BLOCK
    n = queries.count()
    if n <= size:
        yield queries.toArrow()
        return
    blocks = -(-n * 5 // (4 * size))
    queries = materialize(queries.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks))), "queries")
    for b in range(blocks):
        yield queries.filter(F.col("_block") == b).drop("_block").toArrow()


def _best(block, k: int, dim: int, scoped: bool):
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("dist", pa.float64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, groups, q = block.value
        for batch in stream:
            rows, x = vectors_of(batch.column(1), dim)
            if not len(rows):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[rows]
            own = batch.column(2).to_numpy(zero_copy_only=False)[rows] if scoped else None
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for lo in range(0, len(q), 256):
                d = squared(q[lo : lo + 256], x)
                d[qids[lo : lo + 256, None] == ids[None]] = np.inf
                if scoped:
                    d[groups[lo : lo + 256, None] != own[order][None]] = np.inf
                keep = min(k + 8, d.shape[1])
                near = np.argpartition(d, keep - 1, axis=1)[:, :keep] if keep < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
                limit = np.take_along_axis(d, near, 1).max(1)
                i, j = np.nonzero(d <= limit[:, None] + 1e-9)
                exact = ((q[lo + i] - x[j]) ** 2).sum(1)
                fine = np.isfinite(d[i, j])
                i, j, exact = i[fine], j[fine], exact[fine]
                best = np.lexsort((ids[j], exact, i))
                i, j, exact = i[best], j[best], exact[best]
                first = np.searchsorted(i, np.arange(len(d)))
                top = np.arange(len(i)) - first[i] < k
                yield pa.RecordBatch.from_arrays([pa.array(qids[lo + i[top]]), pa.array(ids[j[top]]), pa.array(exact[top])], schema=schema)

    return run


def nearest(base: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str | None = None, dim: int = 64) -> DataFrame:
    """(qid, rank, id, dist): the k nearest base rows of each query, itself left out, by (dist, id).

    With ``group_col`` only rows of the query's own group count. k <= 0 gives nothing.
    """
    spark = base.sparkSession
    if k <= 0:
        return spark.createDataFrame([], "qid long, rank int, id long, dist double")
    group = F.lit(0) if group_col is None else F.col(group_col)
    columns = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), group.cast("long").alias("g")]
    rows = base.select(*columns).filter("id is not null and v is not null and g is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), group.cast("long").alias("g"))
    asked = asked.filter("id is not null and v is not null and g is not null")
    found = None
    for table in query_blocks(asked):  # each block of bounded size becomes a scan of the base
        at, q = vectors_of(table.column("v").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64())), dim)
        value = (table.column("id").to_numpy()[at], table.column("g").to_numpy()[at], q)
        part = rows.mapInArrow(_best(spark.sparkContext.broadcast(value), k, dim, group_col is not None), "qid long, id long, dist double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def _near(radius: float, dim: int):
    schema = {"a": "int64", "b": "int64", "dist": "float64"}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array(frame["v"].tolist(), float).reshape(len(frame), dim)
        ids, left, right = frame["id"].to_numpy(), frame["h"].to_numpy() == frame["i"].to_numpy(), frame["h"].to_numpy() == frame["j"].to_numpy()
        a, b, out = np.flatnonzero(left), np.flatnonzero(right), []
        for lo in range(0, len(a), 512):
            some = a[lo : lo + 512]
            i, j = np.nonzero(squared(x[some], x[b]) < radius + 1e-6)
            i, j = some[i], b[j]
            keep = (ids[i] < ids[j]) if frame["i"].iloc[0] == frame["j"].iloc[0] else ids[i] != ids[j]
            i, j = i[keep], j[keep]
            dist = ((x[i] - x[j]) ** 2).sum(1)
            fine = dist < radius
            out.append((np.minimum(ids[i], ids[j])[fine], np.maximum(ids[i], ids[j])[fine], dist[fine]))
        if not out:
            return pd.DataFrame({"a": [], "b": [], "dist": []}).astype(schema)
        return pd.DataFrame(dict(zip(schema, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def pairs_within(rows: DataFrame, radius: float, id_col: str, vec_col: str, group_col: str, dim: int = 64) -> DataFrame:
    """(a, b, dist), a < b: rows of one group whose squared distance is below ``radius``.

    Groups are compared in blocks of bounded size, so a group of any size spreads over tasks.
    """
    data = rows.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("long").alias("g"), F.col(vec_col).cast("array<double>").alias("v"))
    data = data.filter(F.col("id").isNotNull() & F.col("g").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = data.groupBy("g").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("n"))
    spread = data.join(sizes, "g").withColumn("h", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spread = spread.select("id", "g", "v", "h", F.least("h", "o").alias("i"), F.greatest("h", "o").alias("j"))
    return spread.groupBy("g", "i", "j").applyInPandas(_near(radius, dim), "a long, b long, dist double")


def gap_cut(ranked: DataFrame, gap: float) -> DataFrame:
    """Rows before the first whose distance exceeds the one before by more than the factor ``gap``; gap <= 1 keeps all."""
    if gap <= 1:
        return ranked
    by_rank = Window.partitionBy("qid").orderBy("rank")
    before = F.lag("dist").over(by_rank)
    cut = F.when(before.isNotNull() & (F.col("dist") > before * F.lit(float(gap))), 1).otherwise(0)
    seen = F.max("_cut").over(by_rank.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_cut", cut).withColumn("_seen", seen).filter("_seen = 0").drop("_cut", "_seen")


def gap_scores(ranked: DataFrame, labels: DataFrame, query_labels: DataFrame, gap: float) -> DataFrame:
    """(gap, precision, recall, f1) of the gap cut, averaged over queries; relevant are hits whose label ``hl`` is the query's ``ql``.

    Recall is against the relevant hits before the cut; a query without any has recall 0.
    """
    judged = ranked.join(labels, "id").join(query_labels, "qid").withColumn("good", (F.col("hl") == F.col("ql")).cast("int"))
    every = judged.groupBy("qid").agg(F.sum("good").alias("a"))
    kept = gap_cut(judged, gap).groupBy("qid").agg(F.count("*").alias("n"), F.sum("good").alias("g")).join(every, "qid")
    p, r = F.col("g") / F.col("n"), F.when(F.col("a") > 0, F.col("g") / F.col("a")).otherwise(F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return kept.agg(F.lit(float(gap)).alias("gap"), F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f1).alias("f1"))


def duplicates_of(ranked: DataFrame, tau: float) -> DataFrame:
    """(qid, nearest, dist, is_duplicate): duplicate if strictly nearer than tau; tau 0 turns the rule off."""
    nearest_one = ranked.filter("rank = 1")
    return nearest_one.select("qid", F.col("id").alias("nearest"), "dist", ((F.col("dist") < tau) & F.lit(tau > 0)).alias("is_duplicate"))


def recall_metrics(found: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """recall1_at_r: share of queries whose true nearest is among the first r; inter_at_r: overlap of the first r."""
    f, t = found.filter(F.col("rank") <= r), truth.filter(F.col("rank") <= r)
    both = t.select("qid", "id", F.col("rank").alias("true_rank")).join(f.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return both.agg(
        F.lit(r).alias("r"),
        (F.sum(F.when((F.col("true_rank") == 1) & F.col("hit").isNotNull(), 1).otherwise(0)) / F.countDistinct("qid")).alias("recall1_at_r"),
        (F.sum(F.coalesce("hit", F.lit(0))) / (F.countDistinct("qid") * r)).alias("inter_at_r"),
    )


def weighted_recall(hits: DataFrame, weight: str = "weight", hit: str = "hit") -> DataFrame:
    """Weighted share of hits (0 without weight) and the effective sample size of the weights."""
    return hits.agg(
        F.coalesce(F.sum(F.col(weight) * F.col(hit)) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0)).alias("weighted_recall"),
        F.coalesce(F.pow(F.sum(weight), 2) / F.nullif(F.sum(F.col(weight) * F.col(weight)), F.lit(0.0)), F.lit(0.0)).alias("ess"),
    )
