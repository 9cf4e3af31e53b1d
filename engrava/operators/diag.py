"""Error budget of an approximate index, and the statistics used to judge features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.functions.vec import dot, norm, total
from engrava.session import materialize
from engrava.operators.knn import query_blocks, squared, vectors_of


def coarse_rank_of_truth(probes: DataFrame, truth: DataFrame, cells: DataFrame) -> DataFrame:
    """(qid, true_cell_rank): rank of the cell that holds the true nearest vector in the query's probe order."""
    nearest = truth.filter("rank = 1").select("qid", F.col("id").alias("vec_id"))
    return nearest.join(cells.select("vec_id", "cell"), "vec_id").join(probes, ["qid", "cell"]).select("qid", F.col("probe_rank").alias("true_cell_rank"))


def coarse_miss(ranks: DataFrame, nprobes: list[int]) -> DataFrame:
    """Per number of probed cells the share of queries whose true cell is not probed."""
    grid = F.explode(F.array(*(F.lit(n) for n in nprobes))).alias("nprobe")
    return ranks.select("true_cell_rank", grid).groupBy("nprobe").agg(F.avg((F.col("true_cell_rank") > F.col("nprobe")).cast("double")).alias("miss_rate"))


def rank_stats(ranks: DataFrame) -> DataFrame:
    """(mean_rank, p95_rank) of the true cell, counted from 0; the percentile is the value at index n * 95 / 100."""
    # Counts per rank are summed up, so there is one row a cell and not one a query in the window.
    counts = ranks.groupBy((F.col("true_cell_rank") - 1).alias("r")).agg(F.count("*").alias("n"))
    up_to = counts.withColumn("until", F.sum("n").over(Window.orderBy("r"))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    return up_to.agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("mean_rank"), F.min(F.when(F.col("until") > F.floor(F.col("total") * 95 / 100), F.col("r"))).cast("int").alias("p95_rank"))


def parallel_split(errors: DataFrame, vec: str = "vec", error: str = "error") -> DataFrame:
    """Mean squared error along the vector and across it, and mean of the parallel share; zero errors have no share."""
    along = F.pow(dot(error, vec) / F.nullif(norm(vec), F.lit(0.0)), 2)
    whole = total(F.transform(F.col(error), lambda x: x * x))
    parts = errors.select(F.coalesce(along, F.lit(0.0)).alias("p"), whole.alias("w"))
    return parts.agg(
        F.avg("p").alias("parallel"), F.avg(F.col("w") - F.col("p")).alias("orthogonal"), F.coalesce(F.avg(F.when(F.col("w") > 0, F.col("p") / F.col("w"))), F.lit(0.0)).alias("rho")
    )


def subspace_variance(residuals: DataFrame, parts: int, dim: int, col: str = "residual") -> DataFrame:
    """Per subspace E|r|^2 - |E r|^2."""
    flat = residuals.select(F.posexplode(col).alias("pos", "x"))
    per = flat.groupBy("pos").agg(F.avg(F.col("x") * F.col("x")).alias("s"), F.avg("x").alias("m"))
    return per.groupBy(F.floor(F.col("pos") / (dim // parts)).cast("int").alias("part")).agg(F.sum(F.col("s") - F.col("m") * F.col("m")).alias("variance"))


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation; 0 where either side does not vary."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    cov = F.avg(a * b) - F.avg(a) * F.avg(b)
    var = (F.avg(a * a) - F.avg(a) * F.avg(a)) * (F.avg(b * b) - F.avg(b) * F.avg(b))
    return rows.agg(F.when(var > 1e-18, cov / F.sqrt(F.greatest(var, F.lit(1e-300)))).otherwise(F.lit(0.0)).alias("pearson"))


def decile_miss(rows: DataFrame, order: list[str], miss: str) -> DataFrame:
    """Ten buckets of n div 10 rows by order, the last with the remainder; needs ten rows or more."""
    n = rows.count()
    if n < 10:
        raise ValueError("deciles need at least ten rows")
    # Numbered by range partitions, so no single task sorts all rows.
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialize(parts.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "deciles")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = parts.join(offsets, "_part").withColumn("_r", F.col("_offset") + F.col("_at") - F.col("_first"))
    return ranked.groupBy(F.least(F.floor(F.col("_r") / (n // 10)), F.lit(9)).cast("int").alias("decile")).agg(F.count("*").alias("n"), F.avg(F.col(miss).cast("double")).alias("miss_rate"))


def tau_extrema(pairs: DataFrame) -> DataFrame:
    """Largest distance within a group, least across groups, and the midpoint where they separate."""
    within = F.max(F.when(F.col("same"), F.col("dist")))
    across = F.min(F.when(~F.col("same"), F.col("dist")))
    return pairs.agg(within.alias("max_within"), across.alias("min_across"), F.when(within < across, (within + across) / 2).alias("tau"))


def _extrema(block, dim: int):
    schema = pa.schema([("max_within", pa.float64()), ("min_across", pa.float64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, q = block.value
        within, across = -np.inf, np.inf
        for batch in stream:
            at, x = vectors_of(batch.column(1), dim)
            own, label = batch.column(0).to_numpy()[at], batch.column(2).to_numpy()[at]
            for lo in range(0, len(q) if len(x) else 0, 512):
                d = squared(q[lo : lo + 512], x)
                other = ids[lo : lo + 512, None] != own[None]
                same = groups[lo : lo + 512, None] == label[None]
                within = max(within, np.where(same & other, d, -np.inf).max())
                across = min(across, np.where(~same, d, np.inf).min())
        found = [None if not np.isfinite(v) else float(v) for v in (within, across)]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.float64()) for v in found], schema=schema)

    return run


def tau_probe(base: DataFrame, queries: DataFrame, id_col: str, vec_col: str, group_col: str, dim: int) -> DataFrame:
    """``tau_extrema`` of all pairs of a query and another base row; each task hands on two numbers a block of queries."""
    columns = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(group_col).cast("long").alias("g"))
    rows, found = columns(base).filter("id is not null and g is not null"), None
    for table in query_blocks(columns(queries).filter("id is not null and g is not null")):
        at, q = vectors_of(table.column("v").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64())), dim)
        value = table.column("id").to_numpy()[at], table.column("g").to_numpy()[at], q
        part = rows.mapInArrow(_extrema(base.sparkSession.sparkContext.broadcast(value), dim), "max_within double, min_across double")
        found = part if found is None else found.unionByName(part)
    within, across = F.max("max_within"), F.min("min_across")
    return found.agg(within.alias("max_within"), across.alias("min_across"), F.when(within < across, (within + across) / 2).alias("tau"))
