"""Experiments on an index: second-level codes, depth oracle, reconstructions, streams and predictive allocation.

Distances to reconstructions are computed in Arrow batches next to the codes; models have the
size their configuration names. Streams are generated as columns: a step follows the
successor of the step before or draws anew, so its item is the drawn one moved on by the
number of steps since the last draw, and no step waits for another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.operators.ivf import IvfIndex
from engrava.operators.quant import Codebooks


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _decoded(coarse: np.ndarray, books: Codebooks):
    schema = pa.schema([("vec_id", pa.int64()), ("vec", pa.list_(pa.float64()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            codes = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, books.m)
            x = coarse[batch.column(1).to_numpy()] + books.decode(codes)
            vec = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), coarse.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vec], schema=schema)

    return run


def reconstructed(index: IvfIndex) -> DataFrame:
    """(vec_id, vec): each entry as its codes give it back, centroid and residual."""
    return index.entries.select("vec_id", "cell", "code").mapInArrow(_decoded(index.coarse, index.books), "vec_id long, vec array<double>")


def errors(index: IvfIndex, originals: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, error): original less reconstruction."""
    rows = originals.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_x")).join(reconstructed(index), "vec_id")
    return rows.select("vec_id", F.zip_with("_x", "vec", lambda a, b: a - b).alias("error"))


def _refined(coarse: np.ndarray, books: Codebooks, second: Codebooks):
    schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("plain", pa.float64()), ("refined", pa.float64()), ("exact", pa.float64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            width = coarse.shape[1]
            codes = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, books.m)
            x, q = _matrix(batch.column(4), width), _matrix(batch.column(5), width)
            rough = coarse[batch.column(2).to_numpy()] + books.decode(codes)
            fine = rough + second.decode(second.encode(x - rough)) if len(x) else rough
            far = [((q - y) ** 2).sum(1) for y in (rough, fine, x)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, far)], schema=schema)

    return run


def refined_distances(index: IvfIndex, second: Codebooks, hits: DataFrame, queries: DataFrame, originals: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, vec_id, adc, rank, plain, refined, exact): distances of the hits to the reconstruction, to it with the second code, and to the original."""
    rows = hits.join(index.entries.select("vec_id", "cell", "code"), "vec_id")
    rows = rows.join(originals.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")), "vec_id")
    rows = rows.join(queries.select(F.col(id_col).alias("qid"), F.col(vec_col).cast("array<double>").alias("q")), "qid")
    far = rows.select("qid", "vec_id", "cell", "code", "x", "q").mapInArrow(_refined(index.coarse, index.books, second), "qid long, vec_id long, plain double, refined double, exact double")
    return hits.select("qid", "vec_id", F.col("dist").alias("adc"), "rank").join(far, ["qid", "vec_id"])


def refinement_recall(distances: DataFrame, truth: DataFrame, hot: Column, chance: Column, depths: list[int]) -> DataFrame:
    """(variant, r, recall): share of queries whose true nearest is among the first r, for plain hits and four ways to re-rank them.

    ``hot`` and ``chance`` say which vectors have a second code in the access-gated and the
    random-gated variant. A true nearest outside the hits counts as missed.
    """
    keys = {
        "baseline": F.col("adc"), "access_gated": F.when(hot, F.col("refined")).otherwise(F.col("plain")), "random_gated": F.when(chance, F.col("refined")).otherwise(F.col("plain")),
        "full": F.col("refined"), "exact": F.col("exact"),
    }
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.round(k, 9).alias("d")) for n, k in keys.items()))).alias("v")
    rows = distances.select("qid", "vec_id", each).select("qid", "vec_id", "v.variant", "v.d")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("qid", "variant").orderBy("d", "vec_id")))
    first = truth.filter("rank = 1").select("qid", F.col("id").alias("vec_id"))
    n = first.count()
    grid = F.explode(F.array(*map(F.lit, depths))).alias("r")
    hit = ranked.join(first, ["qid", "vec_id"]).select("variant", "place", grid)
    return hit.groupBy("variant", "r").agg((F.count_if(F.col("place") <= F.col("r")) / F.lit(max(n, 1))).alias("recall"))


def low_rank_vectors(spark, n: int, dim: int, rank: int, noise: float = 0.05, seed: int = 1) -> DataFrame:
    """(vec_id, embedding): unit vectors W z + noise; W and z are drawn uniformly from [-1, 1) by digests, so any part of them can be made anywhere."""
    draw = lambda *parts: 2 * uniform(*(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)) - 1
    z = F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda r: draw("z", seed, F.col("vec_id"), r))
    rows = spark.range(n).withColumnRenamed("id", "vec_id").withColumn("_z", z)

    def component(d):
        sums = F.aggregate(F.transform("_z", lambda v, r: v * draw("w", seed, d, r)), F.lit(0.0), lambda acc, x: acc + x)
        return sums + noise * draw("e", seed, F.col("vec_id"), d)

    raw = rows.withColumn("_x", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), component))
    size = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda acc, x: acc + x * x))
    return raw.withColumn("_n", size).select("vec_id", F.transform("_x", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0)).alias("embedding"))


def query_proxy(nprobe: Column, rerank: Column, dim: int, n: int, nlist: int) -> Column:
    """Operations of one query: codes scanned, and exact distances."""
    return (F.lit(float(n)) * nprobe / F.lit(nlist) + rerank * (2.0 * dim)).cast("double")


def depth_oracle(index: IvfIndex, queries: DataFrame, truth: DataFrame, nprobes: list[int], reranks: list[int], n: int, first: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, nprobe, rerank, cost, found): the cheapest search that returns the true nearest among the first ``first``; else the dearest, not found.

    Re-ranking puts the true nearest first if it is among the re-ranked, so it is returned
    iff its place among the coded hits is within the re-ranked or the returned ones.
    """
    depth, config = max(first, *reranks), index.config
    target = truth.filter("rank = 1").select("qid", F.col("id").alias("vec_id"))
    places = None
    for p in sorted({min(p, config.nlist) for p in nprobes}):
        hits = index.search(queries, p, depth, id_col, vec_col).select("qid", "vec_id", "rank")
        part = target.join(hits, ["qid", "vec_id"], "left").select("qid", F.lit(p).alias("nprobe"), "rank")
        places = part if places is None else places.unionByName(part)
    tries = places.withColumn("rerank", F.explode(F.array(*map(F.lit, reranks))))
    tries = tries.withColumn("found", F.coalesce(F.col("rank") <= F.greatest(F.lit(first), F.col("rerank")), F.lit(False)))
    tries = tries.withColumn("cost", query_proxy(F.col("nprobe"), F.col("rerank"), config.dim, n, config.nlist))
    best = Window.partitionBy("qid").orderBy(F.desc("found"), F.when(F.col("found"), F.col("cost")).otherwise(-F.col("cost")), "nprobe", "rerank")
    return tries.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("qid", "nprobe", "rerank", "cost", "found")


def depth_gate(oracle: DataFrame, features: DataFrame, static_cost: float) -> DataFrame:
    """(oracle_recall, oracle_cost, static_cost, max_corr, passes): whether depth is worth predicting and predictable.

    It passes if the oracle's mean cost is below 0.9 of the static one and some feature
    correlates with the cost by more than 0.2.
    """
    rows = oracle.join(features, "qid")
    names = ["f0", "f1", "f2", "f3"]
    m = lambda x: F.avg(x)

    def corr(c):
        x, y = F.col(c), F.col("cost")
        cov, var = m(x * y) - m(x) * m(y), (m(x * x) - m(x) * m(x)) * (m(y * y) - m(y) * m(y))
        return F.when(var > 1e-18, F.abs(cov / F.sqrt(F.greatest(var, F.lit(1e-300))))).otherwise(F.lit(0.0))

    sums = rows.agg(F.avg(F.col("found").cast("double")).alias("oracle_recall"), m(F.col("cost")).alias("oracle_cost"), F.greatest(*(corr(c) for c in names)).alias("max_corr"))
    passes = (F.col("oracle_cost") < 0.9 * static_cost) & (F.col("max_corr") > 0.2)
    return sums.select("oracle_recall", "oracle_cost", F.lit(static_cost).alias("static_cost"), "max_corr", passes.alias("passes"))


def uniform(*parts) -> Column:
    """A number in [0, 1) drawn from the digest of the parts: the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts))), 1, 8), 16, 10).cast("double") / 4294967296.0


def drawn(weights: DataFrame, x: Column, item: str, weight: str = "weight") -> Column:
    """The item that ``x`` in [0, 1) falls on by inverse cumulated weights, in order of the items.

    ``weights`` becomes an array on the driver: one number per item, for at most 100,000 items.
    """
    rows = weights.select(item, weight).orderBy(item).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("at most 100,000 items can be drawn from")
    sums = np.cumsum([r[1] for r in rows])
    items = F.array(*(F.lit(r[0]) for r in rows))
    # Few distinct steps: the place is the number of sums below x.
    below = F.size(F.filter(F.array(*(F.lit(float(s)) for s in sums)), lambda s: s < x * float(sums[-1])))
    return F.element_at(items, F.least(below, F.lit(len(rows) - 1)) + 1)


def self_exciting(spark, steps: int, etas: list[float], bag, n_items: int, seed: int = 1) -> DataFrame:
    """(eta, t, item): streams that with probability ``eta`` go on to the next item (item + 1 modulo ``n_items``), else draw anew.

    ``bag`` turns a uniform column into an item. Steps are cut into chunks for the search of
    the last draw, with the last draw of each chunk carried over.
    """
    chunk = 10_000
    grid = spark.range(steps).select(F.col("id").alias("t"), F.explode(F.array(*(F.lit(float(e)) for e in etas))).alias("eta"))
    fresh = (F.col("t") == 0) | (uniform(F.lit("follow"), F.lit(seed), F.col("t")) >= F.col("eta"))
    rows = grid.withColumn("_c", F.floor(F.col("t") / chunk)).withColumn("_s", F.when(fresh, F.col("t")))
    last = rows.groupBy("eta", "_c").agg(F.max("_s").alias("_m"))
    carried = last.select("eta", "_c", F.max("_m").over(Window.partitionBy("eta").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = F.max("_s").over(Window.partitionBy("eta", "_c").orderBy("t"))
    rows = rows.withColumn("_s", inside).join(carried, ["eta", "_c"]).withColumn("_s", F.coalesce("_s", "_carry"))
    first = bag(uniform(F.lit("draw"), F.lit(seed), F.col("_s")))
    return rows.select("eta", "t", F.pmod(first.cast("long") + F.col("t") - F.col("_s"), F.lit(n_items)).alias("item"))


def predictive_allocation(stream: DataFrame, distances: DataFrame, truth: DataFrame, fractions: list[float], n: int, first: int = 10) -> DataFrame:
    """(eta, fraction, base, static, predicted, oracle): stream recall when a budget of second codes goes to popular, predicted or the true items.

    ``stream`` has (eta, t, item = qid); ``distances`` the re-ranked hits of every query.
    Popularity counts, over the stream, how often an item is among a query's true nearest;
    the prediction is the most frequent successor so far of the item accessed before, and
    takes one place of the budget.
    """
    from engrava.operators.access import best_before

    nearest = truth.filter("rank = 1").select(F.col("qid").alias("item"), F.col("id").alias("nn"))
    seq = stream.join(nearest, "item").select("eta", "t", F.col("item").alias("qid"), "nn")
    moves = seq.withColumn("prev", F.lag("nn").over(Window.partitionBy("eta").orderBy("t")))
    guesses = best_before(moves.filter("prev is not null").select("eta", F.col("t").alias("seq"), "prev", "nn", F.floor(F.col("t") / 100_000).alias("_chunk")), ["eta", "prev"], "nn")
    seq = seq.join(guesses.select("eta", F.col("seq").alias("t"), F.col("best").alias("guess")), ["eta", "t"], "left")
    asked = seq.groupBy("eta", "qid").agg(F.count("*").alias("times"))
    popular = asked.join(truth.select("qid", F.col("id").alias("vec_id")), "qid").groupBy("eta", "vec_id").agg(F.sum("times").alias("pop"))
    popular = popular.withColumn("place", F.row_number().over(Window.partitionBy("eta").orderBy(F.desc("pop"), "vec_id")) - 1)
    # A step's outcome depends on its query, its true nearest and the guess only.
    kinds = seq.groupBy("eta", "qid", "nn", "guess").agg(F.count("*").alias("n_steps"))
    grid = F.explode(F.array(*(F.struct(F.lit(f).alias("fraction"), F.lit(int(f * n + 0.5)).alias("m")) for f in fractions))).alias("g")
    rows = kinds.join(distances, "qid").join(popular, ["eta", "vec_id"], "left").select("*", grid).select("*", "g.*")
    place, m = F.coalesce(F.col("place"), F.lit(1 << 40)), F.col("m")
    active = {
        "base": F.lit(False), "static": place < m,
        "predicted": F.coalesce(F.col("vec_id") == F.col("guess"), F.lit(False)) | (place < m - F.col("guess").isNotNull().cast("int")),
        "oracle": (F.col("vec_id") == F.col("nn")) | (place < m - 1),
    }
    group = ["eta", "fraction", "qid", "nn", "guess"]
    ranked = rows.select(*group, "n_steps", "vec_id", *(F.row_number().over(Window.partitionBy(*group).orderBy(F.round(F.when(a, F.col("refined")).otherwise(F.col("plain")), 9), "vec_id")).alias(k) for k, a in active.items()))
    hits = ranked.filter("vec_id = nn").groupBy("eta", "fraction").agg(*(F.sum(F.when(F.col(k) <= first, F.col("n_steps")).otherwise(0)).alias(k) for k in active))
    total = seq.groupBy("eta").agg(F.count("*").alias("_n"))
    return hits.join(total, "eta").select("eta", "fraction", *((F.col(k) / F.col("_n")).alias(k) for k in active))
