"""Access streams: next-item prediction, popularity, hot sets and weights.

The online predictors are stated over windows: the best item before a step is the greatest
(running count, lower id) seen before it. Streams are cut into chunks of bounded sequence
range, with each chunk's counts carried over as sums, so a tenant that holds much of the
log spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.session import materialize

#: Range of sequence numbers in one chunk; a sequence number is unique, so this bounds its rows.
CHUNK = 100_000


def steps(log: DataFrame) -> DataFrame:
    """(tenant, seq, item, prev): each access with the item accessed before it, in sequence order.

    Null items are left out, redelivered records count once.
    """
    rows = log.filter("item_id is not null").select("tenant", "seq", F.col("item_id").alias("item")).dropDuplicates(["seq"])
    rows = rows.withColumn("_chunk", F.floor(F.col("seq") / CHUNK))
    inside = Window.partitionBy("tenant", "_chunk").orderBy("seq")
    lasts = rows.groupBy("tenant", "_chunk").agg(F.max_by("item", "seq").alias("_last"))
    carried = lasts.select("tenant", "_chunk", F.lag("_last").over(Window.partitionBy("tenant").orderBy("_chunk")).alias("_carry"))
    return rows.join(carried, ["tenant", "_chunk"]).select("tenant", "_chunk", "seq", "item", F.coalesce(F.lag("item").over(inside), "_carry").alias("prev"))


def best_before(rows: DataFrame, group: list[str], target: str) -> DataFrame:
    """``rows`` with ``best``: the most frequent target of the group strictly before the row, ties to the lower id."""
    per_chunk = rows.groupBy(*group, target, "_chunk").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group, target).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = per_chunk.select(*group, target, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"), "_n")
    tops = base.groupBy(*group, "_chunk").agg(F.max(F.struct((F.col("_base") + F.col("_n")).alias("n"), (-F.col(target)).alias("t"))).alias("_top"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*group, "_chunk", F.max("_top").over(before).alias("_carry"))
    counted = (
        rows.join(base.drop("_n"), [*group, target, "_chunk"])
        .withColumn("_count", F.col("_base") + F.row_number().over(Window.partitionBy(*group, target, "_chunk").orderBy("seq")))
        .join(carried, [*group, "_chunk"])
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.struct(F.col("_count").alias("n"), (-F.col(target)).alias("t"))).over(inside)
    top = F.greatest(F.coalesce(seen, F.col("_carry")), F.coalesce(F.col("_carry"), seen))
    return counted.withColumn("best", -top["t"]).drop("_base", "_count", "_carry")


def stream_lift(log: DataFrame) -> DataFrame:
    """Per tenant: total, predictable, markov_hit, marginal_hit, coverage, lift and a verdict.

    The first access of a tenant is never counted by the marginal predictor; without a
    predictable step all rates are 0.
    """
    every = materialize(steps(log), "steps")
    moves = every.filter("prev is not null")
    markov = best_before(moves, ["tenant", "prev"], "item").groupBy("tenant").agg(
        F.count("best").alias("predictable"), F.count_if(F.col("best") == F.col("item")).alias("hits")
    )
    marginal = best_before(moves, ["tenant"], "item").groupBy("tenant").agg(F.count_if(F.col("best") == F.col("item")).alias("plain"))
    totals = every.groupBy("tenant").agg(F.count("*").alias("total"))
    joined = totals.join(markov, "tenant", "left").join(marginal, "tenant", "left").fillna(0, ["predictable", "hits", "plain"])
    some = F.col("predictable") > 0
    rate = lambda c, n: F.when(some, F.col(c) / n).otherwise(F.lit(0.0))
    rates = joined.select(
        "tenant", "total", "predictable",
        rate("hits", F.nullif("predictable", F.lit(0))).alias("markov_hit"),
        rate("plain", F.nullif(F.col("total") - 1, F.lit(0))).alias("marginal_hit"),
        rate("predictable", F.nullif(F.col("total") - 1, F.lit(0))).alias("coverage"),
    )
    lift = F.col("markov_hit") - F.col("marginal_hit")
    return rates.withColumn("lift", lift).withColumn("predictable_stream", lift > 0.05)


def transitions(log: DataFrame) -> DataFrame:
    """(tenant, prev, item, n): how often one item follows another."""
    return steps(log).filter("prev is not null").groupBy("tenant", "prev", "item").agg(F.count("*").alias("n"))


def predictions(moves: DataFrame, k: int) -> DataFrame:
    """The k likeliest next items of each (tenant, prev), by (count desc, id)."""
    order = Window.partitionBy("tenant", "prev").orderBy(F.desc("n"), "item")
    return moves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def popularity(truth: DataFrame, weights: DataFrame, first: int) -> DataFrame:
    """(id, popularity): summed weight of the queries that have the item among their ``first`` nearest."""
    return truth.filter(F.col("rank") <= first).join(weights, "qid").groupBy("id").agg(F.sum("weight").alias("popularity"))


def hot_set(scores: DataFrame, fraction: float, n_items: Column | int, score: str = "popularity", item: str = "id") -> DataFrame:
    """The round(fraction * n_items) items with the highest score, ties to the lower id."""
    wanted = F.least(F.greatest(F.round(F.lit(fraction) * n_items), F.lit(0)), F.lit(n_items) if isinstance(n_items, int) else n_items)
    if isinstance(n_items, int):
        return scores.orderBy(F.desc(score), item).limit(min(max(int(fraction * n_items + 0.5), 0), n_items))
    return scores.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(score), item))).filter(F.col("_r") <= wanted).drop("_r")


def zipf_weights(items: DataFrame, s: float, item: str = "id") -> DataFrame:
    """(item, weight): rank^-s over a deterministic shuffle of the items by their digest.

    Ranks come from range-partitioned counts, so no single task sorts all items.
    """
    keyed = items.select(item).distinct().withColumn("_k", F.md5(F.col(item).cast("string")))
    parts = keyed.repartitionByRange("_k", item).sortWithinPartitions("_k", item)
    numbered = materialize(parts.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.col("_offset") + F.col("_at") - F.col("_first") + 1
    return numbered.join(offsets, "_part").select(item, F.pow(rank.cast("double"), F.lit(-s)).alias("weight"))
