"""Frequent chains of events across many sequences, gaps allowed.

Vertical identifier lists: every pattern keeps the (entity, position) pairs at which it
ends; a longer pattern comes from a temporal join of its list with the list of frequent
steps; patterns that too few different entities follow are pruned after every join, and a
pattern is only tried if its tail is frequent too.

An occurrence's next event comes strictly later in the order of (time, sequence number), at
most ``max_gap`` after it, and is an item not yet in the pattern. Records with a null
entity, item, time or sequence number are left out; a sequence number that occurs again
counts once; an empty table has no patterns. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrava.session import materialize


#: Width of a join window in gaps: one row in WINDOW is sent twice.
WINDOW = 8


def _positions(log: DataFrame, entity: str, item: str, time: str, seq: str) -> DataFrame:
    rows = log.select(
        F.col(entity).cast("long").alias("e"), F.col(item).cast("long").alias("item"), F.col(time).cast("long").alias("t"), F.col(seq).cast("long").alias("s")
    )
    return rows.na.drop("any")


def _supported(lists: DataFrame, key: list[str], least: float) -> DataFrame:
    """Keys that at least ``least`` different entities have; entities are made distinct before they are counted."""
    followers = lists.select(*key, "e").distinct()
    return followers.groupBy(*key).agg(F.count("*").alias("support")).filter(F.col("support") >= least)


def frequent_chains(
    log: DataFrame,
    share: float = 0.10,
    min_length: int = 3,
    max_gap: int = 60_000_000_000,
    entity: str = "tenant",
    item: str = "item_id",
    time: str = "ts_ns",
    seq: str = "seq",
) -> DataFrame:
    """(pattern array<long>, support) of all chains of different items that enough entities follow."""
    if not 0 < share <= 1 or min_length < 1 or max_gap < 1:
        raise ValueError("need 0 < share <= 1, min_length >= 1 and max_gap >= 1")
    spark = log.sparkSession
    rows = _positions(log, entity, item, time, seq)
    # Redelivered records repeat (entity, item, time, seq), so they never make an entity count twice.
    per_item = rows.groupBy("item", "e").agg(F.lit(1).alias("one"))
    entities = rows.select("e").distinct().count()
    least = share * entities - 1e-9
    items = materialize(per_item.groupBy("item").agg(F.count("*").alias("support")).filter(F.col("support") >= least), "items")
    found = [items.select(F.array("item").alias("pattern"), "support")]

    # A step lies within one window of WINDOW gaps, or ends in the first gap of the next one.
    kept = rows.join(items.select("item"), "item", "left_semi")
    width = WINDOW * max_gap
    window, into = F.floor(F.col("t") / F.lit(width)).cast("long"), F.pmod(F.col("t"), F.lit(width))
    windows = F.when(into <= max_gap, F.array(window, window - 1)).otherwise(F.array(window))
    early = kept.select("e", F.col("item").alias("a"), F.col("t").alias("ta"), F.col("s").alias("sa"), window.alias("w"))
    late = kept.select("e", F.col("item").alias("b"), F.col("t").alias("tb"), F.col("s").alias("sb"), F.explode(windows).alias("w"))
    close = (F.col("tb") >= F.col("ta")) & (F.col("tb") <= F.col("ta") + max_gap) & (F.col("a") != F.col("b"))
    # First without sequence numbers: equal times count in both orders, which only adds candidates.
    near = early.drop("sa").join(late.drop("sb"), ["e", "w"]).filter(close)
    candidates = materialize(_supported(near, ["a", "b"], least), "pairs").select("a", "b")
    early = early.join(candidates.select("a").distinct(), "a", "left_semi")
    late = late.join(candidates.select("b").distinct(), "b", "left_semi")
    after = (F.col("tb") > F.col("ta")) | (F.col("sb") > F.col("sa"))
    steps = early.join(late, ["e", "w"]).filter(close & after).join(candidates, ["a", "b"], "left_semi")
    steps = materialize(steps.select("e", "a", "ta", "sa", "b", "tb", "sb").distinct(), "steps")
    pairs = materialize(_supported(steps, ["a", "b"], least), "pairs")
    found.append(pairs.select(F.array("a", "b").alias("pattern"), "support"))
    steps = steps.join(pairs.select("a", "b"), ["a", "b"], "left_semi")
    lists = steps.select(F.array("a", "b").alias("pattern"), "e", F.col("b").alias("a"), F.col("tb").alias("ta"), F.col("sb").alias("sa"))
    level, length = pairs.select(F.array("a", "b").alias("pattern")), 2
    while True:
        # Candidates: a frequent pattern and a frequent pattern that continues its tail.
        head = level.select("pattern", F.slice("pattern", 2, length - 1).alias("tail"))
        follow = level.select(F.slice("pattern", 1, length - 1).alias("tail"), F.element_at("pattern", -1).alias("b"))
        tries = head.join(follow, "tail").filter(~F.array_contains("pattern", F.col("b"))).select("pattern", "b")
        longer = (
            lists.join(steps.select("e", "a", "ta", "sa", "b", "tb", "sb"), ["e", "a", "ta", "sa"])
            .join(tries, ["pattern", "b"], "left_semi")
            .select(F.concat("pattern", F.array("b")).alias("pattern"), "e", F.col("b").alias("a"), F.col("tb").alias("ta"), F.col("sb").alias("sa"))
            .distinct()
        )
        longer = materialize(longer, "lists")
        frequent = materialize(_supported(longer, ["pattern"], least), "frequent")
        length += 1
        if frequent.isEmpty():
            break
        found.append(frequent)
        level = frequent.select("pattern")
        lists = longer.join(level, "pattern", "left_semi")
    found = [f for n, f in enumerate(found, 1) if n >= min_length]
    if not found:
        return spark.createDataFrame([], "pattern array<long>, support long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
