"""Registered queries over the access log: prediction, cache policies, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrava.operators import access, cache
from engrava.session import table

CAPACITIES = (4, 16, 64)


def log(spark, d):
    return table(spark, d, "access_log")


def markov_transitions(spark, d):
    return access.transitions(log(spark, d))


def markov_predict_topk(spark, d):
    return access.predictions(access.transitions(log(spark, d)), 3)


def stream_lift(spark, d):
    r = access.stream_lift(log(spark, d))
    return r.withColumns({c: F.round(c, 6) for c in ("markov_hit", "marginal_hit", "coverage", "lift")})


def marginal_baseline(spark, d):
    """Per tenant how often the item seen most often so far is the next one."""
    moves = access.steps(log(spark, d)).filter("prev is not null")
    return access.best_before(moves, ["tenant"], "item").groupBy("tenant").agg(F.count("*").alias("steps"), F.count_if(F.col("best") == F.col("item")).alias("hits"))


def distinct_items(spark, d):
    return log(spark, d).filter("item_id is not null").groupBy("tenant").agg(F.countDistinct("item_id").alias("n_items"))


def lru_hit_rate(spark, d):
    r = cache.replay(log(spark, d), CAPACITIES, ("lru",))
    return r.select("tenant", "capacity", "accesses", "hits", F.round(F.col("hits") / F.col("accesses"), 6).alias("hit_rate"))


def lfu_replay(spark, d):
    return cache.replay(log(spark, d), CAPACITIES, ("lfu",))


def markov_prefetch_replay(spark, d):
    return cache.replay(log(spark, d), CAPACITIES, ("markov",))


def exact_tier_replay(spark, d):
    """Items each policy brings in, which is what a tier of exact vectors fetches."""
    r = cache.replay(log(spark, d), CAPACITIES)
    return r.groupBy("policy", "capacity").agg(F.sum("accesses").alias("accesses"), F.sum("fetches").alias("fetches"))


def cache_cost_model(spark, d):
    r = cache.replay(log(spark, d), CAPACITIES, ("lru",))
    return cache.costs(r, 1.0, 20.0).select("policy", "capacity", *(F.round(c, 6).alias(c) for c in ("hit_rate", "latency", "bandwidth", "saved")))


def tier_members(spark, d):
    """Vectors an LRU tier of 16 items holds for each tenant after the log; items take the vectors in turn."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    items = table(spark, d, "path_map").select(F.col("item_id").alias("item"), (F.col("item_id") % vectors.count()).alias("vec_id"))
    vectors = items.join(vectors, "vec_id").select("item", "vec")
    return cache.tier(log(spark, d), vectors, 16).select("tenant", "item", F.round(F.element_at("vec", 1).cast("double"), 5).alias("first"))


def tier_stream_recall(spark, d):
    """Recall on each tenant's stream with an LRU tier of 16 in front of a search that misses every third item."""
    rows = log(spark, d).filter("item_id is not null").dropDuplicates(["seq"]).select("tenant", "seq", F.col("item_id").alias("item"), (F.col("item_id") % 3 != 0).alias("coded"))
    return cache.tier_recall(rows, 16)


def costs_by_policy(spark, d):
    """Hit rate, latency and bandwidth of each policy, and latency saved against LRU."""
    r = cache.replay(log(spark, d), CAPACITIES)
    return cache.costs(r, 1.0, 20.0).select("policy", "capacity", *(F.round(c, 6).alias(c) for c in ("hit_rate", "latency", "bandwidth", "saved")))


QUERIES = {
    f.__name__: f
    for f in (
        markov_transitions, markov_predict_topk, stream_lift, marginal_baseline, distinct_items, lru_hit_rate, lfu_replay, markov_prefetch_replay, exact_tier_replay, cache_cost_model, tier_members, tier_stream_recall, costs_by_policy,
    )
}

_S = """WITH r AS (SELECT DISTINCT tenant, seq, item_id AS item FROM access_log WHERE item_id IS NOT NULL),
s AS (SELECT tenant, seq, item, lag(item) OVER (PARTITION BY tenant ORDER BY seq) AS prev, row_number() OVER (PARTITION BY tenant ORDER BY seq) AS i FROM r),
mv AS (SELECT * FROM s WHERE prev IS NOT NULL)"""
_LIFT = _S + """,
mk AS (SELECT b.tenant, b.seq, b.item, a.item AS guess, count(*) AS n FROM mv b JOIN mv a ON a.tenant = b.tenant AND a.prev = b.prev AND a.seq < b.seq GROUP BY ALL),
mb AS (SELECT tenant, item, guess FROM mk QUALIFY row_number() OVER (PARTITION BY tenant, seq ORDER BY n DESC, guess) = 1),
mh AS (SELECT tenant, count(*) AS predictable, count(*) FILTER (item = guess) AS hits FROM mb GROUP BY tenant),
pk AS (SELECT b.tenant, b.seq, b.item, a.item AS guess, count(*) AS n FROM mv b JOIN mv a ON a.tenant = b.tenant AND a.seq < b.seq GROUP BY ALL),
pb AS (SELECT tenant, item, guess FROM pk QUALIFY row_number() OVER (PARTITION BY tenant, seq ORDER BY n DESC, guess) = 1),
ph AS (SELECT tenant, count(*) FILTER (item = guess) AS plain FROM pb GROUP BY tenant),
t AS (SELECT tenant, count(*) AS total FROM s GROUP BY tenant),
j AS (SELECT t.tenant, total, coalesce(predictable, 0) AS predictable, coalesce(hits, 0) AS hits, coalesce(plain, 0) AS plain FROM t LEFT JOIN mh USING (tenant) LEFT JOIN ph USING (tenant)),
rt AS (SELECT tenant, total, predictable, CASE WHEN predictable > 0 THEN hits / predictable ELSE 0.0 END AS markov_hit, CASE WHEN predictable > 0 THEN plain / (total - 1) ELSE 0.0 END AS marginal_hit, CASE WHEN predictable > 0 THEN predictable / (total - 1) ELSE 0.0 END AS coverage FROM j)"""
_LRU = _S + """, l AS (SELECT tenant, item, i, lag(i) OVER (PARTITION BY tenant, item ORDER BY i) AS p FROM s),
sd AS (SELECT l.tenant, l.i, count(DISTINCT b.item) AS depth FROM l JOIN s b ON b.tenant = l.tenant AND b.i > l.p AND b.i < l.i GROUP BY ALL),
a AS (SELECT l.tenant, l.i, l.p, coalesce(depth, 0) AS depth FROM l LEFT JOIN sd ON sd.tenant = l.tenant AND sd.i = l.i),
lru AS (SELECT tenant, CAST(c AS INTEGER) AS capacity, count(*) AS accesses, count(*) FILTER (p IS NOT NULL AND depth < c) AS hits FROM a CROSS JOIN (SELECT unnest([4, 16, 64]) AS c) GROUP BY tenant, c)"""

# Policies replayed access by access; a cache is a list whose first element goes next.
_FOLD = """WITH RECURSIVE r AS (SELECT DISTINCT tenant, seq, item_id AS item FROM access_log WHERE item_id IS NOT NULL),
s AS (SELECT tenant, seq, item, lag(item) OVER (PARTITION BY tenant ORDER BY seq) AS prev, row_number() OVER (PARTITION BY tenant ORDER BY seq) AS i FROM r),
mv AS (SELECT * FROM s WHERE prev IS NOT NULL),
cp AS (SELECT CAST(unnest([4, 16, 64]) AS INTEGER) AS c), tn AS (SELECT DISTINCT tenant FROM s)"""
_LFU = """,
lf AS (SELECT tenant, c, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(n BIGINT, x BIGINT)[]) AS held, CAST(0 AS BIGINT) AS hits FROM tn, cp
UNION ALL SELECT lf.tenant, c, s.i, CASE WHEN list_contains(list_transform(held, lambda e: e.x), item) THEN list_transform(held, lambda e: CASE WHEN e.x = item THEN {'n': e.n + 1, 'x': e.x} ELSE e END)
WHEN len(held) >= c THEN list_append(list_sort(held)[2:], {'n': CAST(1 AS BIGINT), 'x': item}) ELSE list_append(held, {'n': CAST(1 AS BIGINT), 'x': item}) END,
hits + CASE WHEN list_contains(list_transform(held, lambda e: e.x), item) THEN 1 ELSE 0 END FROM lf JOIN s ON s.tenant = lf.tenant AND s.i = lf.i + 1),
lfu AS (SELECT tenant, 'lfu' AS policy, c AS capacity, i AS accesses, hits, CAST(0 AS BIGINT) AS prefetches, CAST(0 AS BIGINT) AS loads, i - hits AS fetches FROM lf QUALIFY row_number() OVER (PARTITION BY tenant, c ORDER BY i DESC) = 1)"""
_MARKOV = """,
gk AS (SELECT b.tenant, b.i, a.item AS guess, count(*) AS n FROM s b JOIN mv a ON a.tenant = b.tenant AND a.prev = b.item AND a.i <= b.i GROUP BY ALL),
gs AS (SELECT tenant, i, guess FROM gk QUALIFY row_number() OVER (PARTITION BY tenant, i ORDER BY n DESC, guess) = 1),
sg AS (SELECT s.tenant, s.i, item, guess FROM s LEFT JOIN gs ON gs.tenant = s.tenant AND gs.i = s.i),
mk AS (SELECT tenant, c, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS held, CAST(0 AS BIGINT) AS hits, CAST(0 AS BIGINT) AS pf, CAST(0 AS BIGINT) AS ld FROM tn, cp
UNION ALL SELECT tenant, c, i, CASE WHEN guess IS NULL THEN mid ELSE list_append(list_filter(mid, lambda e: e <> guess), guess)[-c:] END, hits, pf + CASE WHEN guess IS NULL THEN 0 ELSE 1 END,
ld + CASE WHEN guess IS NOT NULL AND NOT list_contains(mid, guess) THEN 1 ELSE 0 END
FROM (SELECT mk.tenant, c, sg.i, list_append(list_filter(held, lambda e: e <> item), item)[-c:] AS mid, hits + CASE WHEN list_contains(held, item) THEN 1 ELSE 0 END AS hits, pf, ld, guess FROM mk JOIN sg ON sg.tenant = mk.tenant AND sg.i = mk.i + 1)),
markov AS (SELECT tenant, 'markov' AS policy, c AS capacity, i AS accesses, hits, pf AS prefetches, ld AS loads, i - hits + ld AS fetches FROM mk QUALIFY row_number() OVER (PARTITION BY tenant, c ORDER BY i DESC) = 1)"""
_LRU_PART = _LRU[len(_S) :]
_ALL = _FOLD + _LFU + _MARKOV + _LRU_PART + """, every AS (SELECT * FROM lfu UNION ALL SELECT * FROM markov UNION ALL SELECT tenant, 'lru', capacity, accesses, hits, 0, 0, accesses - hits FROM lru)"""

ORACLES = {
    "markov_transitions": _S + " SELECT tenant, prev, item, count(*) AS n FROM mv GROUP BY ALL",
    "markov_predict_topk": _S + ", g AS (SELECT tenant, prev, item, count(*) AS n FROM mv GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY tenant, prev ORDER BY n DESC, item) AS INTEGER) AS rank FROM g QUALIFY rank <= 3",
    "stream_lift": _LIFT + " SELECT tenant, total, predictable, round(markov_hit, 6) AS markov_hit, round(marginal_hit, 6) AS marginal_hit, round(coverage, 6) AS coverage, round(markov_hit - marginal_hit, 6) AS lift, markov_hit - marginal_hit > 0.05 AS predictable_stream FROM rt",
    "marginal_baseline": _LIFT + ", n AS (SELECT tenant, count(*) AS steps FROM mv GROUP BY tenant) SELECT n.tenant, steps, coalesce(plain, 0) AS hits FROM n LEFT JOIN ph USING (tenant)",
    "distinct_items": "SELECT tenant, count(DISTINCT item_id) AS n_items FROM access_log WHERE item_id IS NOT NULL GROUP BY tenant",
    "lru_hit_rate": _LRU + " SELECT *, round(hits / accesses, 6) AS hit_rate FROM lru",
    "cache_cost_model": _LRU + """, x AS (SELECT capacity, sum(hits) / sum(accesses) AS h FROM lru GROUP BY capacity)
SELECT 'lru' AS policy, capacity, round(h, 6) AS hit_rate, round(h + (1 - h) * 20, 6) AS latency, round(1 - h, 6) AS bandwidth, 0.0::DOUBLE AS saved FROM x""",
    "lfu_replay": _FOLD + _LFU + " SELECT * FROM lfu",
    "markov_prefetch_replay": _FOLD + _MARKOV + " SELECT * FROM markov",
    "exact_tier_replay": _ALL + " SELECT policy, capacity, CAST(sum(accesses) AS BIGINT) AS accesses, CAST(sum(fetches) AS BIGINT) AS fetches FROM every GROUP BY policy, capacity",
    "costs_by_policy": _ALL + """, x AS (SELECT policy, capacity, sum(hits) / sum(accesses) AS h, sum(fetches) / sum(accesses) AS b FROM every GROUP BY ALL), y AS (SELECT *, h + (1 - h) * 20 AS l FROM x)
SELECT y.policy, y.capacity, round(y.h, 6) AS hit_rate, round(y.l, 6) AS latency, round(y.b, 6) AS bandwidth, round(1 - y.l / z.l, 6) AS saved FROM y JOIN y z ON z.capacity = y.capacity AND z.policy = 'lru'""",
    "tier_members": """WITH l AS (SELECT tenant, item_id AS item, max(seq) AS s FROM access_log WHERE item_id IS NOT NULL GROUP BY ALL), h AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY s DESC) <= 16)
SELECT tenant, item, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM h JOIN path_map ON item_id = item JOIN embeddings ON vec_id = item % (SELECT count(*) FROM embeddings)""",
    "tier_stream_recall": _LRU + """, q AS (SELECT a.tenant, p IS NOT NULL AND depth < 16 AS resident, item % 3 <> 0 AS coded FROM a JOIN s ON s.tenant = a.tenant AND s.i = a.i)
SELECT tenant, count(*) AS accesses, count(*) FILTER (resident) AS resident, count(*) FILTER (resident OR coded) AS hits, count(*) FILTER (resident) AS hits_resident, count(*) FILTER (NOT resident AND coded) AS hits_missing FROM q GROUP BY tenant""",
}
