"""Registered queries of the experiments: second-level codes, depth oracle, calibration sweeps, generated streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from engrava.functions import vec
from engrava.operators import access, diag, knn, lab, quant, tune
from engrava.plans.vector_queries import _COARSE, _E, _PQ, _RANKS, _SELF, _TOP, _W, DIM, NLIST, K, M, _coarse, _dist, _index, _probes, _round, _truth, _weights, asked, base, query_margin_features
from engrava.session import materialize


def _second(spark, b, index):
    """Second codebooks: the parts of the first vectors' errors."""
    e = lab.errors(index, b)
    first = e.filter(F.col("vec_id") < K).orderBy("vec_id").select("error").collect()
    return quant.Codebooks(np.array([r[0] for r in first], float).reshape(len(first), M, DIM // M).transpose(1, 0, 2))


def _shortlist(spark, d):
    b, index = _index(spark, d)
    q = asked(b)
    hits = index.search(q, 4, 50)
    return b, q, materialize(lab.refined_distances(index, _second(spark, b, index), hits, q, b), "refined")


def refinement_variants(spark, d):
    """Recall of plain hits and of hits re-ranked with second codes for hot, random, all vectors, and exactly."""
    b, q, far = _shortlist(spark, d)
    scores = access.popularity(_truth(b), _weights(b), 10).withColumn("popularity", F.round("popularity", 6))
    hot = access.hot_set(scores, 0.2, b.count()).select(F.col("id").alias("vec_id"), F.lit(True).alias("hot"))
    far = far.join(hot, "vec_id", "left")
    return _round(lab.refinement_recall(far, _truth(b), F.coalesce("hot", F.lit(False)), lab.uniform(F.col("vec_id").cast("string")) < 0.2, [1, 3, 10]), "recall")


def depth_oracle(spark, d):
    """The cheapest search depth that finds each query's nearest vector."""
    b, index = _index(spark, d)
    return lab.depth_oracle(index, asked(b), _truth(b), [1, 2, 4, 8, 16], [0, 50], b.count())


def depth_gate(spark, d):
    """Whether search depth is worth predicting from the margin features."""
    b, index = _index(spark, d)
    n = b.count()
    found = lab.depth_oracle(index, asked(b), _truth(b), [1, 2, 4, 8, 16], [0, 50], n)
    return _round(lab.depth_gate(found, query_margin_features(spark, d), n * 8 / NLIST + 50 * 2.0 * DIM), "oracle_recall", "oracle_cost", "static_cost", "max_corr")


def reconstruction_recall(spark, d):
    """Share of queries whose nearest vector is among the r nearest reconstructions."""
    b, index = _index(spark, d)
    q = asked(b).withColumn("vec_id", -1 - F.col("vec_id"))
    found = knn.nearest(lab.reconstructed(index).withColumnRenamed("vec", "embedding"), q, 10)
    found = found.withColumn("qid", -1 - F.col("qid"))
    out = None
    for r in (1, 5, 10):
        part = knn.recall_metrics(found, _truth(b), r).select("r", "recall1_at_r")
        out = part if out is None else out.unionByName(part)
    return _round(out, "recall1_at_r")


def subspace_distortion(spark, d):
    """Mean squared error of the codes by subspace; the parts add up to the whole."""
    b, index = _index(spark, d)
    flat = lab.errors(index, b).select(F.posexplode("error").alias("pos", "x"))
    parts = flat.groupBy("pos").agg(F.avg(F.col("x") * F.col("x")).alias("s")).groupBy(F.floor(F.col("pos") / (DIM // M)).cast("int").alias("part")).agg(F.sum("s").alias("distortion"))
    return _round(parts, "distortion")


def coarse_rank_stats(spark, d):
    """Mean and 95th percentile of the true cell's rank, counted from 0."""
    b = base(spark, d)
    c = _coarse(b)
    ranks = diag.coarse_rank_of_truth(_probes(spark, b, c).select("qid", "cell", "probe_rank"), knn.nearest(b, asked(b), 1), quant.assign(b, c))
    return _round(diag.rank_stats(ranks), "mean_rank")


def residual_ratio(spark, d):
    """Residual variance with twice the cells against that with the index's cells, and the reduction the latter brings."""
    b = base(spark, d)
    fine = np.array([r[0] for r in b.filter(F.col("vec_id") < 2 * NLIST).orderBy("vec_id").select("embedding").collect()], float)
    near, far = quant.assign(b, fine), quant.assign(b, _coarse(b))
    mean = b.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.avg(F.pow(F.col("x").cast("double"), 2)).alias("s"))
    raw = mean.agg(F.sum(F.col("s") - F.col("m") * F.col("m")).alias("raw"))
    both = near.agg(F.avg("dist").alias("fine")).crossJoin(far.agg(F.avg("dist").alias("coarse"))).crossJoin(raw)  # one row each
    return _round(both.select("raw", "coarse", "fine", (1 - F.col("coarse") / F.col("raw")).alias("reduction"), (F.col("fine") / F.col("coarse")).alias("ratio")), "raw", "coarse", "fine", "reduction", "ratio")


def gap_sweep(spark, d):
    """Precision, recall and F1 of the gap cut, averaged over queries; relevant are hits of the query's own label."""
    b = base(spark, d)
    lab_ = b.select("vec_id", "label")
    near = materialize(knn.nearest(b, asked(b), 10), "near")
    out = None
    for gap in (1.0, 1.02, 1.05, 1.1):
        part = knn.gap_scores(near, lab_.toDF("id", "hl").join(near.select("id").distinct(), "id"), lab_.toDF("qid", "ql"), gap)
        out = part if out is None else out.unionByName(part)
    return _round(out, "precision", "recall", "f1")


def memory_accounting(spark, d):
    """Megabytes of the vectors and of their codes, and the ratio."""
    n = base(spark, d).agg(F.count("*").cast("double").alias("n"))
    return _round(n.select((F.col("n") * DIM * 4 / 1e6).alias("raw_mb"), (F.col("n") * M / 1e6).alias("codes_mb"), F.lit(DIM * 4.0 / M).alias("compression")), "raw_mb", "codes_mb")


_BAG, _STEPS, _ETAS = 40, 400, [0.0, 0.3, 0.9]


def _stream(spark, b):
    """Streams over the queries, numbered in order of id; the bag is Zipf-like by number."""
    items = spark.range(_BAG).select(F.col("id"), F.pow(F.col("id").cast("double") + 1, F.lit(-0.5)).alias("weight"))
    return lab.self_exciting(spark, _STEPS, _ETAS, lambda x: lab.drawn(items, x, "id"), _BAG)


def self_exciting_stream(spark, d):
    return _stream(spark, base(spark, d)).withColumn("eta", F.round("eta", 3))


def lift_calibration(spark, d):
    """Lift of the online predictor on generated streams, by their share of followed steps."""
    s = _stream(spark, base(spark, d)).select((F.col("eta") * 100).cast("int").alias("tenant"), "t", F.col("item").alias("item_id"))
    s = s.select("tenant", (F.col("tenant") * 1_000_000 + F.col("t")).alias("seq"), "item_id")  # sequence numbers are unique
    r = access.stream_lift(s)
    return _round(r.select(F.col("tenant").alias("eta_pct"), "markov_hit", "marginal_hit", "coverage", "lift"), "markov_hit", "marginal_hit", "coverage", "lift")


def predictive_allocation(spark, d):
    """Stream recall with second codes for popular, predicted and true items at equal budget."""
    b, q, far = _shortlist(spark, d)
    n_queries = q.count()
    stream = _stream(spark, b).withColumn("item", F.col("item") % n_queries * 50)
    out = lab.predictive_allocation(stream, far, _truth(b), [0.02, 0.1], b.count(), 3)
    return _round(out, "base", "static", "predicted", "oracle").withColumn("eta", F.round("eta", 3))


def snapped_grid(spark, d):
    """Every number from 0 to 70 on the nearest value of a grid, ties to the lower."""
    return spark.range(71).select(F.col("id").alias("value"), tune.snap(F.col("id"), [1, 4, 16, 32, 64]).cast("int").alias("snapped"))


def query_proxies(spark, d):
    n = base(spark, d).count()
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, (1, 4, 16)))).alias("nprobe")).select("nprobe", F.explode(F.array(*map(F.lit, (0, 50, 200)))).alias("rerank"))
    return grid.withColumn("cost", lab.query_proxy(F.col("nprobe"), F.col("rerank"), DIM, n, NLIST))


def feasible_fitness(spark, d):
    """Deb's rule on a grid of recalls and cost ratios."""
    grid = spark.range(11).select((F.col("id") / 10).alias("recall")).select("recall", F.explode(F.array(*(F.lit(x) for x in (0.5, 1.0, 1.3, 1.4, 2.6)))).alias("ratio"))
    return _round(grid.withColumn("fitness", tune.feasible_fitness("recall", "ratio", 1.3)), "fitness")


def float_distances(spark, d):
    """Squared distances in single precision."""
    b = base(spark, d)
    q = b.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return b.crossJoin(F.broadcast(q)).select("vec_id", F.round(vec.l2sq("q", "embedding").cast("float").cast("double"), 4).alias("dist"))  # one query


def content_hashes(spark, d):
    """FNV-1a of each vector's bytes."""
    return base(spark, d).select("vec_id", vec.fnv1a("embedding").alias("hash"))


def clusters_by_size(spark, d):
    """Cells by size, ties by number: a stable order."""
    b = base(spark, d)
    sizes = quant.assign(b, _coarse(b)).groupBy("cell").agg(F.count("*").alias("n"))
    return sizes.orderBy(F.desc("n"), "cell").select("cell", "n")


QUERIES = {
    f.__name__: f
    for f in (
        refinement_variants, depth_oracle, depth_gate, reconstruction_recall, subspace_distortion, coarse_rank_stats, residual_ratio, gap_sweep, memory_accounting, self_exciting_stream,
        lift_calibration, predictive_allocation, snapped_grid, query_proxies, feasible_fitness, float_distances, content_hashes, clusters_by_size,
    )
}

_RECON = _PQ + """,
dec AS (SELECT vec_id, flatten(list(w ORDER BY coded.m)) AS w FROM coded JOIN book ON book.m = coded.m AND book.k = coded.k GROUP BY vec_id),
rec AS (SELECT own.vec_id, own.v, list_transform(list_zip(own.c, dec.w), lambda z: z[1] + z[2]) AS y FROM own JOIN dec USING (vec_id)),
err AS (SELECT vec_id, v, y, list_transform(list_zip(v, y), lambda z: z[1] - z[2]) AS e FROM rec)"""
_REFINED = _RECON + f""",
ep AS (SELECT vec_id, m, e[m * 8 + 1:m * 8 + 8] AS p FROM err CROSS JOIN (SELECT unnest(range(8)) AS m)),
sb2 AS (SELECT m, vec_id AS k, p AS w FROM ep WHERE vec_id < 16),
sc2 AS (SELECT vec_id, m, w FROM (SELECT ep.vec_id, ep.m, k, w, {_dist("ep.p", "w")} AS dd FROM ep JOIN sb2 ON sb2.m = ep.m) QUALIFY row_number() OVER (PARTITION BY vec_id, m ORDER BY dd, k) = 1),
sd2 AS (SELECT vec_id, flatten(list(w ORDER BY m)) AS w2 FROM sc2 GROUP BY vec_id),
sl AS (SELECT qid, vec_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM adc WHERE probe_rank <= 4 QUALIFY rank <= 50),
rd AS (SELECT sl.qid, sl.vec_id, sl.dist AS adc, round({_dist("q.v", "err.y")}, 9) AS plain, round({_dist("q.v", "list_transform(list_zip(err.y, sd2.w2), lambda z: z[1] + z[2])")}, 9) AS refined, round({_dist("q.v", "err.v")}, 9) AS exact
  FROM sl JOIN q USING (qid) JOIN err ON err.vec_id = sl.vec_id JOIN sd2 ON sd2.vec_id = sl.vec_id)"""
_U = "CAST(CAST('0x' || substr(md5({s}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
_SX = f""", ww AS (SELECT i, sum(power(CAST(i + 1 AS DOUBLE), -0.5)) OVER (ORDER BY i) AS c FROM (SELECT unnest(range(40)) AS i)), tw AS (SELECT max(c) AS tot FROM ww),
st0 AS (SELECT eta, t, t = 0 OR {_U.format(s="'follow:1:' || t")} >= eta AS fresh FROM (SELECT unnest(range(400)) AS t), (SELECT unnest([0.0::DOUBLE, 0.3::DOUBLE, 0.9::DOUBLE]) AS eta)),
st1 AS (SELECT eta, t, max(CASE WHEN fresh THEN t END) OVER (PARTITION BY eta ORDER BY t) AS s FROM st0),
sx AS (SELECT eta, t, ((SELECT count(*) FROM ww WHERE c < {_U.format(s="'draw:1:' || st1.s")} * tot) + t - s) % 40 AS item FROM st1, tw)"""
_ORACLE = _PQ + _SELF + """, tn AS (SELECT qid, id AS vec_id FROM truth0 WHERE rank = 1),
np AS (SELECT unnest([1, 2, 4, 8, 16]) AS nprobe), rk AS (SELECT unnest([0, 50]) AS rerank),
pl AS (SELECT adc.qid, nprobe, adc.vec_id, row_number() OVER (PARTITION BY adc.qid, nprobe ORDER BY dist, adc.vec_id) AS rank FROM adc JOIN np ON probe_rank <= nprobe),
tr0 AS (SELECT tn.qid, np.nprobe, rerank, pl.rank FROM tn CROSS JOIN np CROSS JOIN rk LEFT JOIN pl ON pl.qid = tn.qid AND pl.vec_id = tn.vec_id AND pl.nprobe = np.nprobe AND pl.rank <= 50),
tr1 AS (SELECT qid, nprobe, rerank, coalesce(rank <= greatest(10, rerank), false) AS found, CAST((SELECT count(*) FROM e) * nprobe / 16 + rerank * 128.0 AS DOUBLE) AS cost FROM tr0),
od AS (SELECT qid, nprobe, rerank, cost, found FROM tr1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY found DESC, CASE WHEN found THEN cost ELSE -cost END, nprobe, rerank) = 1)"""

ORACLES = {
    "refinement_variants": _REFINED + _SELF + _W + """, tn AS (SELECT qid, id AS nn FROM truth0 WHERE rank = 1),
pp AS (SELECT id, round(sum(weight), 6) AS popularity FROM truth0 JOIN w USING (qid) WHERE rank <= 10 GROUP BY id),
hot AS (SELECT id FROM pp QUALIFY row_number() OVER (ORDER BY popularity DESC, id) <= round(0.2 * (SELECT count(*) FROM e))),
kd AS (SELECT qid, vec_id, unnest(['baseline', 'access_gated', 'random_gated', 'full', 'exact']) AS variant, unnest([round(adc, 9), CASE WHEN vec_id IN (SELECT id FROM hot) THEN refined ELSE plain END, CASE WHEN """
    + _U.format(s="CAST(vec_id AS VARCHAR)") + """ < 0.2 THEN refined ELSE plain END, refined, exact]) AS d FROM rd),
pl AS (SELECT qid, vec_id, variant, row_number() OVER (PARTITION BY qid, variant ORDER BY d, vec_id) AS place FROM kd),
ht AS (SELECT variant, place, unnest([1, 3, 10]) AS r FROM pl JOIN tn ON tn.qid = pl.qid AND tn.nn = pl.vec_id)
SELECT variant, CAST(r AS INTEGER) AS r, round(count(*) FILTER (place <= r) / (SELECT count(*) FROM tn), 6) AS recall FROM ht GROUP BY variant, r""",
    "depth_oracle": _ORACLE + " SELECT qid, CAST(nprobe AS INTEGER) AS nprobe, CAST(rerank AS INTEGER) AS rerank, cost, found FROM od",
    "depth_gate": _ORACLE + """, j AS (SELECT od.*, f0, f1, f2, f3 FROM od JOIN f USING (qid)),
g AS (SELECT round(avg(CASE WHEN found THEN 1.0::DOUBLE ELSE 0 END), 6) AS oracle_recall, avg(cost) AS oc, CAST((SELECT count(*) FROM e) * 8 / 16 + 50 * 128.0 AS DOUBLE) AS static_cost,
CASE WHEN var_pop(cost) > 0 THEN greatest(abs(corr(f0, cost)), abs(corr(f1, cost)), abs(corr(f2, cost)), abs(corr(f3, cost))) ELSE 0 END AS mc FROM j)
SELECT oracle_recall, round(oc, 6) AS oracle_cost, static_cost, round(coalesce(mc, 0), 6) AS max_corr, oc < 0.9 * static_cost AND coalesce(mc, 0) > 0.2 AS passes FROM g""",
    "reconstruction_recall": _RECON + _SELF + """, rr AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY """ + _dist("q.v", "rec.y") + """, vec_id) AS rank FROM q CROSS JOIN rec)
SELECT CAST(r AS INTEGER) AS r, round(avg(CASE WHEN rr.rank <= r THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall1_at_r FROM truth0 t JOIN rr ON rr.qid = t.qid AND rr.vec_id = t.id CROSS JOIN (SELECT unnest([1, 5, 10]) AS r) WHERE t.rank = 1 GROUP BY r""",
    "subspace_distortion": _RECON + """, x AS (SELECT unnest(range(64)) AS pos, unnest(e) AS x FROM err), y AS (SELECT pos, avg(x * x) AS s FROM x GROUP BY pos)
SELECT CAST(pos // 8 AS INTEGER) AS part, round(sum(s), 6) AS distortion FROM y GROUP BY pos // 8""",
    "coarse_rank_stats": _RANKS + """, o AS (SELECT r - 1 AS r, row_number() OVER (ORDER BY r) - 1 AS i, count(*) OVER () AS n FROM tr)
SELECT round(avg(r), 6) AS mean_rank, CAST(max(r) FILTER (i = n * 95 // 100) AS INTEGER) AS p95_rank FROM o""",
    "residual_ratio": _COARSE + f""", cf AS (SELECT vec_id AS cell, v AS c FROM e WHERE vec_id < 32), nf AS (SELECT e.vec_id, min({_dist("e.v", "cf.c")}) AS d FROM e CROSS JOIN cf GROUP BY e.vec_id),
x AS (SELECT unnest(range(64)) AS pos, unnest(v) AS x FROM e), y AS (SELECT pos, avg(x) AS m, avg(x * x) AS s FROM x GROUP BY pos),
z AS (SELECT (SELECT sum(s - m * m) FROM y) AS raw, (SELECT avg(dist) FROM own) AS coarse, (SELECT avg(d) FROM nf) AS fine)
SELECT round(raw, 6) AS raw, round(coarse, 6) AS coarse, round(fine, 6) AS fine, round(1 - coarse / raw, 6) AS reduction, round(fine / coarse, 6) AS ratio FROM z""",
    "gap_sweep": _TOP + """, tt AS (SELECT t.qid, t.id, t.rank, t.dist, a.label = b.label AS good FROM truth t JOIN e a ON a.vec_id = t.qid JOIN e b ON b.vec_id = t.id WHERE t.rank <= 10),
gp AS (SELECT unnest([1.0::DOUBLE, 1.02::DOUBLE, 1.05::DOUBLE, 1.1::DOUBLE]) AS gap),
ct AS (SELECT gap, tt.*, CASE WHEN gap > 1 AND dist > lag(dist) OVER (PARTITION BY gap, qid ORDER BY rank) * gap THEN 1 ELSE 0 END AS cut FROM tt CROSS JOIN gp),
kp AS (SELECT *, max(cut) OVER (PARTITION BY gap, qid ORDER BY rank) = 0 AS kept FROM ct),
pq AS (SELECT gap, qid, count(*) FILTER (kept) AS n, count(*) FILTER (kept AND good) AS g, count(*) FILTER (good) AS a FROM kp GROUP BY gap, qid),
pr AS (SELECT gap, g / n AS p, CASE WHEN a > 0 THEN g / a ELSE 0 END AS r FROM pq)
SELECT gap, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM pr GROUP BY gap""",
    "memory_accounting": "SELECT round(count(*) * 64 * 4 / 1e6, 6) AS raw_mb, round(count(*) * 8 / 1e6, 6) AS codes_mb, 32.0::DOUBLE AS compression FROM embeddings",
    "self_exciting_stream": "WITH z AS (SELECT 1)" + _SX + " SELECT round(eta, 3) AS eta, t, item FROM sx",
    "lift_calibration": "WITH z AS (SELECT 1)" + _SX + """, s AS (SELECT CAST(eta * 100 AS INTEGER) AS tenant, t AS seq, item, lag(item) OVER (PARTITION BY eta ORDER BY t) AS prev FROM sx), mv AS (SELECT * FROM s WHERE prev IS NOT NULL),
mk AS (SELECT b.tenant, b.seq, b.item, a.item AS guess, count(*) AS n FROM mv b JOIN mv a ON a.tenant = b.tenant AND a.prev = b.prev AND a.seq < b.seq GROUP BY ALL),
mb AS (SELECT * FROM mk QUALIFY row_number() OVER (PARTITION BY tenant, seq ORDER BY n DESC, guess) = 1),
pk AS (SELECT b.tenant, b.seq, b.item, a.item AS guess, count(*) AS n FROM mv b JOIN mv a ON a.tenant = b.tenant AND a.seq < b.seq GROUP BY ALL),
pb AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY tenant, seq ORDER BY n DESC, guess) = 1),
mh AS (SELECT tenant, count(*) AS predictable, count(*) FILTER (item = guess) AS hits FROM mb GROUP BY tenant), ph AS (SELECT tenant, count(*) FILTER (item = guess) AS plain FROM pb GROUP BY tenant)
SELECT tenant AS eta_pct, round(hits / predictable, 6) AS markov_hit, round(plain / 399, 6) AS marginal_hit, round(predictable / 399, 6) AS coverage, round(hits / predictable - plain / 399, 6) AS lift FROM mh JOIN ph USING (tenant)""",
    "predictive_allocation": _REFINED + _SELF + _SX + """, nq AS (SELECT count(*) AS n FROM q), tn AS (SELECT qid, id AS nn FROM truth0 WHERE rank = 1),
sq AS (SELECT eta, t, item % (SELECT n FROM nq) * 50 AS qid FROM sx), ss AS (SELECT eta, t, sq.qid, nn, lag(nn) OVER (PARTITION BY eta ORDER BY t) AS prev FROM sq JOIN tn USING (qid)),
mk AS (SELECT b.eta, b.t, a.nn AS guess, count(*) AS n FROM ss b JOIN ss a ON a.eta = b.eta AND a.prev = b.prev AND a.t < b.t GROUP BY ALL), gs AS (SELECT * FROM mk QUALIFY row_number() OVER (PARTITION BY eta, t ORDER BY n DESC, guess) = 1),
sg AS (SELECT ss.eta, ss.t, qid, nn, guess FROM ss LEFT JOIN gs ON gs.eta = ss.eta AND gs.t = ss.t),
po AS (SELECT eta, id, count(*) AS pop FROM ss JOIN truth0 USING (qid) WHERE rank <= 10 GROUP BY eta, id), pp AS (SELECT eta, id, row_number() OVER (PARTITION BY eta ORDER BY pop DESC, id) - 1 AS place FROM po),
fr AS (SELECT f AS fraction, CAST(floor(f * (SELECT count(*) FROM e) + 0.5) AS INTEGER) AS m FROM (SELECT unnest([0.02::DOUBLE, 0.1::DOUBLE]) AS f)),
rw AS (SELECT sg.eta, sg.t, fraction, m, nn, guess, rd.vec_id, plain, refined, coalesce(place, 1000000000) AS place FROM sg CROSS JOIN fr JOIN rd USING (qid) LEFT JOIN pp ON pp.eta = sg.eta AND pp.id = rd.vec_id),
rn AS (SELECT eta, fraction, t, vec_id, nn, row_number() OVER (PARTITION BY eta, fraction, t ORDER BY plain, vec_id) AS b,
row_number() OVER (PARTITION BY eta, fraction, t ORDER BY CASE WHEN place < m THEN refined ELSE plain END, vec_id) AS s,
row_number() OVER (PARTITION BY eta, fraction, t ORDER BY CASE WHEN coalesce(vec_id = guess, false) OR place < m - CASE WHEN guess IS NULL THEN 0 ELSE 1 END THEN refined ELSE plain END, vec_id) AS p,
row_number() OVER (PARTITION BY eta, fraction, t ORDER BY CASE WHEN vec_id = nn OR place < m - 1 THEN refined ELSE plain END, vec_id) AS o FROM rw)
SELECT round(eta, 3) AS eta, fraction, round(count(*) FILTER (b <= 3) / 400, 6) AS base, round(count(*) FILTER (s <= 3) / 400, 6) AS static, round(count(*) FILTER (p <= 3) / 400, 6) AS predicted, round(count(*) FILTER (o <= 3) / 400, 6) AS oracle
FROM rn WHERE vec_id = nn GROUP BY eta, fraction""",
    "snapped_grid": "SELECT value, CAST(arg_min(g, abs(value - g) * 100 + g / 100) AS INTEGER) AS snapped FROM (SELECT unnest(range(71)) AS value), (SELECT unnest([1, 4, 16, 32, 64]) AS g) GROUP BY value",
    "query_proxies": "SELECT nprobe, rerank, CAST((SELECT count(*) FROM embeddings) * nprobe / 16 + rerank * 128.0 AS DOUBLE) AS cost FROM (SELECT CAST(unnest([1, 4, 16]) AS INTEGER) AS nprobe), (SELECT CAST(unnest([0, 50, 200]) AS INTEGER) AS rerank)",
    "feasible_fitness": "SELECT recall, ratio, round(CASE WHEN ratio <= 1.3::DOUBLE THEN recall ELSE -(ratio / 1.3::DOUBLE - 1) END, 6) AS fitness FROM (SELECT unnest(range(11)) / 10 AS recall), (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 1.3::DOUBLE, 1.4::DOUBLE, 2.6::DOUBLE]) AS ratio)",
    "float_distances": _E + " SELECT vec_id, round(CAST(CAST(" + _dist("(SELECT v FROM e WHERE vec_id = 0)", "v") + " AS FLOAT) AS DOUBLE), 4) AS dist FROM e",
    "clusters_by_size": _COARSE + " SELECT cell, count(*) AS n FROM own GROUP BY cell",
}
