"""Registered queries over vectors: exact and approximate search, metrics, diagnostics.

Queries are the vectors whose id 50 divides, against all vectors. The approximate queries
use models that SQL can rebuild: centroids and codebooks start from the first vectors and
take Lloyd steps over all rows, rounded after each step.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.functions import vec
from engrava.operators import diag, knn, quant, tune
from engrava.operators.access import hot_set, popularity, zipf_weights
from engrava.operators.galaxy import galaxy, heat, modal_labels
from engrava.operators.ivf import IvfConfig, IvfIndex
from engrava.session import delete_at_exit, shared_dir, table

DIM, NLIST, M, K, STEPS = 64, 16, 8, 16, 2
NPROBE, TOP = 4, 10


def base(spark, d):
    return table(spark, d, "embeddings")


def asked(df):
    return df.filter("vec_id % 50 = 0")


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def exact_knn(spark, d):
    b = base(spark, d)
    return _round(knn.nearest(b, asked(b), TOP), "dist")


def knn_tenant_scoped(spark, d):
    b = base(spark, d)
    return _round(knn.nearest(b, asked(b), 5, group_col="label"), "dist")


def recall_gap_cut(spark, d):
    b = base(spark, d)
    return _round(knn.gap_cut(knn.nearest(b, asked(b), TOP, group_col="label"), 1.05), "dist")


def dedup_nearest(spark, d):
    b = base(spark, d)
    return _round(knn.duplicates_of(knn.nearest(b, asked(b), 1, group_col="label"), 1.2), "dist")


def exact_duplicates_by_content(spark, d):
    """Memories whose vector another memory with a smaller id already holds."""
    rows = table(spark, d, "memories").filter("mem_id is not null and vec is not null").select("mem_id", F.to_json("vec").alias("content"))
    first = rows.groupBy("content").agg(F.min("mem_id").alias("prior"))
    return rows.distinct().join(first, "content").filter("mem_id <> prior").select("mem_id", "prior").distinct()


def l2_normalize(spark, d):
    unit = base(spark, d).select("vec_id", vec.normalize(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("u"))
    return unit.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(vec.norm("u"), 6).alias("length"))


def _coarse(b, steps=STEPS):
    first = b.filter(F.col("vec_id") < NLIST).orderBy("vec_id").select("embedding").collect()
    return quant.lloyd_distributed(b, np.array([r[0] for r in first], float), steps)


def coarse_assign(spark, d):
    b = base(spark, d)
    return _round(quant.assign(b, _coarse(b)), "dist")


def kmeans_iter(spark, d):
    c = _coarse(base(spark, d))
    rows = [(i, p, float(c[i, p])) for i in range(NLIST) for p in range(DIM)]
    return _round(spark.createDataFrame(rows, "cell int, pos int, value double"), "value")


def cell_histogram(spark, d):
    b = base(spark, d)
    return quant.assign(b, _coarse(b)).groupBy("cell").agg(F.count("*").alias("n"))


def _probes(spark, b, c):
    """(qid, cell, probe_rank, dist) of all cells of each query."""
    cells = spark.createDataFrame([(i, c[i].tolist()) for i in range(len(c))], "cell int, centroid array<double>")
    pairs = asked(b).select(F.col("vec_id").alias("qid"), "embedding").crossJoin(F.broadcast(cells))  # NLIST rows, fixed
    far = pairs.select("qid", "cell", vec.l2sq("embedding", "centroid").alias("dist"))
    return far.withColumn("probe_rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "cell")))


def probe_cells(spark, d):
    b = base(spark, d)
    return _round(_probes(spark, b, _coarse(b)).filter(F.col("probe_rank") <= NPROBE), "dist").select("qid", "cell", "probe_rank", "dist")


def query_margin_features(spark, d):
    b = base(spark, d)
    far = _probes(spark, b, _coarse(b)).groupBy("qid").agg(F.collect_list("dist").alias("ds"))
    return _round(far.select("qid", vec.margin_features("ds").alias("f")).select("qid", "f.*"), "f0", "f1", "f2", "f3")


def _residuals(spark, b, c):
    cells = spark.createDataFrame([(i, c[i].tolist()) for i in range(len(c))], "cell int, centroid array<double>")
    own = quant.assign(b, c).select("vec_id", "cell")
    return b.join(own, "vec_id").join(F.broadcast(cells), "cell").select("vec_id", "cell", "embedding", vec.residual("embedding", "centroid").alias("residual"))


def residual_variance(spark, d):
    b = base(spark, d)
    r = _residuals(spark, b, _coarse(b))
    return _round(r.agg(F.avg(vec.total(F.transform("residual", lambda x: x * x))).alias("residual"), F.avg(vec.total(F.transform("embedding", lambda x: x.cast("double") * x))).alias("raw")), "residual", "raw")


def _books(spark, b, c):
    """Codebooks whose entries are the residual parts of the first vectors, after one Lloyd step over all rows."""
    r = _residuals(spark, b, c).select("vec_id", "residual")
    first = r.filter(F.col("vec_id") < K).orderBy("vec_id").select("residual").collect()
    start = np.array([x[0] for x in first], float).reshape(len(first), M, DIM // M)
    return quant.lloyd_parts(r, quant.Codebooks(start.transpose(1, 0, 2)), 1)


_built: dict[tuple[str, str], IvfIndex] = {}


def _index(spark, d):
    """The index over a table, built once per session: models kept, entries stored by cell in the shared folder."""
    key = spark.sparkContext.applicationId, d
    b = base(spark, d)
    if key not in _built:
        c = _coarse(b)
        index = IvfIndex(IvfConfig(DIM, NLIST, M, K), c, _books(spark, b, c))
        index.add(b)
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        delete_at_exit(spark, path)
        index.save(path)
        _built[key] = IvfIndex.load(spark, path)
    return b, _built[key]


def pq_encode(spark, d):
    _, index = _index(spark, d)
    return index.entries.select("vec_id", "cell", F.array_join(F.transform("code", lambda x: x.cast("string")), ",").alias("code"))


def hamming_tolerance(spark, d):
    """Pairs of a query and an entry of its cell whose codes differ in at most six parts."""
    _, index = _index(spark, d)
    q = index.entries.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "cell", F.col("code").alias("qcode"))
    near = index.entries.join(q, "cell").withColumn("hamming", vec.hamming("code", "qcode"))
    return near.filter("hamming <= 6 and vec_id <> qid").select("qid", "vec_id", "hamming")


def _hits(df):
    return _round(df.select("qid", "rank", "vec_id", "dist"), "dist")


def adc_scan_topk(spark, d):
    b, index = _index(spark, d)
    return _hits(index.search(asked(b), NLIST, TOP))


def ivf_search(spark, d):
    b, index = _index(spark, d)
    return _hits(index.search(asked(b), NPROBE, TOP))


def ivf_rerank(spark, d):
    b, index = _index(spark, d)
    q = asked(b)
    return _hits(index.rerank(index.search(q, NPROBE, 50), q, b, TOP, 50))


def ivf_tiered(spark, d):
    b, index = _index(spark, d)
    return _hits(index.tiered(asked(b), b.filter("vec_id % 40 = 7"), NPROBE, TOP))


def ivf_recall_tol(spark, d):
    b, index = _index(spark, d)
    return _round(index.recall(asked(b), 8), "dist")


def ivf_policy_search(spark, d):
    """Queries with a small margin between their nearest cells probe more of them."""
    b, index = _index(spark, d)
    margins = query_margin_features(spark, d).select(F.col("qid").alias("vec_id"), F.when(F.col("f2") < 0.05, 8).otherwise(2).alias("depth"))
    return _hits(index.search(asked(b).join(margins, "vec_id"), NPROBE, TOP, depth_col="depth"))


def scan_fraction(spark, d):
    b = base(spark, d)
    c = _coarse(b)
    sizes = quant.assign(b, c).groupBy("cell").agg(F.count("*").alias("n"))
    probed = _probes(spark, b, c).filter(F.col("probe_rank") <= NPROBE).join(sizes, "cell").groupBy("qid").agg(F.sum("n").alias("scanned"))
    return _round(probed.crossJoin(sizes.agg(F.sum("n").alias("total"))).agg(F.avg(F.col("scanned") / F.col("total")).alias("fraction")), "fraction")


def _truth(b, k=TOP):
    return knn.nearest(b, asked(b).withColumn("vec_id", -1 - F.col("vec_id")), k).withColumn("qid", -1 - F.col("qid"))


def recall_at_r(spark, d):
    b, index = _index(spark, d)
    found = index.search(asked(b), NPROBE, TOP).select("qid", "rank", F.col("vec_id").alias("id"))
    return _round(knn.recall_metrics(found, _truth(b), TOP), "recall1_at_r", "inter_at_r")


def inter_at_r(spark, d):
    b, index = _index(spark, d)
    q = asked(b)
    found = index.rerank(index.search(q, NPROBE, 50), q, b, TOP, 50).select("qid", "rank", F.col("vec_id").alias("id"))
    return _round(knn.recall_metrics(found, _truth(b), 5), "recall1_at_r", "inter_at_r")


def _weights(b):
    return zipf_weights(asked(b), 1.0, "vec_id").select(F.col("vec_id").alias("qid"), "weight")


def zipf_weight_table(spark, d):
    return _round(_weights(base(spark, d)), "weight")


def weighted_recall(spark, d):
    b, index = _index(spark, d)
    found = index.search(asked(b), NPROBE, TOP).select("qid", F.col("vec_id").alias("id"), F.lit(1).alias("h"))
    first = _truth(b).filter("rank = 1").join(found, ["qid", "id"], "left").select("qid", F.coalesce("h", F.lit(0)).alias("hit"))
    return _round(knn.weighted_recall(first.join(_weights(b), "qid")), "weighted_recall", "ess")


def item_popularity(spark, d):
    b = base(spark, d)
    return _round(popularity(knn.nearest(b, asked(b), TOP), _weights(b), TOP), "popularity")


def hot_items(spark, d):
    b = base(spark, d)
    n = b.count()
    scores = popularity(knn.nearest(b, asked(b), TOP), _weights(b), TOP).withColumn("popularity", F.round("popularity", 6))
    return hot_set(scores, 0.02, n)


def oracle_cell_recall(spark, d):
    """Share of queries whose true nearest vector lies in the nearest cell, and in a probed one."""
    b = base(spark, d)
    c = _coarse(b)
    ranks = diag.coarse_rank_of_truth(_probes(spark, b, c).select("qid", "cell", "probe_rank"), knn.nearest(b, asked(b), 1), quant.assign(b, c))
    return _round(ranks.agg(F.avg((F.col("true_cell_rank") == 1).cast("double")).alias("own_cell"), F.avg((F.col("true_cell_rank") <= NPROBE).cast("double")).alias("probed")), "own_cell", "probed")


def coarse_miss(spark, d):
    b = base(spark, d)
    c = _coarse(b)
    ranks = diag.coarse_rank_of_truth(_probes(spark, b, c).select("qid", "cell", "probe_rank"), knn.nearest(b, asked(b), 1), quant.assign(b, c))
    return _round(diag.coarse_miss(ranks, [1, 2, 4, 8]), "miss_rate")


def subspace_variance(spark, d):
    b = base(spark, d)
    return _round(diag.subspace_variance(_residuals(spark, b, _coarse(b)), M, DIM), "variance")


def parallel_error_split(spark, d):
    b = base(spark, d)
    r = _residuals(spark, b, _coarse(b)).select(F.col("embedding").cast("array<double>").alias("vec"), F.col("residual").alias("error"))
    return _round(diag.parallel_split(r), "parallel", "orthogonal", "rho")


def distortion_deciles(spark, d):
    """Coarse misses by tenth of the query's distance to its nearest cell."""
    b = base(spark, d)
    c = _coarse(b)
    probes = _probes(spark, b, c)
    ranks = diag.coarse_rank_of_truth(probes.select("qid", "cell", "probe_rank"), knn.nearest(b, asked(b), 1), quant.assign(b, c))
    rows = ranks.join(probes.filter("probe_rank = 1").select("qid", F.round("dist", 9).alias("dist")), "qid")
    return _round(diag.decile_miss(rows.withColumn("miss", (F.col("true_cell_rank") > 1).cast("int")), ["dist", "qid"], "miss"), "miss_rate")


def pearson_features(spark, d):
    f = query_margin_features(spark, d)
    return _round(diag.pearson(f, "f0", "f1"), "pearson")


def tau_probe(spark, d):
    """Extrema of distances between the queries and all other vectors, within and across labels."""
    b = base(spark, d).select("vec_id", "embedding", "label")
    return _round(diag.tau_probe(b, asked(b), "vec_id", "embedding", "label", DIM), "max_within", "min_across", "tau")


_GRID = {"nlist": [32, 64], "m": [48, 96], "k": [64, 256], "nprobe": [8, 16, 32], "rerank": [0, 50, 200]}


def cost_proxy(spark, d):
    """Operation counts of a grid of configurations, and whether each is within 1.3 times the preset's."""
    n = base(spark, d).agg(F.count("*").cast("double").alias("n"))
    grid = n
    for name, values in _GRID.items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    cost = tune.cost_proxy(768, "nlist", "m", "k", "nprobe", "rerank", "n")
    preset = tune.cost_proxy(768, 64, 96, 64, 32, 200, "n")
    return grid.select(*_GRID, cost.alias("cost"), F.round(cost / preset, 6).alias("ratio"), (cost <= preset * 1.3).alias("feasible"))


def galaxy_clusters(spark, d):
    b = base(spark, d)
    points = galaxy(b)
    tags = b.select("vec_id", F.concat(F.lit("label-"), F.col("label").cast("string")).alias("tag"))
    return modal_labels(points, tags)


def heat_by_order(spark, d):
    return _round(heat(base(spark, d).select("vec_id", "label"), "vec_id", "label"), "heat")


QUERIES = {
    f.__name__: f
    for f in (
        exact_knn, knn_tenant_scoped, recall_gap_cut, dedup_nearest, exact_duplicates_by_content, l2_normalize, coarse_assign, kmeans_iter, cell_histogram,
        probe_cells, query_margin_features, residual_variance, pq_encode, hamming_tolerance, adc_scan_topk, ivf_search, ivf_rerank, ivf_tiered, ivf_recall_tol,
        ivf_policy_search, scan_fraction, recall_at_r, inter_at_r, zipf_weight_table, weighted_recall, item_popularity, hot_items, oracle_cell_recall, coarse_miss,
        subspace_variance, parallel_error_split, distortion_deciles, pearson_features, tau_probe, cost_proxy, galaxy_clusters, heat_by_order,
    )
}

# ---- the same in SQL -------------------------------------------------------------------

_D = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _dist(a, b):
    return _D.format(a=a, b=b)


_E = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT vec_id AS qid, v, label FROM e WHERE vec_id % 50 = 0),
near AS (SELECT qid, vec_id AS id, q.label AS ql, e.label AS el, """ + _dist("q.v", "e.v") + """ AS dist FROM q JOIN e ON vec_id <> qid)"""
_TOP = _E + """, truth AS (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM near),
scoped AS (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM near WHERE ql = el)"""

_LLOYD = ", c0 AS (SELECT CAST(vec_id AS INTEGER) AS cell, v AS c FROM e WHERE vec_id < 16)"
for _i in range(STEPS):
    _LLOYD += f""",
a{_i} AS (SELECT vec_id, v, arg_min(cell, dist) AS cell FROM (SELECT vec_id, v, cell, {_dist("v", "c")} AS dist FROM e CROSS JOIN c{_i} ORDER BY vec_id, dist, cell) GROUP BY vec_id, v),
m{_i} AS (SELECT cell, pos, round(avg(x), 9) AS x FROM (SELECT cell, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM a{_i}) GROUP BY cell, pos),
c{_i + 1} AS (SELECT c{_i}.cell, coalesce(n.c, c{_i}.c) AS c FROM c{_i} LEFT JOIN (SELECT cell, list(x ORDER BY pos) AS c FROM m{_i} GROUP BY cell) n USING (cell))"""
_COARSE = _TOP + _LLOYD + f""",
far AS (SELECT vec_id, v, cell, c, {_dist("v", "c")} AS dist FROM e CROSS JOIN c{STEPS}),
own AS (SELECT vec_id, v, cell, c, dist FROM far QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cell) = 1),
probes AS (SELECT vec_id AS qid, v, cell, c, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cell) AS probe_rank FROM far WHERE vec_id % 50 = 0),
res AS (SELECT vec_id, cell, v, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS r FROM own)"""
_FEATURES = _COARSE + """,
ds AS (SELECT qid, list(dist ORDER BY dist) AS d FROM probes GROUP BY qid),
f AS (SELECT qid, round(d[1], 6) AS f0, round(d[2] / (d[1] + 1e-9), 6) AS f1, round(d[2] - d[1], 6) AS f2, round(list_sum(d[1:8]) / 8 / (d[1] + 1e-9), 6) AS f3 FROM ds)"""
_PQ = _FEATURES + f""",
parts AS (SELECT vec_id, cell, m, r[m * 8 + 1:m * 8 + 8] AS p FROM res CROSS JOIN (SELECT unnest(range(8)) AS m)),
b0 AS (SELECT m, CAST(vec_id AS INTEGER) AS k, p AS w FROM parts WHERE vec_id < 16),
pa AS (SELECT parts.vec_id, parts.m, parts.p, arg_min(k, dd) AS k FROM (SELECT parts.vec_id, parts.m, parts.p, k, {_dist("parts.p", "w")} AS dd FROM parts JOIN b0 USING (m) ORDER BY vec_id, m, dd, k) parts GROUP BY ALL),
bm AS (SELECT m, k, pos, round(avg(x), 9) AS x FROM (SELECT m, k, unnest(range(8)) AS pos, unnest(p) AS x FROM pa) GROUP BY ALL),
book AS (SELECT b0.m, b0.k, coalesce(n.w, b0.w) AS w FROM b0 LEFT JOIN (SELECT m, k, list(x ORDER BY pos) AS w FROM bm GROUP BY m, k) n ON n.m = b0.m AND n.k = b0.k),
coded AS (SELECT vec_id, cell, m, k FROM (SELECT vec_id, cell, parts.m, k, {_dist("p", "w")} AS dd FROM parts JOIN book ON book.m = parts.m) QUALIFY row_number() OVER (PARTITION BY vec_id, m ORDER BY dd, k) = 1),
codes AS (SELECT vec_id, cell, list(k ORDER BY m) AS code FROM coded GROUP BY vec_id, cell),
qres AS (SELECT qid, cell, probe_rank, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS r FROM probes),
tables AS (SELECT qid, cell, book.m, k, {_dist("r[book.m * 8 + 1:book.m * 8 + 8]", "w")} AS t FROM qres CROSS JOIN book),
adc AS (SELECT qid, vec_id, probe_rank, sum(t) AS dist FROM coded JOIN tables USING (cell, m, k) JOIN qres USING (qid, cell) GROUP BY qid, vec_id, probe_rank)"""


def _search(where, k, extra=""):
    return _PQ + f""", hits AS (SELECT qid, vec_id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS INTEGER) AS rank FROM adc {extra} WHERE {where} QUALIFY rank <= {k})"""


_HITS = " SELECT qid, rank, vec_id, round(dist, 6) AS dist FROM hits"
_SELF = """, truth0 AS (SELECT qid, vec_id AS id, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM (SELECT qid, vec_id, """ + _dist("q.v", "e.v") + """ AS d FROM q CROSS JOIN e))"""
_RERANK = _search("probe_rank <= 4", 50) + """, again AS (SELECT qid, vec_id, """ + _dist("q.v", "e.v") + """ AS dist FROM hits JOIN q USING (qid) JOIN e USING (vec_id)),
top AS (SELECT qid, vec_id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS INTEGER) AS rank FROM again QUALIFY rank <= 10)"""
_W = """, w AS (SELECT qid, power(CAST(row_number() OVER (ORDER BY md5(CAST(qid AS VARCHAR)), qid) AS DOUBLE), -1.0) AS weight FROM q)"""
_RANKS = _COARSE + """, tr AS (SELECT truth.qid, probes.probe_rank AS r FROM truth JOIN own ON own.vec_id = truth.id JOIN probes ON probes.qid = truth.qid AND probes.cell = own.cell WHERE truth.rank = 1)"""

ORACLES = {
    "exact_knn": _TOP + " SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM truth WHERE rank <= 10",
    "knn_tenant_scoped": _TOP + " SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM scoped WHERE rank <= 5",
    "recall_gap_cut": _TOP + """, g AS (SELECT *, CASE WHEN dist > lag(dist) OVER (PARTITION BY qid ORDER BY rank) * 1.05 THEN 1 ELSE 0 END AS cut FROM scoped WHERE rank <= 10)
SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM g QUALIFY max(cut) OVER (PARTITION BY qid ORDER BY rank) = 0""",
    "dedup_nearest": _TOP + " SELECT qid, id AS nearest, round(dist, 6) AS dist, dist < 1.2 AS is_duplicate FROM scoped WHERE rank = 1",
    "exact_duplicates_by_content": """WITH r AS (SELECT DISTINCT mem_id, CAST(vec AS VARCHAR) AS c FROM memories WHERE mem_id IS NOT NULL AND vec IS NOT NULL)
SELECT DISTINCT mem_id, prior FROM (SELECT mem_id, min(mem_id) OVER (PARTITION BY c) AS prior FROM r) WHERE mem_id <> prior""",
    "l2_normalize": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)
SELECT vec_id, round(v[1] / n, 6) AS first, round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) AS length FROM n""",
    "coarse_assign": _COARSE + " SELECT vec_id, cell, round(dist, 6) AS dist FROM own",
    "kmeans_iter": _COARSE + f" SELECT cell, CAST(unnest(range(64)) AS INTEGER) AS pos, round(unnest(c), 6) AS value FROM c{STEPS}",
    "cell_histogram": _COARSE + " SELECT cell, count(*) AS n FROM own GROUP BY cell",
    "probe_cells": _COARSE + " SELECT qid, cell, CAST(probe_rank AS INTEGER) AS probe_rank, round(dist, 6) AS dist FROM probes WHERE probe_rank <= 4",
    "query_margin_features": _FEATURES + " SELECT * FROM f",
    "residual_variance": _COARSE + " SELECT round(avg(list_sum(list_transform(r, lambda x: x * x))), 6) AS residual, round(avg(list_sum(list_transform(v, lambda x: x * x))), 6) AS raw FROM res",
    "pq_encode": _PQ + " SELECT vec_id, cell, array_to_string(code, ',') AS code FROM codes",
    "hamming_tolerance": _PQ + """ SELECT q.vec_id AS qid, c.vec_id, CAST(list_sum(list_transform(list_zip(q.code, c.code), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS hamming
FROM codes q JOIN codes c ON q.cell = c.cell AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 AND hamming <= 6""",
    "adc_scan_topk": _search("probe_rank <= 16", 10) + _HITS,
    "ivf_search": _search("probe_rank <= 4", 10) + _HITS,
    "ivf_rerank": _RERANK + " SELECT qid, rank, vec_id, round(dist, 6) AS dist FROM top",
    "ivf_tiered": _PQ + ", both_ AS (SELECT qid, vec_id, dist FROM adc WHERE probe_rank <= 4 AND vec_id % 40 <> 7 UNION ALL SELECT qid, vec_id, " + _dist("q.v", "e.v") + """ FROM q CROSS JOIN e WHERE vec_id % 40 = 7)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS INTEGER) AS rank, vec_id, round(dist, 6) AS dist FROM both_ QUALIFY rank <= 10""",
    "ivf_recall_tol": _PQ + """, h AS (SELECT q.vec_id AS qid, c.vec_id, CAST(list_sum(list_transform(list_zip(q.code, c.code), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS hamming
FROM codes q JOIN codes c USING (cell) WHERE q.vec_id % 50 = 0)
SELECT qid, vec_id, hamming, round(dist, 6) AS dist FROM h JOIN adc USING (qid, vec_id) WHERE hamming <= 8 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) = 1""",
    "ivf_policy_search": _search("probe_rank <= CASE WHEN f2 < 0.05 THEN 8 ELSE 2 END", 10, "JOIN f USING (qid)") + _HITS,
    "scan_fraction": _COARSE + """, n AS (SELECT cell, count(*) AS n FROM own GROUP BY cell)
SELECT round(avg(s / (SELECT sum(n) FROM n)), 6) AS fraction FROM (SELECT qid, sum(n) AS s FROM probes JOIN n USING (cell) WHERE probe_rank <= 4 GROUP BY qid)""",
    "recall_at_r": _search("probe_rank <= 4", 10) + _SELF + """ SELECT 10 AS r, round(sum(CASE WHEN t.rank = 1 AND h.vec_id IS NOT NULL THEN 1 ELSE 0 END) / count(DISTINCT t.qid), 6) AS recall1_at_r,
round(count(h.vec_id) / (count(DISTINCT t.qid) * 10), 6) AS inter_at_r FROM truth0 t LEFT JOIN hits h ON h.qid = t.qid AND h.vec_id = t.id WHERE t.rank <= 10""",
    "inter_at_r": _RERANK + _SELF + """ SELECT 5 AS r, round(sum(CASE WHEN t.rank = 1 AND h.vec_id IS NOT NULL THEN 1 ELSE 0 END) / count(DISTINCT t.qid), 6) AS recall1_at_r,
round(count(h.vec_id) / (count(DISTINCT t.qid) * 5), 6) AS inter_at_r FROM truth0 t LEFT JOIN (SELECT * FROM top WHERE rank <= 5) h ON h.qid = t.qid AND h.vec_id = t.id WHERE t.rank <= 5""",
    "zipf_weight_table": _E + _W + " SELECT qid, round(weight, 6) AS weight FROM w",
    "weighted_recall": _search("probe_rank <= 4", 10) + _SELF + _W + """ SELECT round(sum(weight * hit) / sum(weight), 6) AS weighted_recall, round(power(sum(weight), 2) / sum(weight * weight), 6) AS ess
FROM (SELECT weight, CASE WHEN h.vec_id IS NULL THEN 0 ELSE 1 END AS hit FROM truth0 t JOIN w USING (qid) LEFT JOIN hits h ON h.qid = t.qid AND h.vec_id = t.id WHERE t.rank = 1)""",
    "item_popularity": _TOP + _W + " SELECT id, round(sum(weight), 6) AS popularity FROM truth JOIN w USING (qid) WHERE rank <= 10 GROUP BY id",
    "hot_items": _TOP + _W + """, p AS (SELECT id, round(sum(weight), 6) AS popularity FROM truth JOIN w USING (qid) WHERE rank <= 10 GROUP BY id)
SELECT id, popularity FROM p QUALIFY row_number() OVER (ORDER BY popularity DESC, id) <= round(0.02 * (SELECT count(*) FROM e))""",
    "oracle_cell_recall": _RANKS + " SELECT round(avg(CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS own_cell, round(avg(CASE WHEN r <= 4 THEN 1.0::DOUBLE ELSE 0 END), 6) AS probed FROM tr",
    "coarse_miss": _RANKS + " SELECT CAST(n AS INTEGER) AS nprobe, round(avg(CASE WHEN r > n THEN 1.0::DOUBLE ELSE 0 END), 6) AS miss_rate FROM tr CROSS JOIN (SELECT unnest([1, 2, 4, 8]) AS n) GROUP BY n",
    "subspace_variance": _COARSE + """, x AS (SELECT unnest(range(64)) AS pos, unnest(r) AS x FROM res), y AS (SELECT pos, avg(x * x) AS s, avg(x) AS m FROM x GROUP BY pos)
SELECT CAST(pos // 8 AS INTEGER) AS part, round(sum(s - m * m), 6) AS variance FROM y GROUP BY pos // 8""",
    "parallel_error_split": _COARSE + """, p AS (SELECT power(list_sum(list_transform(list_zip(r, v), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 2) AS p, list_sum(list_transform(r, lambda x: x * x)) AS w FROM res)
SELECT round(avg(p), 6) AS parallel, round(avg(w - p), 6) AS orthogonal, round(avg(p / w) FILTER (w > 0), 6) AS rho FROM p""",
    "distortion_deciles": _RANKS + """, o AS (SELECT tr.qid, r, round(dist, 9) AS dist FROM tr JOIN probes ON probes.qid = tr.qid AND probe_rank = 1),
n AS (SELECT r, row_number() OVER (ORDER BY dist, qid) - 1 AS i, count(*) OVER () AS n FROM o)
SELECT CAST(least(i // (n // 10), 9) AS INTEGER) AS decile, count(*) AS n, round(avg(CASE WHEN r > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS miss_rate FROM n GROUP BY 1""",
    "pearson_features": _FEATURES + " SELECT round(corr(f0, f1), 6) AS pearson FROM f",
    "tau_probe": _E + """, p AS (SELECT a.label = b.label AS same, """ + _dist("a.v", "b.v") + """ AS dist FROM q a JOIN e b ON a.qid <> b.vec_id), x AS (SELECT max(dist) FILTER (same) AS w, min(dist) FILTER (NOT same) AS a FROM p)
SELECT round(w, 6) AS max_within, round(a, 6) AS min_across, CASE WHEN w < a THEN round((w + a) / 2, 6) END AS tau FROM x""",
    "cost_proxy": """WITH g AS (SELECT nlist, m, k, nprobe, rerank, (SELECT count(*) FROM embeddings)::DOUBLE AS n FROM (SELECT unnest([32, 64]) AS nlist), (SELECT unnest([48, 96]) AS m), (SELECT unnest([64, 256]) AS k), (SELECT unnest([8, 16, 32]) AS nprobe), (SELECT unnest([0, 50, 200]) AS rerank)),
c AS (SELECT *, 2.0::DOUBLE * 768 * nlist + 2.0::DOUBLE * 768 * k * nprobe + 2.0::DOUBLE * m * n * nprobe / nlist + 2.0::DOUBLE * 768 * rerank AS cost, 2.0::DOUBLE * 768 * 64 + 2.0::DOUBLE * 768 * 64 * 32 + 2.0::DOUBLE * 96 * n * 32 / 64 + 2.0::DOUBLE * 768 * 200 AS preset FROM g)
SELECT nlist, m, k, nprobe, rerank, cost, round(cost / preset, 6) AS ratio, cost <= preset * 1.3::DOUBLE AS feasible FROM c""",
    "heat_by_order": """SELECT vec_id, label, round(CASE WHEN n > 1 THEN r / (n - 1) ELSE 0.0 END, 6) AS heat, CAST(floor(CASE WHEN n > 1 THEN r / (n - 1) ELSE 0.0 END * 1000) + 1 AS BIGINT) AS access
FROM (SELECT vec_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS DOUBLE) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)""",
}
