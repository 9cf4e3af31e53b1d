"""Registered queries of sources, sinks and models, most of them round trips of whole tables."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from engrava.functions.text import compact_age, parse_duration
from engrava.operators import knn, lab, quant, tune
from engrava.operators.ivf import IvfIndex
from engrava.plans import state_queries, vector_queries
from engrava.plans.lab_queries import _RECON, _U
from engrava.plans.state_queries import _M, messages
from engrava.plans.streaming_queries import _last, _run, _stream
from engrava.plans.vector_queries import _E, _PQ, DIM, _dist, _index, base
from engrava.session import delete_at_exit, shared_dir, table
from engrava.sources import binary
from engrava.sources.text import transcript_lines
from engrava.streaming import state, windows


def _folder(spark, name):
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = where if "://" in where or where.startswith("file:") else f"file://{where}"
    delete_at_exit(spark, where)
    return where


def fvecs_round_trip(spark, d):
    """The vectors written to files of (dimension, floats) records and read back by byte ranges."""
    where = _folder(spark, "fvecs")
    binary.write_vecs(base(spark, d).repartition(3), where, "embedding")
    back = binary.read_fvecs(spark, where)
    return back.select(F.size("vec").alias("dim"), *(F.round(F.element_at("vec", i).cast("double"), 6).alias(f"v{i}") for i in (1, 2, 64)))


def ivecs_round_trip(spark, d):
    """Nearest neighbours of each query written as integer records and read back."""
    b = base(spark, d)
    near = knn.nearest(b, b.filter("vec_id % 50 = 0"), 3).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("l"))
    where = _folder(spark, "ivecs")
    binary.write_vecs(near.select(F.concat(F.array(F.col("qid")), F.transform("l", lambda x: x["id"])).cast("array<int>").alias("vec")), where, "vec", "<i4")
    back = binary.read_ivecs(spark, where)
    return back.select(F.element_at("vec", 1).cast("long").alias("qid"), F.posexplode(F.slice("vec", 2, 3)).alias("pos", "id")).select("qid", (F.col("pos") + 1).alias("rank"), F.col("id").cast("long").alias("id"))


def segments_round_trip(spark, d):
    """The messages written as checked frames of segment files and read back."""
    rows = messages(spark, d).select("seq", "ts_ns", F.lit(5).alias("type"), "tenant", F.coalesce("text", F.lit("")).alias("payload"))
    where = _folder(spark, "segments")
    binary.write_segments(rows.repartitionByRange(3, "seq").sortWithinPartitions("seq"), where)
    return binary.read_segments(spark, where).select("seq", "ts_ns", "tenant", F.length("payload").alias("n_chars"))


def transcript_round_trip(spark, d):
    """The messages as lines of a transcript, half of them with a block list, parsed again."""
    m = messages(spark, d).select("seq", F.coalesce("text", F.lit("")).alias("t"))
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("t").alias("text")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text")))
    line = lambda content: F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(content.alias("content")).alias("message")))
    lines = m.select(F.when(F.col("seq") % 2 == 0, line(block)).otherwise(line(F.col("t"))).alias("value"))
    return transcript_lines(lines).groupBy("type", "kind").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))


def index_reloaded(spark, d):
    """Codes of the saved index, read back from its folder."""
    _, index = _index(spark, d)
    where = _folder(spark, "index")
    index.save(where)
    again = IvfIndex.load(spark, where)
    return again.entries.select("vec_id", "cell", F.array_join(F.transform("code", lambda x: x.cast("string")), ",").alias("code"))


def index_add_status(spark, d):
    """Every vector added twice, the second time under another id."""
    b, index = _index(spark, d)
    fresh = IvfIndex(index.config, index.coarse, index.books)
    twice = b.select("vec_id", "embedding").union(b.select(F.col("vec_id") + 1_000_000, "embedding"))
    return fresh.add(twice).select("vec_id", "status", "prior")


def decoded_vectors(spark, d):
    """Vectors as their codes give them back."""
    _, index = _index(spark, d)
    return lab.reconstructed(index).select("vec_id", *(F.round(F.element_at("vec", i), 6).alias(f"v{i}") for i in (1, 33, 64)))


def _rotated(r: np.ndarray):
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])

    def run(stream):
        for batch in stream:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(r)) @ r.T
            vec = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(r)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vec], schema=schema)

    return run


def rotation_keeps_neighbours(spark, d):
    """Nearest neighbours among randomly rotated vectors: distances stay."""
    turned = base(spark, d).select("vec_id", "embedding").mapInArrow(_rotated(quant.random_rotation(DIM, 3)), "vec_id long, embedding array<double>")
    near = knn.nearest(turned, turned.filter("vec_id % 50 = 0"), 10)
    return near.select("qid", "rank", "id", F.round("dist", 5).alias("dist"))


def synthetic_vectors(spark, d):
    """Low-rank unit vectors, as many as the table of vectors has."""
    v = lab.low_rank_vectors(spark, base(spark, d).count(), 8, 3)
    return v.select("vec_id", *(F.round(F.element_at("embedding", i), 6).alias(f"v{i}") for i in (1, 8)))


def genetic_best(spark, d):
    """The best configuration a genetic search finds on the grid of the cost model, recall growing with every gene."""
    grid = vector_queries._GRID
    n = base(spark, d).count()
    names = list(grid)

    def judge(genomes):
        rows = spark.createDataFrame([(i, *(grid[k][g] for k, g in zip(names, genome, strict=True))) for i, genome in enumerate(genomes)], f"i int, {', '.join(f'{k} int' for k in names)}")
        ratio = tune.cost_proxy(768, "nlist", "m", "k", "nprobe", "rerank", F.lit(n)) / tune.cost_proxy(768, 64, 96, 64, 32, 200, F.lit(n))
        recall = (F.col("m") / 96 + F.col("k") / 256 + F.col("nprobe") / F.col("nlist") + F.col("rerank") / 200) / 4
        scored = rows.withColumn("ratio", ratio).withColumn("recall", recall).select("i", tune.feasible_fitness("recall", "ratio", 1.3).alias("f"))
        return [r["f"] for r in scored.orderBy("i").collect()]  # one generation

    best, score = tune.genetic_search([len(grid[k]) for k in names], tune.GaConfig(population=24, generations=12), judge)[0]
    return spark.createDataFrame([(round(score, 6),)], "fitness double")


def durations_and_ages(spark, d):
    """Spelled durations made from the log's numbers, read back, and ages in short form."""
    e = table(spark, d, "events").select(F.col("event_id"), (F.col("event_id") % 5).alias("h"), (F.col("event_id") % 59).alias("m"))
    spelled = e.select("event_id", F.concat(F.col("h").cast("string"), F.lit("h"), F.col("m").cast("string"), F.lit("m")).alias("t"))
    return spelled.select("event_id", parse_duration("t").cast("long").alias("seconds"), compact_age(parse_duration("t")).alias("age"))


def stream_first_of_content(spark, d):
    """Different texts of the memories, each once, as a stream."""
    parts = _run(spark, windows.first_of_content(_stream(spark, d, "memories").filter("text is not null").select("text"), "text"), "append")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.select("content_hash")


def stream_task_leases(spark, d):
    """State of each task after the stream of posts and replies, results resolving and other replies but questions claiming."""
    m = _stream(spark, d, "messages")
    kind = F.coalesce(F.nullif(F.lower(F.trim("kind")), F.lit("")), F.lit("note"))
    none = F.lit(0).cast("long")
    post = m.filter(kind == "task").select("tenant", F.col("seq").alias("task_seq"), "seq", F.lit("post").alias("action"), F.coalesce("sender", F.lit("")).alias("by"), F.col("ts_ns").alias("now_ns"), none.alias("ttl_ns"), F.lit(0).cast("long").alias("deadline"))
    reply = m.filter((F.col("ref_seq") != 0) & (kind != "question")).select(
        "tenant", F.col("ref_seq").alias("task_seq"), "seq", F.when(kind == "result", "done").otherwise("claim").alias("action"), F.coalesce("sender", F.lit("")).alias("by"),
        F.col("ts_ns").alias("now_ns"), F.lit(24 * state_queries.HOUR).alias("ttl_ns"), none.alias("deadline"),
    )
    last = _last(_run(spark, state.task_leases(post.unionByName(reply)), "update"), ["tenant", "task_seq"])
    tasks = messages(spark, d).filter(state_queries._kind() == "task").select("tenant", F.col("seq").alias("task_seq"))
    return last.join(tasks, ["tenant", "task_seq"], "left_semi").select("tenant", "task_seq", "state", "holder", "lease_until")


QUERIES = {
    f.__name__: f
    for f in (
        fvecs_round_trip, ivecs_round_trip, segments_round_trip, transcript_round_trip, index_reloaded, index_add_status, decoded_vectors, rotation_keeps_neighbours, synthetic_vectors,
        genetic_best, durations_and_ages, stream_first_of_content, stream_task_leases,
    )
}

_DRAW = lambda s: f"2 * ({_U.format(s=s)}) - 1"

ORACLES = {
    "fvecs_round_trip": "SELECT CAST(len(embedding) AS INTEGER) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS v1, round(CAST(embedding[2] AS DOUBLE), 6) AS v2, round(CAST(embedding[64] AS DOUBLE), 6) AS v64 FROM embeddings",
    "ivecs_round_trip": _E + ", t AS (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank FROM near) SELECT qid, rank, id FROM t WHERE rank <= 3",
    "segments_round_trip": _M + " SELECT seq, ts_ns, tenant, CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars FROM m",
    "transcript_round_trip": _M + """, b AS (SELECT coalesce(text, '') AS t, 'text' AS kind FROM m UNION ALL SELECT '', 'tool_use' FROM m WHERE seq % 2 = 0)
SELECT 'assistant' AS type, kind, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM b GROUP BY kind""",
    "index_reloaded": vector_queries.ORACLES["pq_encode"],
    "index_add_status": """WITH t AS (SELECT vec_id, CAST(embedding AS VARCHAR) AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, CAST(embedding AS VARCHAR) FROM embeddings), p AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY v) AS prior FROM t)
SELECT vec_id, CASE WHEN vec_id = prior THEN 'Inserted' ELSE 'ExactDuplicate' END AS status, prior FROM p""",
    "decoded_vectors": _RECON + " SELECT vec_id, round(y[1], 6) AS v1, round(y[33], 6) AS v33, round(y[64], 6) AS v64 FROM rec",
    "rotation_keeps_neighbours": _E + ", t AS (SELECT qid, id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank FROM near) SELECT qid, rank, id, round(dist, 5) AS dist FROM t WHERE rank <= 10",
    "synthetic_vectors": f"""WITH n AS (SELECT unnest(range((SELECT count(*) FROM embeddings))) AS vec_id), dd AS (SELECT unnest(range(8)) AS d), rr AS (SELECT unnest(range(3)) AS r),
x AS (SELECT vec_id, d, sum(({_DRAW("'z:1:' || vec_id || ':' || r")}) * ({_DRAW("'w:1:' || d || ':' || r")})) + 0.05::DOUBLE * any_value({_DRAW("'e:1:' || vec_id || ':' || d")}) AS x FROM n, dd, rr GROUP BY vec_id, d),
s AS (SELECT vec_id, sqrt(sum(x * x)) AS n, max(x) FILTER (d = 0) AS a, max(x) FILTER (d = 7) AS b FROM x GROUP BY vec_id) SELECT vec_id, round(a / n, 6) AS v1, round(b / n, 6) AS v8 FROM s""",
    "genetic_best": """WITH g AS (SELECT nlist, m, k, nprobe, rerank, (SELECT count(*) FROM embeddings)::DOUBLE AS n FROM (SELECT unnest([32, 64]) AS nlist), (SELECT unnest([48, 96]) AS m), (SELECT unnest([64, 256]) AS k), (SELECT unnest([8, 16, 32]) AS nprobe), (SELECT unnest([0, 50, 200]) AS rerank)),
c AS (SELECT *, (2.0::DOUBLE * 768 * nlist + 2.0::DOUBLE * 768 * k * nprobe + 2.0::DOUBLE * m * n * nprobe / nlist + 2.0::DOUBLE * 768 * rerank) / (2.0::DOUBLE * 768 * 64 + 2.0::DOUBLE * 768 * 64 * 32 + 2.0::DOUBLE * 96 * n * 32 / 64 + 2.0::DOUBLE * 768 * 200) AS ratio FROM g)
SELECT round(max(CASE WHEN ratio <= 1.3::DOUBLE THEN (m / 96 + k / 256 + nprobe / nlist + rerank / 200) / 4 ELSE -(ratio / 1.3::DOUBLE - 1) END), 6) AS fitness FROM c""",
    "durations_and_ages": "SELECT event_id, event_id % 5 * 3600 + event_id % 59 * 60 AS seconds, CASE WHEN event_id % 5 > 0 THEN (event_id % 5 * 3600 + event_id % 59 * 60) // 3600 || 'h' WHEN event_id % 59 > 0 THEN event_id % 59 || 'm' ELSE '0s' END AS age FROM events",
    "stream_first_of_content": "SELECT DISTINCT sha256(text) AS content_hash FROM memories WHERE text IS NOT NULL",
    "stream_task_leases": "WITH RECURSIVE" + _M[4:] + """, ow AS (SELECT tenant, seq AS task_seq, coalesce(sender, '') AS owner FROM k WHERE kd = 'task'),
rq AS (SELECT k.tenant, ref_seq AS task_seq, CASE kd WHEN 'result' THEN 'done' ELSE 'claim' END AS action, coalesce(sender, '') AS who, owner, ts_ns, row_number() OVER (PARTITION BY k.tenant, ref_seq ORDER BY k.seq) AS i
  FROM k JOIN ow ON ow.tenant = k.tenant AND ow.task_seq = k.ref_seq WHERE ref_seq <> 0 AND kd <> 'question' AND k.seq > ref_seq),
cl AS (SELECT tenant, task_seq, CAST(0 AS BIGINT) AS i, 'pending' AS state, CAST('' AS VARCHAR) AS holder, CAST(0 AS BIGINT) AS lease_until FROM ow
UNION ALL SELECT tenant, task_seq, i, CASE WHEN NOT fine THEN state WHEN action = 'claim' THEN 'claimed' ELSE action END, CASE WHEN fine AND action = 'claim' THEN who ELSE holder END, CASE WHEN fine AND action = 'claim' THEN ts_ns + 86400000000000 ELSE lease_until END
FROM (SELECT rq.tenant, rq.task_seq, rq.i, action, who, ts_ns, state, holder, lease_until, CASE action WHEN 'claim' THEN state = 'pending' OR (state = 'claimed' AND (ts_ns > lease_until OR holder = who)) ELSE state <> 'done' AND who IN (holder, owner) AND who <> '' END AS fine
FROM cl JOIN rq ON rq.tenant = cl.tenant AND rq.task_seq = cl.task_seq AND rq.i = cl.i + 1))
SELECT tenant, task_seq, state, holder, lease_until FROM cl QUALIFY row_number() OVER (PARTITION BY tenant, task_seq ORDER BY i DESC) = 1""",
}
