"""Registered streaming queries: each reads its table as a stream to the end and gives the result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from engrava.plans import state_queries
from engrava.session import delete_at_exit, shared_dir
from engrava.streaming import state, windows


def _run(spark, out, mode: str):
    """Run a stream over what is there into a table of the shared folder; complete results only."""
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    delete_at_exit(spark, where)
    result: list = []

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{where}/batch-{n}")
        result.append(n)

    query = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return [spark.read.parquet(f"{where}/batch-{n}") for n in result]


def _stream(spark, d, name):
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")  # a pattern, so that a table may be one file


def stream_vs_batch_counts(spark, d):
    """Events per type and day, counted as a stream."""
    parts = _run(spark, windows.tumbling(_stream(spark, d, "events"), "event_type"), "complete")
    return parts[-1].select(F.unix_micros("start").alias("start_us"), "event_type", "n")


def stream_last_wins(spark, d):
    """Last message of each sender, kept up as a stream."""
    rows = _stream(spark, d, "messages").filter("sender is not null").select("tenant", "sender", "seq", "ts_ns")
    return _run(spark, state.last_wins(rows, ["tenant", "sender"]), "complete")[-1]


def stream_online_lift(spark, d):
    """Hits of the online predictor after the whole access log."""
    rows = _stream(spark, d, "access_log").filter("item_id is not null").select("tenant", "seq", F.col("item_id").alias("item"))
    parts = _run(spark, state.online_lift(rows), "update")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("tenant").agg(F.max("total").alias("total"), F.max("predictable").alias("predictable"), F.max("hits").alias("hits"))


def _last(parts, keys):
    """The last state of each key over the batches."""
    every = None
    for n, part in enumerate(parts):
        part = part.withColumn("_n", F.lit(n))
        every = part if every is None else every.unionByName(part)
    rest = [c for c in every.columns if c not in (*keys, "_n")]
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_n").alias("_last"))
    return last.select(*keys, "_last.*")


def stream_tool_windows(spark, d):
    """Transcript windows of three tool uses, cut as a stream."""
    m = _stream(spark, d, "messages")
    kind = F.coalesce(F.nullif(F.lower(F.trim("kind")), F.lit("")), F.lit("note"))
    blocks = m.select("tenant", F.coalesce("area", F.lit("")).alias("area"), "seq", kind.isin("task", "question").alias("is_tool"), "text")
    return _last(_run(spark, state.tool_windows(blocks, 3), "update"), ["tenant", "area", "window"])


def stream_recall_ring(spark, d):
    """Coverage of each tenant's last recalls, kept up as a stream; stand-ins as in the batch query."""
    m = _stream(spark, d, "memories")
    top = F.when(F.col("sup") == 0, F.size(F.coalesce(F.col("tags"), F.array().cast("array<string>"))).cast("double") + F.col("mem_id") % 17)
    return _last(_run(spark, state.recall_ring(m.select("tenant", "seq", top.alias("top_dist"))), "update"), ["tenant"])


def stream_subscriber_cursors(spark, d):
    """Highest message each target has to hear of, as nudges collect it batch by batch."""
    subscribers = spark.read.parquet(f"{d}/messages.parquet").filter("target <> ''").select("tenant", "target").distinct()
    got: list = []
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    delete_at_exit(spark, where)

    def deliver(frame):
        frame.write.parquet(f"{where}/batch-{len(got)}")
        got.append(len(got))

    state.nudges(_stream(spark, d, "messages"), subscribers, deliver, f"{where}/checkpoint").awaitTermination()
    every = spark.read.parquet(*(f"{where}/batch-{n}" for n in got))
    return every.groupBy("tenant", "target").agg(F.max("seq").alias("seq"))


QUERIES = {f.__name__: f for f in (stream_vs_batch_counts, stream_last_wins, stream_online_lift, stream_tool_windows, stream_recall_ring, stream_subscriber_cursors)}
ORACLES = {
    "stream_vs_batch_counts": "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_last_wins": "SELECT DISTINCT tenant, sender, seq, ts_ns FROM messages WHERE sender IS NOT NULL QUALIFY rank() OVER (PARTITION BY tenant, sender ORDER BY seq DESC) = 1",
    "stream_online_lift": """WITH r AS (SELECT DISTINCT tenant, seq, item_id AS item FROM access_log WHERE item_id IS NOT NULL),
s AS (SELECT tenant, seq, item, lag(item) OVER (PARTITION BY tenant ORDER BY seq) AS prev FROM r), mv AS (SELECT * FROM s WHERE prev IS NOT NULL),
mk AS (SELECT b.tenant, b.seq, b.item, a.item AS guess, count(*) AS n FROM mv b JOIN mv a ON a.tenant = b.tenant AND a.prev = b.prev AND a.seq < b.seq GROUP BY ALL),
mb AS (SELECT tenant, item, guess FROM mk QUALIFY row_number() OVER (PARTITION BY tenant, seq ORDER BY n DESC, guess) = 1),
mh AS (SELECT tenant, count(*) AS predictable, count(*) FILTER (item = guess) AS hits FROM mb GROUP BY tenant), t AS (SELECT tenant, count(*) AS total FROM s GROUP BY tenant)
SELECT t.tenant, total, coalesce(predictable, 0) AS predictable, coalesce(hits, 0) AS hits FROM t LEFT JOIN mh USING (tenant)""",
    "stream_tool_windows": state_queries.ORACLES["transcript_windows"],
    "stream_recall_ring": state_queries.ORACLES["recall_coverage_percentiles"],
    "stream_subscriber_cursors": "SELECT tenant, target, max(seq) AS seq FROM messages WHERE target <> '' GROUP BY tenant, target",
}
