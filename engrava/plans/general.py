"""Registered queries of the two general training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrava.operators.changes import apply_changes, apply_feed, current, skipped
from engrava.operators.sessions import sessions
from engrava.session import materialize, table


def _sessions(spark, d):
    src = F.lower(F.regexp_replace(F.coalesce("src", F.lit("")), r"^\s+|\s+$", ""))
    return sessions(table(spark, d, "access_log").withColumn("src", src), ["tenant", "src"])


def p2_found(spark, d):
    return _sessions(spark, d).select("tenant", "src", "start_ns", "end_ns")


def p2_sessions(spark, d):
    return _sessions(spark, d)


def memory_changes(spark, d, columns=()):
    """Writes, supersedes and forgets as one feed; a record's supersede follows its write."""
    memories, forgets = table(spark, d, "memories"), table(spark, d, "forgets")
    none = [F.lit(None).cast(memories.schema[c].dataType).alias(c) for c in columns]
    key = lambda c: [F.col("tenant"), F.col(c).alias("mem_id"), F.col("seq")]
    writes = memories.select(*key("mem_id"), F.lit(0).alias("step"), F.lit("upsert").alias("op"), *columns)
    ends = memories.filter("sup <> 0").select(*key("sup"), F.lit(1).alias("step"), F.lit("delete").alias("op"), *none)
    gone = forgets.select(*key("mem_id"), F.lit(0).alias("step"), F.lit("delete").alias("op"), *none)
    return writes.unionByName(ends).unionByName(gone)


def p3_found(spark, d):
    return apply_changes(memory_changes(spark, d), ["tenant", "mem_id"], step="step").select("tenant", "mem_id", "seq")


def p3_current(spark, d):
    """The live memories with their text and source; a later record without a source keeps the earlier one."""
    return apply_changes(memory_changes(spark, d, ("text", "src")), ["tenant", "mem_id"], ["text", "src"], step="step")


_KEYS, _COLUMNS = ["tenant", "mem_id"], ["text", "src"]


def _halves(spark, d):
    """The feed cut at the middle of its sequence numbers, and the state after the first half."""
    feed = memory_changes(spark, d, _COLUMNS)
    middle = (feed.agg(F.max("seq")).first()[0] or 0) // 2
    state = materialize(apply_feed(None, feed.filter(F.col("seq") <= middle), _KEYS, _COLUMNS, step="step"), "state")
    return feed, feed.filter(F.col("seq") > middle), state


def p3_incremental(spark, d):
    """The live memories after the feed's first half, then its second half, and that once more."""
    _, late, state = _halves(spark, d)
    for _ in range(2):
        state = materialize(apply_feed(state, late, _KEYS, _COLUMNS, step="step"), "state")
    return current(state, _KEYS, _COLUMNS)


def p3_skipped(spark, d):
    """Of the whole feed, how many changes are skipped when it is applied to the state after its first half."""
    feed, _, state = _halves(spark, d)
    return skipped(state, feed, _KEYS, _COLUMNS, step="step")


_TRIMMED = "lower(regexp_replace(coalesce(src, ''), '^\\s+|\\s+$', '', 'g'))"

_SESSIONS = f"""
WITH r AS (SELECT DISTINCT seq, tenant, {_TRIMMED} AS src, ts_ns FROM access_log),
n AS (SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY tenant, src ORDER BY ts_ns, seq) <= 1800000000000 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY tenant, src ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS run FROM n),
s AS (SELECT tenant, src, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, max(ts_ns) - min(ts_ns) AS duration_ns, count(*) AS n_records FROM g GROUP BY tenant, src, run)
"""

_REPLAY = """
WITH w AS (SELECT DISTINCT tenant, mem_id, seq, text, src FROM memories),
e AS (SELECT tenant, sup AS mem_id, seq, 1 AS step FROM memories WHERE sup <> 0 UNION SELECT tenant, mem_id, seq, 0 FROM forgets),
lw AS (SELECT tenant, mem_id, max(seq) AS seq FROM w GROUP BY ALL),
le AS (SELECT tenant, mem_id, max(seq * 2 + step) AS at FROM e GROUP BY ALL),
live AS (SELECT lw.tenant, lw.mem_id, lw.seq, coalesce(le.at, -1) AS at FROM lw LEFT JOIN le ON le.tenant = lw.tenant AND le.mem_id = lw.mem_id WHERE le.at IS NULL OR lw.seq * 2 > le.at)
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_sessions, p3_found, p3_current, p3_incremental, p3_skipped)}
ORACLES = {
    "p2_found": _SESSIONS + "SELECT tenant, src, start_ns, end_ns FROM s",
    "p2_sessions": _SESSIONS + "SELECT * FROM s",
    "p3_found": _REPLAY + "SELECT tenant, mem_id, seq FROM live",
    "p3_current": _REPLAY
    + """SELECT l.tenant, l.mem_id, l.seq, max_by(w.text, w.seq) FILTER (w.text IS NOT NULL) AS text, max_by(w.src, w.seq) FILTER (w.src IS NOT NULL) AS src
FROM live l JOIN w ON w.tenant = l.tenant AND w.mem_id = l.mem_id AND w.seq * 2 > l.at GROUP BY l.tenant, l.mem_id, l.seq""",
}
ORACLES["p3_incremental"] = ORACLES["p3_current"]
