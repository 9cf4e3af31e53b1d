"""Registered queries over the journal: live state, messages, tasks, presence, blobs, text.

"Now" is the time of the last message. Task states come from the replies to tasks, clears
from questions, pins from messages with a blob, presence from every message of a sender.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.functions.text import html_unescape, is_deploy, normalize_tags
from engrava.operators import comms, journal
from engrava.operators.sessions import sessions
from engrava.session import table
from engrava.sources.text import paragraphs, tool_windows

HOUR = 3_600_000_000_000


def messages(spark, d):
    return journal.once(table(spark, d, "messages"))


def memories(spark, d):
    return journal.once(table(spark, d, "memories"))


def _now(m):
    return m.agg(F.max("ts_ns")).collect()[0][0] or 0


def _kind(c="kind"):
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("note"))


def journal_scan(spark, d):
    rows = table(spark, d, "messages").select("seq", "ts_ns", "tenant", F.lit(5).alias("type"))
    return journal.scan(journal.once(rows), tenant=7, kind=5)


def journal_reverse_limit(spark, d):
    rows = table(spark, d, "messages").select("seq", "ts_ns", "tenant", F.lit(5).alias("type"))
    return journal.scan(journal.once(rows), newest_first=True, limit=60)


def path_registry(spark, d):
    log = table(spark, d, "access_log").filter("item_id is not null")
    paths = table(spark, d, "path_map")
    return journal.path_registry(log.join(paths, "item_id").select("tenant", "seq", "path"))


def live_by_tombstones(spark, d):
    return journal.live_by_tombstones(memories(spark, d), table(spark, d, "forgets")).select("tenant", "mem_id", "seq")


def tag_normalize(spark, d):
    return memories(spark, d).select("seq", F.array_join(normalize_tags(F.col("tags")), "|").alias("tags"))


def live_counts(spark, d):
    live = journal.live_by_tombstones(memories(spark, d), table(spark, d, "forgets"))
    return live.groupBy("tenant").agg(F.countDistinct("mem_id").alias("n"))


def ttl_expire(spark, d):
    m = messages(spark, d)
    return comms.unexpired(m, _now(m)).select("seq", "expires_ns")


def _clears(m):
    return m.filter(_kind() == "question").select("tenant", "area", "seq")


def area_clear(spark, d):
    m = messages(spark, d).withColumn("area", F.coalesce("area", F.lit("")))
    return comms.after_clears(m, _clears(m)).select("tenant", "area", "seq")


def inbox_since(spark, d):
    m = messages(spark, d)
    busiest = m.filter("target <> '' and tenant = 7").groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").first()
    return comms.inbox(m, 7, busiest["target"] if busiest else "", 100).select("seq", "target")


def recent_n(spark, d):
    return comms.recent(messages(spark, d), 100).select("seq", "tenant")


def area_read(spark, d):
    m = messages(spark, d).withColumn("area", html_unescape(F.coalesce("area", F.lit(""))))
    return comms.read_area(m, 7, "build", 0, "agent-kreno", 100).select("seq", "target")


def retention_per_tenant(spark, d):
    m = messages(spark, d)
    return comms.retained(m, _now(m), 400 * HOUR, 5).select("tenant", "seq")


def _states(m):
    tasks = m.filter(_kind() == "task").select("tenant", F.col("seq").alias("task_seq"))
    replies = m.filter("ref_seq <> 0").select("tenant", F.col("ref_seq").alias("task_seq"), "seq", "ts_ns", "sender", _kind().alias("k"))
    state = F.when(F.col("k") == "result", "done").when(F.col("k") == "question", "overdue").otherwise("claimed")
    return tasks.join(replies, ["tenant", "task_seq"]).select("tenant", "task_seq", "seq", state.alias("state"), F.coalesce("sender", F.lit("")).alias("holder"), (F.col("ts_ns") + 24 * HOUR).alias("lease_until"))


def last_wins_state(spark, d):
    m = messages(spark, d)
    return comms.task_states(m.filter(_kind() == "task"), _states(m))


def task_sweep(spark, d):
    m = messages(spark, d)
    return comms.sweep(comms.task_states(m.filter(_kind() == "task"), _states(m)), _now(m))


def task_counts(spark, d):
    return task_sweep(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.sum("nudges").alias("nudges"))


def claim_replay(spark, d):
    """Every reply to a task as a request: results resolve it, questions flag it, other replies claim it."""
    m = messages(spark, d)
    owner = m.filter(_kind() == "task").select("tenant", F.col("seq").alias("task_seq"), F.coalesce("sender", F.lit("")).alias("owner"))
    kind = _kind()
    action = F.when(kind == "result", "done").when(kind == "question", "overdue").otherwise("claim")
    asked = m.filter("ref_seq <> 0").select("tenant", F.col("ref_seq").alias("task_seq"), "seq", action.alias("action"), F.coalesce("sender", F.lit("")).alias("by"), F.col("ts_ns").alias("now_ns"), F.lit(24 * HOUR).alias("ttl_ns"))
    return comms.replay_claims(asked.join(owner, ["tenant", "task_seq"]))


def presence_live(spark, d):
    m = messages(spark, d)
    beats = m.filter("sender is not null").select("tenant", F.col("sender").alias("agent"), F.coalesce("area", F.lit("")).alias("area"), _kind().alias("status"), "ts_ns", "seq")
    return comms.presence(beats, _now(m), 200 * HOUR)


def _pins(m):
    return m.filter("blob_id <> ''").select("tenant", "blob_id", "seq", (F.col("w") % 2 == 0).alias("on"))


def pin_keepset(spark, d):
    m = messages(spark, d)
    return comms.keep_set(comms.retained(m, _now(m), 100 * HOUR, 0), _pins(m))


def blob_gc_antijoin(spark, d):
    m = messages(spark, d)
    stored = m.filter("blob_id <> ''").select("blob_id").distinct()
    return comms.collectable(stored, comms.keep_set(comms.retained(m, _now(m), 100 * HOUR, 0), _pins(m)))


def comms_kanban(spark, d):
    return comms.kanban(messages(spark, d))


def promoted_texts(spark, d):
    return comms.promote(messages(spark, d)).select("tenant", "seq", "text")


def html_unescape_areas(spark, d):
    return messages(spark, d).filter("area is not null").select("area").distinct().select("area", html_unescape("area").alias("plain"))


def deploy_regex(spark, d):
    return messages(spark, d).select("seq", F.coalesce(is_deploy("text"), F.lit(False)).alias("deploy"))


def paragraph_extract(spark, d):
    return paragraphs(table(spark, d, "documents"))


def transcript_windows(spark, d):
    """Windows of three tool uses in each area of a tenant; tasks and questions stand for tool uses."""
    m = messages(spark, d)
    blocks = m.select("tenant", F.coalesce("area", F.lit("")).alias("area"), "seq", _kind().isin("task", "question").alias("is_tool"), "text")
    return tool_windows(blocks, ["tenant", "area"], "seq", 3)


def reflection_yield(spark, d):
    """Per tenant how many transcript windows hold at least 200 characters."""
    w = transcript_windows(spark, d)
    return w.groupBy("tenant").agg(F.count("*").alias("n_windows"), F.count_if(F.length("text") >= 200).alias("n_durable"))


def recall_coverage_percentiles(spark, d):
    """The gaps between a tenant's memories stand for the top distances of its recalls; superseding ones are empty."""
    m = memories(spark, d).select("tenant", "seq", F.when(F.col("sup") == 0, F.size(F.coalesce("tags", F.array().cast("array<string>"))).cast("double") + F.col("mem_id") % 17).alias("top_dist"))
    return journal.recall_coverage(m, 500)


def session_activity(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"))
    return sessions(e, ["user_id"], "ts_ns", "event_id", 6 * HOUR).select("user_id", "start_ns", "end_ns", "n_records")


def tumbling_activity(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.unix_micros("w.start").alias("start_us"), "event_type", "n", "total"
    )


QUERIES = {
    f.__name__: f
    for f in (
        journal_scan, journal_reverse_limit, path_registry, live_by_tombstones, tag_normalize, live_counts, ttl_expire, area_clear, inbox_since, recent_n, area_read,
        retention_per_tenant, last_wins_state, task_sweep, task_counts, claim_replay, presence_live, pin_keepset, blob_gc_antijoin, comms_kanban, promoted_texts,
        html_unescape_areas, deploy_regex, paragraph_extract, transcript_windows, reflection_yield, recall_coverage_percentiles, session_activity, tumbling_activity,
    )
}

_M = """WITH m AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY seq ORDER BY recv_ts) = 1),
k AS (SELECT *, coalesce(nullif(lower(trim(kind)), ''), 'note') AS kd FROM m), now_ AS (SELECT max(ts_ns) AS t FROM m)"""
_MEM = "WITH m AS (SELECT * FROM memories QUALIFY row_number() OVER (PARTITION BY seq ORDER BY recv_ts) = 1)"
_LIVE = _MEM + """, gone AS (SELECT tenant, sup AS mem_id FROM m WHERE sup <> 0 UNION SELECT tenant, mem_id FROM forgets),
live AS (SELECT tenant, mem_id, seq FROM m ANTI JOIN gone USING (tenant, mem_id))"""
_UN = "replace(replace(replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#34;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_STATE = _M + """, t AS (SELECT tenant, seq, deadline_ns AS deadline FROM k WHERE kd = 'task'),
r AS (SELECT k.tenant, ref_seq AS task, k.seq, CASE kd WHEN 'result' THEN 'done' WHEN 'question' THEN 'overdue' ELSE 'claimed' END AS state, coalesce(sender, '') AS holder, ts_ns + 86400000000000 AS lease FROM k JOIN t ON t.tenant = k.tenant AND t.seq = k.ref_seq),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY tenant, task ORDER BY seq DESC) = 1),
s AS (SELECT t.tenant, t.seq, coalesce(state, 'pending') AS state, coalesce(holder, '') AS holder, coalesce(lease, 0) AS lease_until, deadline FROM t LEFT JOIN l ON l.tenant = t.tenant AND l.task = t.seq)"""
_SWEEP = _STATE + """, f AS (SELECT *, state = 'claimed' AND lease_until < t AS freed FROM s, now_),
g AS (SELECT *, CASE WHEN freed THEN 'pending' ELSE state END AS mid FROM f), o AS (SELECT *, mid IN ('pending', 'claimed') AND deadline > 0 AND deadline < t AS late FROM g),
swept AS (SELECT tenant, seq, CASE WHEN late THEN 'overdue' ELSE mid END AS state, CASE WHEN freed THEN '' ELSE holder END AS holder, CASE WHEN freed THEN 0 ELSE lease_until END AS lease_until, deadline, CAST(freed AS INTEGER) + CAST(late AS INTEGER) AS nudges FROM o)"""
_WINDOWS = _M + """, b AS (SELECT tenant, coalesce(area, '') AS area, seq, kd IN ('task', 'question') AS tool, trim(coalesce(text, '')) AS text FROM k),
c AS (SELECT *, CAST(floor(coalesce(sum(CAST(tool AS INTEGER)) OVER (PARTITION BY tenant, area ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 3) AS INTEGER) AS win FROM b),
w AS (SELECT tenant, area, win AS "window", CAST(sum(CAST(tool AS INTEGER)) AS INTEGER) AS tool_uses, coalesce(string_agg(text || chr(10), '' ORDER BY seq) FILTER (text <> ''), '') AS text FROM c GROUP BY ALL HAVING tool_uses > 0 OR text <> '')"""
_KEEP = _M + """, p AS (SELECT blob_id, on_ FROM (SELECT tenant, blob_id, w % 2 = 0 AS on_ FROM m WHERE blob_id <> '' QUALIFY row_number() OVER (PARTITION BY tenant, blob_id ORDER BY seq DESC) = 1)),
keep AS (SELECT blob_id FROM m, now_ WHERE blob_id <> '' AND ts_ns >= t - 360000000000000 UNION SELECT blob_id FROM p WHERE on_)"""

ORACLES = {
    "journal_scan": _M + " SELECT seq, ts_ns, tenant, 5 AS type FROM m WHERE tenant = 7",
    "journal_reverse_limit": _M + " SELECT seq, ts_ns, tenant, 5 AS type FROM m ORDER BY seq DESC LIMIT 60",
    "path_registry": """WITH f AS (SELECT tenant, path, min(seq) AS s FROM access_log JOIN path_map USING (item_id) GROUP BY ALL)
SELECT tenant, path, CAST(row_number() OVER (PARTITION BY tenant ORDER BY s, path) AS INTEGER) AS id FROM f""",
    "live_by_tombstones": _LIVE + " SELECT * FROM live",
    "tag_normalize": _MEM + """, u AS (SELECT seq, lower(trim(t)) AS t, i FROM (SELECT seq, unnest(tags) AS t, unnest(range(len(tags))) AS i FROM m)),
x AS (SELECT seq, t, min(i) AS i FROM u WHERE t <> '' GROUP BY seq, t), y AS (SELECT seq, string_agg(t, '|' ORDER BY i) AS tags FROM x GROUP BY seq)
SELECT m.seq, coalesce(y.tags, '') AS tags FROM m LEFT JOIN y USING (seq)""",
    "live_counts": _LIVE + " SELECT tenant, count(DISTINCT mem_id) AS n FROM live GROUP BY tenant",
    "ttl_expire": _M + " SELECT seq, expires_ns FROM m, now_ WHERE expires_ns = 0 OR expires_ns >= t",
    "area_clear": _M + """, a AS (SELECT *, coalesce(area, '') AS ar FROM k), c AS (SELECT tenant, ar, max(seq) AS cut FROM a WHERE kd = 'question' GROUP BY ALL)
SELECT a.tenant, a.ar AS area, seq FROM a LEFT JOIN c ON c.tenant = a.tenant AND c.ar = a.ar WHERE cut IS NULL OR seq >= cut""",
    "inbox_since": _M + """, b AS (SELECT target FROM m WHERE target <> '' AND tenant = 7 GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)
SELECT seq, m.target FROM m JOIN b USING (target) WHERE tenant = 7 AND seq > 100""",
    "recent_n": _M + " SELECT seq, tenant FROM m ORDER BY seq DESC LIMIT 100",
    "area_read": _M + ", l AS (SELECT seq, target FROM m WHERE tenant = 7 AND " + _UN.format(c="coalesce(area, '')") + " = 'build' ORDER BY seq DESC LIMIT 100) SELECT * FROM l WHERE target IN ('', 'agent-kreno')",
    "retention_per_tenant": _M + " SELECT tenant, seq FROM m, now_ WHERE ts_ns >= t - 1440000000000000 QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY seq DESC) <= 5",
    "last_wins_state": _STATE + " SELECT * FROM s",
    "task_sweep": _SWEEP + " SELECT * FROM swept",
    "task_counts": _SWEEP + " SELECT state, count(*) AS n, CAST(sum(nudges) AS BIGINT) AS nudges FROM swept GROUP BY state",
    "claim_replay": "WITH RECURSIVE" + _M[4:] + """, ow AS (SELECT tenant, seq AS task_seq, coalesce(sender, '') AS owner FROM k WHERE kd = 'task'),
rq AS (SELECT k.tenant, ref_seq AS task_seq, k.seq, CASE kd WHEN 'result' THEN 'done' WHEN 'question' THEN 'overdue' ELSE 'claim' END AS action, coalesce(sender, '') AS who, owner, ts_ns, row_number() OVER (PARTITION BY k.tenant, ref_seq ORDER BY k.seq) AS i
  FROM k JOIN ow ON ow.tenant = k.tenant AND ow.task_seq = k.ref_seq WHERE ref_seq <> 0),
cl AS (SELECT DISTINCT tenant, task_seq, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, false AS granted, 'pending' AS state, CAST('' AS VARCHAR) AS holder, CAST(0 AS BIGINT) AS lease_until FROM rq
UNION ALL SELECT tenant, task_seq, i, seq, fine, CASE WHEN NOT fine THEN state WHEN action = 'claim' THEN 'claimed' ELSE action END, CASE WHEN fine AND action = 'claim' THEN who ELSE holder END, CASE WHEN fine AND action = 'claim' THEN ts_ns + 86400000000000 ELSE lease_until END
FROM (SELECT rq.tenant, rq.task_seq, rq.i, rq.seq, action, who, ts_ns, state, holder, lease_until, CASE action WHEN 'claim' THEN state = 'pending' OR (state IN ('claimed', 'overdue') AND (ts_ns > lease_until OR holder = who))
  WHEN 'done' THEN state NOT IN ('done', 'cancel') AND who IN (holder, owner) AND who <> '' ELSE state IN ('pending', 'claimed') END AS fine FROM cl JOIN rq ON rq.tenant = cl.tenant AND rq.task_seq = cl.task_seq AND rq.i = cl.i + 1))
SELECT tenant, task_seq, seq, granted, state, holder, lease_until FROM cl WHERE i > 0""",
    "presence_live": _M + """, b AS (SELECT tenant, sender AS agent, coalesce(area, '') AS area, kd AS status, ts_ns, seq FROM k WHERE sender IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tenant, sender ORDER BY seq DESC) = 1)
SELECT b.* FROM b, now_ WHERE t - ts_ns <= 720000000000000""",
    "pin_keepset": _KEEP + " SELECT * FROM keep",
    "blob_gc_antijoin": _KEEP + " SELECT DISTINCT blob_id FROM m WHERE blob_id <> '' AND blob_id NOT IN (SELECT blob_id FROM keep)",
    "comms_kanban": _M + ", u AS (SELECT *, " + _UN.format(c="coalesce(area, '')") + """ AS ar FROM m)
SELECT tenant, ar AS area, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_messages, count(DISTINCT nullif(trim(sender), '')) AS n_agents, count(*) FILTER (ref_seq <> 0) AS n_replies FROM u GROUP BY tenant, ar""",
    "promoted_texts": _M + " SELECT tenant, seq, '[from ' || coalesce(area, '') || '#' || seq || '] ' || coalesce(text, '') AS text FROM m",
    "html_unescape_areas": "SELECT DISTINCT area, " + _UN.format(c="area") + " AS plain FROM messages WHERE area IS NOT NULL",
    "deploy_regex": _M + r""" SELECT seq, coalesce(regexp_matches(text, 'systemctl\s+(restart|reload)\s+[\w.-]+|gh\s+pr\s+merge|git\s+merge|scp\s+.*[\w.-]+|git\s+push\s+.*(main|deploy)'), false) AS deploy FROM m""",
    "paragraph_extract": r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^.*?\*\*\* START[^\n]*\n', '', 's'), '\*\*\* END.*$', '', 's') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(range(len(s))) AS n, unnest(s) AS raw FROM (SELECT doc_id, string_split(t, chr(10) || chr(10)) AS s FROM t)),
c AS (SELECT doc_id, CAST(n AS INTEGER) AS n, regexp_replace(regexp_replace(raw, '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ | $', '', 'g') AS paragraph FROM p)
SELECT * FROM c WHERE strlen(paragraph) BETWEEN 50 AND 500""",
    "transcript_windows": _WINDOWS + " SELECT * FROM w",
    "reflection_yield": _WINDOWS + " SELECT tenant, count(*) AS n_windows, count(*) FILTER (length(text) >= 200) AS n_durable FROM w GROUP BY tenant",
    "recall_coverage_percentiles": _MEM + """, x AS (SELECT tenant, CASE WHEN sup = 0 THEN CAST(coalesce(len(tags), 0) + mem_id % 17 AS DOUBLE) END AS d FROM m QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY seq DESC) <= 500),
y AS (SELECT tenant, count(*) AS total, count(*) FILTER (d IS NULL) AS empty, list(d ORDER BY d) FILTER (d IS NOT NULL) AS l FROM x GROUP BY tenant)
SELECT tenant, total, empty, coalesce(l[1], 0) AS top_min, coalesce(l[least(CAST(floor(0.5 * len(l)) AS INTEGER), len(l) - 1) + 1], 0) AS top_p50, coalesce(l[least(CAST(floor(0.9 * len(l)) AS INTEGER), len(l) - 1) + 1], 0) AS top_p90, coalesce(l[len(l)], 0) AS top_max FROM y""",
    "session_activity": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) * 1000 AS t FROM events), n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 21600000000000 THEN 0 ELSE 1 END AS f FROM e),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM n)
SELECT user_id, min(t) AS start_ns, max(t) AS end_ns, count(*) AS n_records FROM g GROUP BY user_id, s""",
    "tumbling_activity": "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
