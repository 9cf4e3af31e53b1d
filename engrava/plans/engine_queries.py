"""Registered queries of the engine over the journal: memory, messages, tasks, blobs, tool uses.

Images are the messages with a blob, clears come from questions and task states from replies,
as in the queries over live state; "now" is the time of the last message.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from engrava.functions.text import normalize_tags, wake_decision
from engrava.operators import blobs, comms, journal, knn, memory
from engrava.plans.state_queries import _LIVE, _M, _MEM, _UN, HOUR, _clears, _kind, _now, _pins, _states, memories, messages
from engrava.session import materialize, table

TAU = 0.6


def _usable(df):
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter((F.size("vec") == 64) & ~bad)


def journal_point_read(spark, d):
    return journal.read(messages(spark, d), 1000).select("seq", "tenant", "ts_ns")


def journal_total(spark, d):
    every = messages(spark, d).select("seq").union(table(spark, d, "memories").select("seq")).union(table(spark, d, "forgets").select("seq")).union(table(spark, d, "access_log").select("seq"))
    return journal.total(every)


def journal_panel(spark, d):
    return journal.panel(memories(spark, d), journal.once(table(spark, d, "forgets")), messages(spark, d), 7)


def recall_last_queries(spark, d):
    """Texts of a tenant's last memories stand for its last recall queries."""
    return journal.recall_log(memories(spark, d).select("tenant", "seq", F.col("text").alias("q")))


def memory_rebuild(spark, d):
    live = memory.rebuild(_usable(table(spark, d, "memories")), table(spark, d, "forgets"), 64)
    return live.select("tenant", "mem_id", "seq", F.array_join("tags", "|").alias("tags"))


def remember_gate(spark, d):
    """What becomes of every memory record when the store is filled anew behind the duplicate gate."""
    return memory.remember(_usable(memories(spark, d)), TAU)


def forget_guarded(spark, d):
    live = journal.live_by_tombstones(memories(spark, d), table(spark, d, "forgets").filter("false"))
    return memory.forget(live, table(spark, d, "forgets"))


def memory_list(spark, d):
    live = journal.live_by_tombstones(memories(spark, d), table(spark, d, "forgets"))
    return memory.listed(live, 7).select("seq", "mem_id")


def corpus_view(spark, d):
    live = journal.live_by_tombstones(_usable(memories(spark, d)), table(spark, d, "forgets"))
    return memory.corpus(live.withColumn("tags", normalize_tags(F.col("tags")))).select("tenant", "mem_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), F.size("tags").alias("n_tags"), "dim", "count").distinct()


def recall_journal(spark, d):
    """Recalls as they are journaled: the hits of each query of its own label."""
    b = table(spark, d, "embeddings")
    q = b.filter("vec_id % 50 = 0")
    hits = knn.nearest(b, q, 5, group_col="label").join(q.select(F.col("vec_id").alias("qid"), F.col("label").alias("tenant")), "qid")
    return memory.recall_records(hits).select("tenant", "qid", "k", F.array_join(F.transform("hits", lambda x: x["id"].cast("string")), ",").alias("ids"))


def reembedded(spark, d):
    """Every memory with its mirrored vector in place of the old one."""
    old = _usable(memories(spark, d))
    new = old.select("seq", F.transform("vec", lambda x: -x).alias("vec"))
    return memory.reembedded(old, new).select("seq", "mem_id", F.round(F.element_at("vec", 1).cast("double"), 5).alias("first"))


def embedded_texts(spark, d):
    """Documents embedded by hashed words."""
    v = memory.hash_vectors(table(spark, d, "documents").select("doc_id", F.lower("text").alias("text")), 8)
    return v.select("doc_id", *(F.round(F.element_at("vec", i).cast("double"), 4).alias(f"v{i}") for i in (1, 8)))


def _index(spark, d):
    """Messages, images, clears and states, and the index rebuilt from them."""
    m = messages(spark, d).withColumn("area", F.coalesce("area", F.lit(""))).withColumn("kind", _kind())
    m = materialize(m, "messages")
    image = F.coalesce(F.col("blob_id"), F.lit("")) != ""
    return m, comms.rebuild(m.filter(~image), m.filter(image), _clears(m), _states(m), _pins(m), _now(m) - 200 * HOUR)


def comms_rebuild_messages(spark, d):
    return _index(spark, d)[1]["messages"].select("tenant", "seq", "area")


def comms_rebuild_tasks(spark, d):
    return _index(spark, d)[1]["tasks"]


def comms_rebuild_pins(spark, d):
    return _index(spark, d)[1]["pins"]


def _swept(spark, d):
    m, index = _index(spark, d)
    beats = m.filter("sender is not null").select("tenant", F.col("sender").alias("agent"), "area", F.col("kind").alias("status"), "ts_ns", "seq")
    return m, comms.sweep_all(index, beats, _now(m), 100 * HOUR, 1000 * HOUR, 40)


def comms_sweep_messages(spark, d):
    return _swept(spark, d)[1]["messages"].select("tenant", "seq")


def comms_sweep_tasks(spark, d):
    return _swept(spark, d)[1]["tasks"]


def comms_sweep_nudges(spark, d):
    return _swept(spark, d)[1]["nudges"].select("tenant", "seq", "area", "n")


def presence_lines(spark, d):
    m, swept = _swept(spark, d)
    return comms.presence_lines(swept["presence"], _now(m))


def task_lines(spark, d):
    _, index = _index(spark, d)
    return comms.rendered(index["messages"].filter("kind = 'task'"), index["tasks"])


def posts_checked(spark, d):
    return comms.posted(messages(spark, d)).select("seq", "kind", F.coalesce("error", F.lit("")).alias("error"))


def clear_counts(spark, d):
    m = messages(spark, d).withColumn("area", F.coalesce("area", F.lit("")))
    return comms.cleared(m, _clears(m))


def message_get(spark, d):
    m = messages(spark, d)
    seq = m.filter("tenant = 7").agg(F.max("seq")).first()[0] or 0
    return comms.get(m, 7, seq).select("tenant", "seq", "area")


def _subscribers(m):
    """Each target of a tenant subscribes to itself and to the areas of its last broadcast."""
    rows = m.filter("target <> ''")
    return rows.groupBy("tenant", "target").agg(F.array_sort(F.collect_set("area")).alias("areas")).select(F.concat("target", F.lit("/"), F.col("tenant").cast("string")).alias("subscriber"), "tenant", "target", F.slice("areas", 1, 1).alias("areas"))


def subscriber_reach(spark, d):
    m = messages(spark, d).withColumn("area", F.coalesce("area", F.lit(""))).withColumn("target", F.coalesce("target", F.lit("")))
    return comms.reached(m, _subscribers(m)).groupBy("subscriber", "tenant").agg(F.count("*").alias("n"))


def subscriber_cursors(spark, d):
    m = messages(spark, d).withColumn("area", F.coalesce("area", F.lit(""))).withColumn("target", F.coalesce("target", F.lit("")))
    return comms.cursors(m, _subscribers(m))


def wake_decisions(spark, d):
    """What each subscriber's session does at the end of a turn, with the middle of the log as its cursor."""
    m = messages(spark, d)
    middle = (m.agg(F.max("seq")).first()[0] or 0) * 9 // 10
    c = subscriber_cursors(spark, d)
    return c.select("subscriber", wake_decision("seq", F.lit(middle), F.col("tenant") % 2 == 0, F.col("tenant"), 20).alias("action"))


def area_board(spark, d):
    return comms.board(messages(spark, d)).select("tenant", "place", "area", F.array_join("agents", "|").alias("agents"), "n_messages")


def access_recorded(spark, d):
    """The second half of the access log recorded by path on the registry of the first half."""
    log = table(spark, d, "access_log").filter("item_id is not null").select("tenant", "seq", "item_id").dropDuplicates(["seq"])
    rows = materialize(log.join(table(spark, d, "path_map"), "item_id").select("tenant", "seq", "path"), "accesses")
    middle = (rows.agg(F.max("seq")).first()[0] or 0) // 2
    last = journal.path_registry(rows.filter(F.col("seq") <= middle))
    return journal.record_access(last, rows.filter(F.col("seq") > middle)).select("tenant", "seq", "id", "new")


def paths_touched(spark, d):
    """Known files named in the messages, each message read as a shell command."""
    uses = messages(spark, d).select("seq", F.lit("Bash").alias("tool"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("command"))).alias("input"), F.lit("").alias("response"), F.lit("").alias("cwd"))
    known = table(spark, d, "path_map").select(F.concat(F.lit("/"), "path").alias("path"))
    return journal.touched_paths(uses, known, "seq")


def blob_addresses(spark, d):
    rows = blobs.addressed(memories(spark, d).select(F.col("text").cast("binary").alias("content")))
    return rows.select("blob_id", "size")


QUERIES = {
    f.__name__: f
    for f in (
        journal_point_read, journal_total, journal_panel, recall_last_queries, memory_rebuild, remember_gate, forget_guarded, memory_list, corpus_view, recall_journal, reembedded,
        embedded_texts, comms_rebuild_messages, comms_rebuild_tasks, comms_rebuild_pins, comms_sweep_messages, comms_sweep_tasks, comms_sweep_nudges, presence_lines, task_lines,
        posts_checked, clear_counts, message_get, subscriber_reach, subscriber_cursors, wake_decisions, area_board, access_recorded, paths_touched, blob_addresses,
    )
}

_GOOD = "len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_FLIVE = _MEM + f""", g AS (SELECT * FROM m WHERE {_GOOD}), gone AS (SELECT tenant, sup AS mem_id FROM g WHERE sup <> 0 UNION SELECT tenant, mem_id FROM forgets),
live AS (SELECT g.* FROM g ANTI JOIN gone USING (tenant, mem_id)),
tg AS (SELECT seq, t, min(i) AS i FROM (SELECT seq, lower(trim(t)) AS t, i FROM (SELECT seq, unnest(tags) AS t, unnest(range(len(tags))) AS i FROM live)) WHERE t <> '' GROUP BY seq, t)"""
_REBUILT = _M + """, k2 AS (SELECT * REPLACE (coalesce(area, '') AS area), kd FROM k), then_ AS (SELECT t - 720000000000000 AS t0 FROM now_),
cl AS (SELECT tenant, area, max(seq) AS cut FROM k2 WHERE kd = 'question' GROUP BY ALL),
live AS (SELECT k2.* FROM k2 CROSS JOIN then_ LEFT JOIN cl ON cl.tenant = k2.tenant AND cl.area = k2.area WHERE (expires_ns = 0 OR expires_ns >= t0) AND (cut IS NULL OR k2.seq >= cut)),
t AS (SELECT tenant, seq, deadline_ns AS deadline FROM live WHERE kd = 'task'),
r AS (SELECT k2.tenant, ref_seq AS task, k2.seq, CASE kd WHEN 'result' THEN 'done' WHEN 'question' THEN 'overdue' ELSE 'claimed' END AS state, coalesce(sender, '') AS holder, ts_ns + 86400000000000 AS lease FROM k2 JOIN t ON t.tenant = k2.tenant AND t.seq = k2.ref_seq),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY tenant, task ORDER BY seq DESC) = 1),
s AS (SELECT t.tenant, t.seq, coalesce(state, 'pending') AS state, coalesce(holder, '') AS holder, coalesce(lease, 0) AS lease_until, deadline FROM t LEFT JOIN l ON l.tenant = t.tenant AND l.task = t.seq)"""
_SWEPT = _REBUILT + """, f AS (SELECT s.*, state = 'claimed' AND lease_until < now_.t AS freed, now_.t AS now_t FROM s, now_),
g AS (SELECT *, CASE WHEN freed THEN 'pending' ELSE state END AS mid FROM f), o AS (SELECT *, mid IN ('pending', 'claimed') AND deadline > 0 AND deadline < now_t AS late FROM g),
kept AS (SELECT live.* FROM live, now_ WHERE (expires_ns = 0 OR expires_ns >= now_.t) AND ts_ns >= now_.t - 3600000000000000 QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY seq DESC) <= 40)"""
_SUBS = _M + """, mm AS (SELECT tenant, seq, coalesce(area, '') AS area, coalesce(target, '') AS target FROM m),
sb AS (SELECT target || '/' || tenant AS subscriber, tenant, target, min(area) AS area FROM mm WHERE target <> '' GROUP BY tenant, target),
hit AS (SELECT subscriber, mm.tenant, seq FROM mm JOIN sb ON sb.tenant = mm.tenant AND sb.target = mm.target UNION SELECT subscriber, mm.tenant, seq FROM mm JOIN sb ON sb.tenant = mm.tenant AND sb.area = mm.area)"""
_LINE = "CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '…' ELSE {c} END"
_CLOCK = "strftime(make_timestamp({c} // 1000), '%H:%M')"

ORACLES = {
    "journal_point_read": _M + " SELECT seq, tenant, ts_ns FROM m WHERE seq = 1000",
    "journal_total": "SELECT max(s) AS total FROM (SELECT max(seq) AS s FROM messages UNION ALL SELECT max(seq) FROM memories UNION ALL SELECT max(seq) FROM forgets UNION ALL SELECT max(seq) FROM access_log)",
    "journal_panel": f"""WITH e AS (SELECT DISTINCT seq, ts_ns, 'Memory' AS type, '#' || mem_id || ' ' || {_LINE.format(c="coalesce(text, '')", n=80)} AS text FROM memories WHERE tenant = 7
UNION ALL SELECT DISTINCT seq, ts_ns, 'Forget', 'tombstone #' || mem_id FROM forgets WHERE tenant = 7
UNION ALL SELECT DISTINCT seq, ts_ns, 'Message', coalesce(sender, '') || CASE WHEN coalesce(target, '') <> '' THEN ' → ' || target ELSE '' END || ' @' || coalesce(area, '') || ': ' || {_LINE.format(c="coalesce(text, '')", n=60)} FROM messages WHERE tenant = 7)
SELECT seq, CAST(floor(ts_ns / 1000000) AS BIGINT) AS ts_ms, type, text FROM e ORDER BY seq DESC LIMIT 60""",
    "recall_last_queries": _MEM + " SELECT tenant, CAST(row_number() OVER (PARTITION BY tenant ORDER BY seq DESC) AS INTEGER) AS n, seq, text AS q FROM m QUALIFY n <= 8",
    "memory_rebuild": _FLIVE + " SELECT tenant, mem_id, live.seq, coalesce(string_agg(t, '|' ORDER BY i), '') AS tags FROM live LEFT JOIN tg USING (seq) GROUP BY tenant, mem_id, live.seq",
    "remember_gate": f"""WITH RECURSIVE m AS (SELECT seq, tenant, mem_id, coalesce(sup, 0) AS sup, CAST(vec AS DOUBLE[]) AS v FROM memories WHERE {_GOOD} AND mem_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq ORDER BY recv_ts) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY seq) AS i FROM m),
p AS (SELECT a.seq, b.mem_id AS id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM m a JOIN m b ON a.tenant = b.tenant AND b.seq < a.seq),
n AS (SELECT seq, list(id ORDER BY dist, id) AS near FROM p WHERE dist < 0.6 GROUP BY seq),
q AS (SELECT o.seq, o.tenant, o.mem_id, o.sup, o.i, coalesce(n.near, []) AS near FROM o LEFT JOIN n USING (seq)),
r AS (SELECT tenant, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS live, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS mem_id, CAST('' AS VARCHAR) AS status, CAST(0 AS BIGINT) AS existing FROM (SELECT DISTINCT tenant FROM q)
UNION ALL SELECT tenant, i, CASE WHEN replaces THEN list_distinct(list_append(list_filter(live, lambda x: x <> sup), mem_id)) WHEN len(held) > 0 THEN live ELSE list_distinct(list_append(live, mem_id)) END, seq, mem_id,
CASE WHEN replaces THEN 'superseded' WHEN len(held) > 0 THEN 'duplicate' ELSE 'inserted' END, CASE WHEN replaces THEN sup WHEN len(held) > 0 THEN held[1] ELSE 0 END
FROM (SELECT q.tenant, q.i, r.live, q.seq, q.mem_id, q.sup, q.sup <> 0 AND list_contains(r.live, q.sup) AS replaces, list_filter(q.near, lambda x: list_contains(r.live, x)) AS held FROM r JOIN q ON q.tenant = r.tenant AND q.i = r.i + 1))
SELECT seq, tenant, mem_id, status, existing FROM r WHERE i > 0""",
    "forget_guarded": _MEM + """, gone AS (SELECT tenant, sup AS mem_id FROM m WHERE sup <> 0), live AS (SELECT DISTINCT tenant, mem_id FROM m ANTI JOIN gone USING (tenant, mem_id))
SELECT f.tenant, f.mem_id, live.mem_id IS NOT NULL AS done FROM (SELECT DISTINCT tenant, mem_id FROM forgets) f LEFT JOIN live ON live.tenant = f.tenant AND live.mem_id = f.mem_id""",
    "memory_list": _LIVE + " SELECT seq, mem_id FROM live WHERE tenant = 7",
    "corpus_view": _MEM + f""", g AS (SELECT * FROM m WHERE {_GOOD}), gone AS (SELECT tenant, sup AS mem_id FROM g WHERE sup <> 0 UNION SELECT tenant, mem_id FROM forgets), live AS (SELECT g.* FROM g ANTI JOIN gone USING (tenant, mem_id)),
c AS (SELECT tenant, count(*) AS "count" FROM live GROUP BY tenant)
SELECT DISTINCT live.tenant, mem_id, CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars, CAST(len(list_distinct(list_filter(list_transform(coalesce(tags, []), lambda x: lower(trim(x))), lambda x: x <> ''))) AS INTEGER) AS n_tags, 64 AS dim, "count" FROM live JOIN c ON c.tenant = live.tenant""",
    "recall_journal": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT q.label, q.vec_id AS qid, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e.vec_id) AS r FROM e q JOIN e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 QUALIFY r <= 5)
SELECT label AS tenant, qid, CAST(count(*) AS INTEGER) AS k, string_agg(id, ',' ORDER BY r) AS ids FROM n GROUP BY label, qid""",
    "reembedded": _MEM + f" SELECT seq, mem_id, round(CAST(-vec[1] AS DOUBLE), 5) AS first FROM m WHERE {_GOOD}",
    "embedded_texts": """WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % 8 AS p, CAST('0x' || substr(md5(w), 8, 7) AS BIGINT) % 2 * 2 - 1 AS s FROM w),
x AS (SELECT doc_id, p, CAST(sum(s) AS DOUBLE) AS x FROM h GROUP BY doc_id, p), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n, coalesce(sum(x) FILTER (p = 0), 0) AS a, coalesce(sum(x) FILTER (p = 7), 0) AS b FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(round(CAST(CAST(a / nullif(n, 0) AS FLOAT) AS DOUBLE), 4), 0.0) AS v1, coalesce(round(CAST(CAST(b / nullif(n, 0) AS FLOAT) AS DOUBLE), 4), 0.0) AS v8 FROM documents LEFT JOIN n USING (doc_id)""",
    "comms_rebuild_messages": _REBUILT + " SELECT tenant, seq, area FROM live",
    "comms_rebuild_tasks": _REBUILT + " SELECT * FROM s",
    "comms_rebuild_pins": _M + """, p AS (SELECT tenant, blob_id, w % 2 = 0 AS on_ FROM m WHERE blob_id <> '' QUALIFY row_number() OVER (PARTITION BY tenant, blob_id ORDER BY seq DESC) = 1) SELECT tenant, blob_id FROM p WHERE on_""",
    "comms_sweep_messages": _SWEPT + " SELECT tenant, seq FROM kept",
    "comms_sweep_tasks": _SWEPT + """ SELECT o.tenant, o.seq, CASE WHEN late THEN 'overdue' ELSE mid END AS state, CASE WHEN freed THEN '' ELSE holder END AS holder, CASE WHEN freed THEN 0 ELSE lease_until END AS lease_until, deadline
FROM o SEMI JOIN kept ON kept.tenant = o.tenant AND kept.seq = o.seq""",
    "comms_sweep_nudges": _SWEPT + " SELECT o.tenant, o.seq, live.area, CAST(freed AS INTEGER) + CAST(late AS INTEGER) AS n FROM o JOIN live ON live.tenant = o.tenant AND live.seq = o.seq WHERE freed OR late",
    "presence_lines": _M + """, b AS (SELECT tenant, sender AS agent, coalesce(area, '') AS area, kd AS status, ts_ns FROM k WHERE sender IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tenant, sender ORDER BY seq DESC) = 1),
a AS (SELECT b.*, greatest(CAST(floor((t - ts_ns) / 1e9) AS BIGINT), 0) AS age_s FROM b, now_ WHERE t - ts_ns <= 360000000000000)
SELECT tenant, agent, '~ ' || agent || CASE WHEN area <> '' THEN ' [' || area || ']' ELSE '' END || ': ' || status || ' (' || CASE WHEN age_s < 60 THEN age_s || 's' WHEN age_s < 3600 THEN age_s // 60 || 'm' ELSE age_s // 3600 || 'h' END || ')' AS line, age_s FROM a""",
    "task_lines": _REBUILT + f""" SELECT s.tenant, s.seq, '#' || s.seq || ' [' || kd || '] ' || coalesce(sender, '') || CASE WHEN coalesce(target, '') <> '' THEN '→' || target ELSE '' END || ' @' || area || ': ' || coalesce(text, '') || '  ⟨'
|| CASE WHEN state IN ('claimed', 'overdue') AND holder <> '' THEN state || ' by ' || holder ELSE state END
|| CASE WHEN state IN ('claimed', 'overdue') AND lease_until > 0 THEN ' · lease ' || {_CLOCK.format(c="lease_until")} ELSE '' END
|| CASE WHEN deadline > 0 AND state NOT IN ('done', 'cancel') THEN ' · due ' || {_CLOCK.format(c="deadline")} ELSE '' END || '⟩' AS line FROM s JOIN live ON live.tenant = s.tenant AND live.seq = s.seq""",
    "posts_checked": _M + """, b AS (SELECT seq, kind, coalesce(blob_id, '') <> '' AS image, coalesce(area, '') = '' OR coalesce(sender, '') = '' AS lacks, coalesce(text, '') = '' AS mute, coalesce(mime, '') = '' AS plain FROM m)
SELECT seq, CASE WHEN image THEN 'image' WHEN coalesce(kind, '') = '' THEN 'note' ELSE kind END AS kind,
CASE WHEN image AND (lacks OR plain) THEN 'area, from, blob and mime are required for an image' WHEN NOT image AND (lacks OR mute) THEN 'area, from and text are required' ELSE '' END AS error FROM b""",
    "clear_counts": _M + """, a AS (SELECT tenant, coalesce(area, '') AS area, seq, kd FROM k), c AS (SELECT tenant, area, seq, coalesce(lag(seq) OVER (PARTITION BY tenant, area ORDER BY seq), 0) AS since FROM a WHERE kd = 'question')
SELECT c.tenant, c.area, c.seq, count(a.seq) AS dropped FROM c LEFT JOIN a ON a.tenant = c.tenant AND a.area = c.area AND a.seq >= c.since AND a.seq < c.seq GROUP BY ALL""",
    "message_get": _M + " SELECT tenant, seq, area FROM m WHERE tenant = 7 AND seq = (SELECT max(seq) FROM m WHERE tenant = 7)",
    "subscriber_reach": _SUBS + " SELECT subscriber, tenant, count(*) AS n FROM hit GROUP BY ALL",
    "subscriber_cursors": _SUBS + " SELECT subscriber, tenant, max(seq) AS seq FROM hit GROUP BY ALL",
    "wake_decisions": _SUBS + """, c AS (SELECT subscriber, tenant, max(seq) AS seq FROM hit GROUP BY ALL), b AS (SELECT subscriber, tenant, tenant % 2 = 0 AS stopping, seq > (SELECT max(seq) FROM m) * 9 // 10 AS news FROM c)
SELECT subscriber, CASE WHEN NOT stopping AND news THEN 'wake' WHEN NOT stopping AND tenant >= 20 THEN 'reflect' WHEN stopping AND news THEN 'alert' ELSE 'close' END AS action FROM b""",
    "area_board": _M + ", u AS (SELECT tenant, seq, trim(coalesce(sender, '')) AS agent, " + _UN.format(c="coalesce(area, '')") + """ AS area FROM m),
f AS (SELECT tenant, area, agent, min(seq) AS s FROM u WHERE agent <> '' GROUP BY ALL), g AS (SELECT tenant, area, string_agg(agent, '|' ORDER BY s) AS agents FROM f GROUP BY ALL), a AS (SELECT tenant, area, min(seq) AS s, count(*) AS n_messages FROM u GROUP BY ALL)
SELECT a.tenant, CAST(row_number() OVER (PARTITION BY a.tenant ORDER BY s) AS INTEGER) AS place, a.area, coalesce(agents, '') AS agents, n_messages FROM a LEFT JOIN g ON g.tenant = a.tenant AND g.area = a.area""",
    "access_recorded": """WITH l AS (SELECT DISTINCT tenant, seq, path FROM access_log JOIN path_map USING (item_id)), md AS (SELECT max(seq) // 2 AS s FROM l),
a AS (SELECT tenant, path, min(seq) AS f FROM l, md WHERE seq <= md.s GROUP BY ALL), ra AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY f, path) AS id FROM a), tp AS (SELECT tenant, max(id) AS top FROM ra GROUP BY tenant),
b AS (SELECT l.tenant, l.path, min(seq) AS f FROM l CROSS JOIN md LEFT JOIN ra ON ra.tenant = l.tenant AND ra.path = l.path WHERE seq > md.s AND ra.id IS NULL GROUP BY ALL),
rb AS (SELECT b.tenant, path, coalesce(top, 0) + row_number() OVER (PARTITION BY b.tenant ORDER BY f, path) AS id FROM b LEFT JOIN tp ON tp.tenant = b.tenant)
SELECT l.tenant, seq, CAST(coalesce(ra.id, rb.id) AS INTEGER) AS id, ra.id IS NULL AS new FROM l CROSS JOIN md LEFT JOIN ra ON ra.tenant = l.tenant AND ra.path = l.path LEFT JOIN rb ON rb.tenant = l.tenant AND rb.path = l.path WHERE seq > md.s""",
    "paths_touched": _M + """, w AS (SELECT seq, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM (SELECT seq, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS t FROM m)),
c AS (SELECT seq, pos, tok AS path, 0 AS kind_ FROM w UNION ALL SELECT seq, pos, split_part(tok, ':', 1), 1 FROM w WHERE instr(tok, ':') > 1),
f AS (SELECT seq, pos, arg_min(CASE WHEN c.path LIKE '/%' THEN c.path ELSE '/' || regexp_replace(c.path, '^(\\./)+', '') END, kind_) AS path FROM c JOIN path_map p ON '/' || p.path = CASE WHEN c.path LIKE '/%' THEN c.path ELSE '/' || regexp_replace(c.path, '^(\\./)+', '') END GROUP BY seq, pos),
g AS (SELECT seq, path, min(pos) AS pos FROM f GROUP BY ALL) SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY pos) AS INTEGER) AS n, path FROM g""",
    "blob_addresses": _MEM + " SELECT DISTINCT sha256(text) AS blob_id, CAST(strlen(text) AS BIGINT) AS size FROM m WHERE text IS NOT NULL",
}
