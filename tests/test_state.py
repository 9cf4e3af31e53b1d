import struct
import time

import pytest
from pyspark.sql import functions as F

from engrava.functions import text
from engrava.operators import access, cache, comms, journal
from engrava.sources import binary
from engrava.sources.text import paragraphs, tool_windows, transcript_lines

T0 = 1_700_000_000 * 10**9
LEASE = 15 * 60 * 10**9


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_sweep_frees_flags_and_keeps(spark):
    state = rows(spark, [
        (1, 1, "claimed", "A", T0 + LEASE, 0), (1, 2, "claimed", "A", T0 + 2 * LEASE, T0), (1, 3, "done", "A", 0, 1), (1, 4, "pending", "", 0, T0 + 10 * LEASE), (1, 5, "claimed", "B", T0, T0),
    ], "tenant int, seq long, state string, holder string, lease_until long, deadline long")
    got = {r.seq: (r.state, r.holder, r.nudges) for r in comms.sweep(state, T0 + LEASE + 1).collect()}
    assert got == {1: ("pending", "", 1), 2: ("overdue", "A", 1), 3: ("done", "A", 0), 4: ("pending", "", 0), 5: ("overdue", "", 2)}
    assert comms.sweep(state, T0 + LEASE).filter("seq = 1").first().state == "claimed"


def test_claims_have_one_winner_and_holders_resolve(spark):
    asked = [
        (1, 9, 1, "claim", "A", "boss", T0, LEASE), (1, 9, 2, "claim", "B", "boss", T0 + 1, LEASE), (1, 9, 3, "overdue", "", "boss", T0 + 2, 0), (1, 9, 4, "claim", "B", "boss", T0 + LEASE, LEASE),
        (1, 9, 5, "done", "B", "boss", T0 + 3, 0), (1, 9, 6, "done", "A", "boss", T0 + 3, 0), (1, 9, 7, "claim", "A", "boss", T0 + 9 * LEASE, LEASE),
        (1, 8, 8, "claim", "A", "boss", T0, LEASE), (1, 8, 9, "claim", "B", "boss", T0 + LEASE + 1, LEASE), (1, 8, 10, "cancel", "boss", "boss", T0 + LEASE + 2, 0),
    ]
    df = rows(spark, asked, "tenant int, task_seq long, seq long, action string, by string, owner string, now_ns long, ttl_ns long").repartition(3)
    got = {r.seq: (r.granted, r.state, r.holder) for r in comms.replay_claims(df).collect()}
    assert [got[i][0] for i in range(1, 11)] == [True, False, True, False, False, True, False, True, True, True]
    assert got[6][1] == "done" and got[9][2] == "B" and got[10][1] == "cancel"


def test_task_states_ignore_orphans_and_default_to_pending(spark):
    tasks = rows(spark, [(1, 1, 5), (1, 2, 0)], "tenant int, seq long, deadline_ns long")
    states = rows(spark, [(1, 1, 10, "claimed", "A", 7), (1, 1, 11, "done", "A", 7), (1, 77, 12, "claimed", "Z", 1)], "tenant int, task_seq long, seq long, state string, holder string, lease_until long")
    assert sorted(map(tuple, comms.task_states(tasks, states).collect())) == [(1, 1, "done", "A", 7, 5), (1, 2, "pending", "", 0, 0)]


def test_clears_retention_ttl_and_blobs(spark):
    m = rows(spark, [(1, "a", 1, 100, 0, "x"), (1, "a", 5, 500, 400, ""), (1, "b", 2, 200, 600, "y"), (2, "a", 3, 300, 0, "x")], "tenant int, area string, seq long, ts_ns long, expires_ns long, blob_id string")
    clears = rows(spark, [(1, "a", 5), (1, "a", 2)], "tenant int, area string, seq long")
    seqs = lambda df: sorted(r.seq for r in df.collect())
    assert seqs(comms.after_clears(m, clears)) == [2, 3, 5]
    assert seqs(comms.unexpired(m, 400)) == [1, 2, 3, 5] and seqs(comms.unexpired(m, 401)) == [1, 2, 3]
    assert seqs(comms.retained(m, 500, 300, 1)) == [3, 5] and seqs(comms.retained(m, 500, 0, 0)) == [1, 2, 3, 5]
    pins = rows(spark, [(1, "p", 1, True), (1, "p", 2, False), (2, "q", 1, True)], "tenant int, blob_id string, seq long, on boolean")
    keep = comms.keep_set(m.filter("seq <> 2"), pins)
    assert sorted(r.blob_id for r in keep.collect()) == ["q", "x"]
    stored = rows(spark, [("x",), ("y",), ("z",)], "blob_id string")
    assert sorted(r.blob_id for r in comms.collectable(stored, keep).collect()) == ["y", "z"]
    assert [r.seq for r in comms.recent(m, 2).collect()] == [3, 5]


def test_typed_views_and_bad_payloads(spark, tmp_path):
    j = rows(spark, [(1, 10, 1, 7, '{"item": 5, "src": "x"}'), (2, 11, 1, 7, "{broken"), (3, 12, 3, 7, '{"id": 4, "tags": ["A"], "sup": 0}')], "seq long, ts_ns long, type int, tenant int, payload string")
    assert [(r.seq, r.item) for r in journal.typed(j, "access", skip_bad=True).collect()] == [(1, 5)]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        journal.typed(j, "access").collect()
    assert journal.typed(j, "memory").first().tags == ["A"]
    journal.append(spark, str(tmp_path / "j"), j.select("ts_ns", "type", "tenant", "payload"), 100)
    assert sorted((r.seq, r.ts_ns) for r in spark.read.parquet(str(tmp_path / "j")).collect()) == [(101, 10), (102, 11), (103, 12)]


def test_segments_and_vector_files(spark, tmp_path):
    whole = b"".join(binary.encode_frame(i, 1000 + i, 1, 7, b'{"item": %d}' % i) for i in range(1, 4))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "000001.log").write_bytes(whole)
    (tmp_path / "s" / "000002.log").write_bytes(binary.encode_frame(4, 5, 1, 7, b"{}") + whole[:20])
    assert sorted(r.seq for r in binary.read_segments(spark, str(tmp_path / "s")).collect()) == [1, 2, 3, 4]
    (tmp_path / "s" / "000001.log").write_bytes(whole[:-1])
    with pytest.raises(Exception, match="damaged segment"):
        binary.read_segments(spark, str(tmp_path / "s")).collect()
    (tmp_path / "v.fvecs").write_bytes(binary.encode_vecs([[1.5, 2.0], [3.0, 4.0]]))
    (tmp_path / "v.ivecs").write_bytes(binary.encode_vecs([[7, 8, 9]], "<i4"))
    assert [r.vec for r in binary.read_fvecs(spark, str(tmp_path / "v.fvecs")).orderBy("pos").collect()] == [[1.5, 2.0], [3.0, 4.0]]
    assert binary.read_ivecs(spark, str(tmp_path / "v.ivecs")).first().vec == [7, 8, 9]
    assert struct.calcsize("<IQqBHI") == 27


def test_transcript_windows(spark):
    lines = [
        '{"type":"assistant","message":{"content":[{"type":"text","text":"one"},{"type":"tool_use"},{"type":"tool_use"}]}}',
        '{"type":"user","message":{"content":[{"type":"tool_result"}]}}', '{"type":"user","message":{"content":"plain"}}', "broken",
        '{"type":"assistant","message":{"content":[{"type":"text","text":"two"},{"type":"tool_use"}]}}',
    ]
    blocks = transcript_lines(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).withColumn("o", F.monotonically_increasing_id())
    blocks = blocks.filter("kind <> 'tool_result'").select(F.lit("s").alias("s"), "o", (F.col("kind") == "tool_use").alias("is_tool"), "text")
    uses = lambda k: [r.tool_uses for r in tool_windows(blocks, ["s"], "o", k).orderBy("window").collect()]
    assert (uses(2), uses(3), uses(1)) == ([2, 1], [3], [1, 1, 1])
    assert tool_windows(blocks, ["s"], "o", 2).orderBy("window").first().text == "one\n"


def test_text_functions(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    assert [one(text.parse_duration(F.lit(s))) for s in ("90", "90s", "10m", "1h30m", "x", "")] == [90, 90, 600, 5400, None, None]
    assert [one(text.compact_age(F.lit(s))) for s in (5, 70, 7300)] == ["5s", "1m", "2h"]
    assert one(text.html_unescape(F.lit("R&amp;D &lt;b&gt; &amp;lt;"))) == "R&D <b> &lt;"
    assert one(text.truncate(F.lit("ábcdef"), 3)) == "ábc…" and one(text.slug(F.lit("git@host:team/repo.git"))) == "repo"
    assert one(text.normalize_tags(F.array(F.lit(" A "), F.lit("a"), F.lit(" "), F.lit("B")))) == ["a", "b"]
    assert one(text.is_deploy(F.lit("sudo systemctl  restart api"), "api")) and not one(text.is_deploy(F.lit("git status")))
    assert one(text.message_line(F.lit("#12 [task] bob→amy @build: fix: it"))).text == "fix: it" and one(text.message_line(F.lit("hello"))).seq is None
    docs = spark.createDataFrame([(1, "head\r\n*** START x\r\nshort\r\n\r\n" + "word  " * 20 + "\r\n\r\n*** END\r\nrest"), (2, None)], "doc_id long, text string")
    assert [r.paragraph for r in paragraphs(docs).collect()] == [" ".join(["word"] * 20)]


@pytest.mark.parametrize(("policy", "stream", "hits", "prefetches", "loads"), [
    ("lru", [1, 2, 1, 2], 2, 0, 0), ("lru", [1, 2, 3, 1], 0, 0, 0), ("lfu", [1, 1, 1, 2, 3, 1], 3, 0, 0), ("lru", [1, 2, 1, 3, 1], 2, 0, 0),
    ("markov", [1, 2, 1, 2, 1, 2], 4, 4, 0), ("markov", [1, 2, 1, 2, 3, 1], 3, 3, 1),
])
def test_cache_fixtures(spark, policy, stream, hits, prefetches, loads):
    log = spark.createDataFrame([(1, i, x) for i, x in enumerate(stream)] + [(1, 0, stream[0]), (1, 99, None)], "tenant int, seq long, item_id long")
    r = cache.replay(log, (2,), (policy,)).first()
    assert (r.accesses, r.hits, r.prefetches, r.loads) == (len(stream), hits, prefetches, loads)


def test_cache_members():
    for kind, stream, members in ((cache.Lru, [1, 2, 3], [2, 3]), (cache.Lfu, [1, 1, 2, 3], [1, 3]), (cache.MarkovPrefetch, [1, 2, 1], [1, 2])):
        c = kind(2)
        for x in stream:
            c.access(x)
        assert c.members() == members


def test_lift_fixtures_and_chunks(spark, monkeypatch):
    streams = {1: [1, 2, 3] * 40, 2: list(range(50)), 3: [7], 4: [10, 20, 30, 40] * 25}
    log, seq = [], 0
    for i in range(200):
        for t, s in streams.items():
            if i < len(s):
                seq += 1
                log.append((t, seq, s[i]))
    df = spark.createDataFrame(log + log[:20], "tenant int, seq long, item_id long").repartition(4)
    whole = {r.tenant: r for r in access.stream_lift(df).collect()}
    monkeypatch.setattr(access, "CHUNK", 37)
    cut = {r.tenant: r for r in access.stream_lift(df).collect()}
    assert whole == cut
    assert whole[1].markov_hit >= 0.95 and whole[1].lift >= 0.5 and whole[1].coverage >= 0.95 and whole[4].predictable_stream
    assert (whole[2].coverage, whole[2].lift, whole[3].total, whole[3].lift) == (0, 0, 1, 0)


def test_predictions_and_weights(spark):
    moves = spark.createDataFrame([(1, 0, 5, 5), (1, 0, 3, 1), (1, 9, 8, 1), (1, 1, 7, 1), (1, 1, 4, 1)], "tenant int, prev long, item long, n long")
    top = {}
    for r in access.predictions(moves, 2).orderBy("rank").collect():
        top.setdefault(r.prev, []).append(r.item)
    assert top == {0: [5, 3], 9: [8], 1: [4, 7]}
    w = sorted(r.weight for r in access.zipf_weights(spark.range(5).toDF("id"), 1.0).collect())
    assert w == sorted(1 / k for k in range(1, 6))
    scores = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 3.0), (4, 1.0)], "id long, popularity double")
    assert [r.id for r in access.hot_set(scores, 0.5, 4).collect()] == [2, 3]


def test_streams_equal_batches(spark, tmp_path):
    from engrava.streaming import state, windows

    src = tmp_path / "in"
    rng = [(1, i, i % 4, "a" if i % 3 else "b") for i in range(60)]
    schema = "tenant int, seq long, item long, content string"
    spark.createDataFrame(rng[:30], schema).coalesce(1).write.parquet(str(src))
    time.sleep(1.1)
    spark.createDataFrame(rng[20:], schema).coalesce(1).write.mode("append").parquet(str(src))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name)

    lift = run(state.online_lift(read().select("tenant", "seq", "item")), "update", "lift").orderBy(F.desc("total")).first()
    batch = access.stream_lift(spark.createDataFrame(rng, schema).withColumnRenamed("item", "item_id")).first()
    assert (lift.total, lift.predictable) == (batch.total, batch.predictable) and abs(lift.hits / lift.predictable - batch.markov_hit) < 1e-9
    assert run(state.last_wins(read(), ["tenant"]), "complete", "last").first().seq == 59
    assert run(windows.first_of_content(read(), "content"), "append", "firsts").count() == 2


def test_task_lease_stream(spark, tmp_path):
    from engrava.streaming import state

    schema = "tenant int, task_seq long, seq long, action string, by string, now_ns long, ttl_ns long, deadline long"
    acts = [(1, 5, 1, "post", "", T0, 0, T0 + 3 * LEASE), (1, 5, 2, "claim", "A", T0, LEASE, 0), (1, 5, 3, "claim", "B", T0 + 1, LEASE, 0), (1, 5, 4, "sweep", "", T0 + LEASE + 1, 0, 0), (1, 5, 5, "claim", "B", T0 + LEASE + 2, 9 * LEASE, 0), (1, 5, 6, "sweep", "", T0 + 4 * LEASE, 0, 0)]
    spark.createDataFrame(acts, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = state.task_leases(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("tasks").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("tasks").first()
    assert (r.state, r.holder, r.lease_until) == ("overdue", "B", T0 + 10 * LEASE + 2)
