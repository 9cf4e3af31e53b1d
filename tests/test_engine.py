import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engrava.engine import Engine
from engrava.functions import text, vec
from engrava.operators import blobs, cache, comms, journal, knn, lab, memory, tune

PLACES = {"cat": (0.0, 0.0), "kitten": (0.1, 0.0), "feline": (0.5, 0.0), "rocket": (10.0, 10.0)}
T0 = 1_700_000_000_000_000_000
MINUTE = 60_000_000_000


def test_engine_memory_keeps_distinct_texts_and_cuts_at_the_gap(spark, tmp_path):
    e = Engine(spark, str(tmp_path), 2, lambda ts: [PLACES[t] for t in ts], tau=0.05, gap=1.25)
    assert e.remember(1, "cat", ["ASHLEY ", "ashley"], now_ns=T0) == (1, True)
    assert e.remember(1, "kitten", now_ns=T0 + 10) == (1, False)  # 0.01 is nearer than tau
    assert e.remember(1, "feline", now_ns=T0 + 20) == (2, True)
    assert e.remember(2, "cat", now_ns=T0 + 30) == (3, True)  # another tenant
    hits = e.recall(1, "kitten", 3, now_ns=T0 + 40).collect()
    assert [(h.mem_id, h.tags) for h in hits] == [(1, ["ashley"])]
    assert e.remember(1, "rocket", supersede=1, now_ns=T0 + 50) == (4, True)
    assert not e.forget(2, 4, now_ns=T0 + 60) and e.forget(1, 2, now_ns=T0 + 70) and not e.forget(1, 2, now_ns=T0 + 80)
    assert [r.mem_id for r in e.memories(1).collect()] == [4]
    again = Engine(spark, str(tmp_path), 2)
    assert again.stats().first().memories == 2 and again.analyze_recall(1).first().total == 1


def test_engine_messages_tasks_and_images(spark, tmp_path):
    e = Engine(spark, str(tmp_path), 2)
    task = e.post(1, "build", "boss", "do it", "task", deadline_ns=T0 + 100 * MINUTE, now_ns=T0)
    with pytest.raises(ValueError):
        e.post(1, "", "boss", "x")
    assert e.claim(1, task, "a", now_ns=T0 + 1) and not e.claim(1, task, "b", now_ns=T0 + 2) and not e.claim(2, task, "b", now_ns=T0 + 2)
    assert e.claim(1, task, "b", now_ns=T0 + 16 * MINUTE)  # the lease of 15 minutes is over
    assert not e.resolve(1, task, "a", now_ns=T0 + 17 * MINUTE) and e.resolve(1, task, "boss", now_ns=T0 + 17 * MINUTE)
    assert e.index(T0)["tasks"].first().state == "done"
    picture = e.post_image(1, "build", "a", b"\x89PNG", "image/png", now_ns=T0 + 5)
    assert e.get_image(1, picture) == b"\x89PNG" and e.get_image(2, picture) is None
    assert [r.seq for r in e.read(1, "build", now_ns=T0).collect()] == [task, picture]
    assert e.comms_clear(1, "build", now_ns=T0 + 9) == 2 and e.blob_gc(T0) == 1 and e.get_image(1, picture) is None


def brute_remember(rows, tau):
    live, out = {}, {}
    for seq, tenant, mem, v, sup in sorted(rows):
        mine = live.setdefault(tenant, {})
        if sup and sup in mine:
            del mine[sup]
            out[seq] = ("superseded", sup)
        else:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), i) for i, w in mine.items())
            if tau and near and near[0][0] < tau:
                out[seq] = ("duplicate", near[0][1])
                continue
            out[seq] = ("inserted", 0)
        mine[mem] = v
    return out


@pytest.mark.parametrize("tau", [0.5, 0.0])
def test_remember_matches_brute_force(spark, monkeypatch, tau):
    monkeypatch.setattr(knn, "PAIR_BLOCK", 7)
    rng = random.Random(3)
    rows = []
    for seq in range(1, 90):
        sup = rng.choice([0, 0, 0, rng.randrange(1, 90)])
        rows.append((seq * 3, rng.randrange(3), seq, [rng.randrange(6) / 2.0, rng.randrange(6) / 2.0 + seq * 1e-7], sup))
    df = spark.createDataFrame([*rows, rows[4], (5000, 1, 5000, None, 0), (5001, 1, None, [0.0, 0.0], 0)], "seq long, tenant int, mem_id long, vec array<double>, sup long").repartition(4)
    got = {r.seq: (r.status, r.existing) for r in memory.remember(df, tau, 2).collect()}
    assert got == brute_remember(rows, tau)
    assert memory.remember(df.filter("false"), tau, 2).count() == 0


def test_rebuild_refuses_other_sizes_and_reembed_missing_vectors(spark):
    df = spark.createDataFrame([(1, 1, 1, [0.0, 1.0], ["A ", "a"], 0), (2, 1, 2, [1.0], None, 0)], "seq long, tenant int, mem_id long, vec array<float>, tags array<string>, sup long")
    none = spark.createDataFrame([], "tenant int, mem_id long")
    assert memory.rebuild(df.filter("seq = 1"), none, 2).first().tags == ["a"]
    with pytest.raises(Exception, match="another size"):
        memory.rebuild(df, none, 2).collect()
    new = spark.createDataFrame([(1, [5.0, 5.0])], "seq long, vec array<float>")
    with pytest.raises(Exception, match="no new vector"):
        memory.reembedded(df, new).collect()
    texts = spark.createDataFrame([("one two",), (None,)], "text string")
    assert [r.vec for r in memory.embed(texts, lambda ts: [[len(t), 1] for t in ts], 2).collect()] == [[7.0, 1.0], [0.0, 1.0]]


def test_blob_store_puts_once_and_sweeps(spark, tmp_path):
    store = blobs.BlobStore(spark, str(tmp_path / "b"))
    rows = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"one"),), (bytearray(b"two"),), (None,)], "content binary")
    first = {r.blob_id: r.new for r in store.put(rows).collect()}
    assert len(first) == 2 and all(first.values()) and not any(r.new for r in store.put(rows).collect())
    one = sorted(first)[0]
    assert store.sweep(spark.createDataFrame([(one,)], "blob_id string")) == 1
    assert [r.blob_id for r in store.list().collect()] == [one] and bytes(store.get(one).first().content) in (b"one", b"two")


def test_lru_by_chunks_equals_one_pass(spark, monkeypatch):
    monkeypatch.setattr(cache, "CHUNK", 40)
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3]), seq, rng.choice([None, *range(12)])) for seq in range(500)]
    df = spark.createDataFrame(rows + rows[:50], "tenant int, seq long, item_id long").repartition(4)
    got = {(r.tenant, r.capacity): (r.accesses, r.hits) for r in cache.replay(df, (1, 3, 8), ("lru",)).collect()}
    for tenant in (1, 2, 3):
        items = [i for t, _, i in rows if t == tenant and i is not None]
        for c in (1, 3, 8):
            lru = cache.Lru(c)
            assert got[tenant, c] == (len(items), sum(lru.access(i) for i in items))


def test_touched_paths_and_registry(spark):
    uses = [(1, "Edit", '{"file_path": "a/x.py"}', "", "/r"), (2, "Bash", '{"command": "cat ./a/x.py /r/b.md:12 nope -v a/x.py"}', "", "/r"), (3, "Grep", "{}", '["/r/b.md:3:hit /r/c.txt"]', "/r"), (4, "Other", '{"file_path": "a/x.py"}', "", "/r")]
    df = spark.createDataFrame(uses, "use_id long, tool string, input string, response string, cwd string")
    known = spark.createDataFrame([("/r/a/x.py",), ("/r/b.md",)], "path string")
    assert sorted(map(tuple, journal.touched_paths(df, known).collect())) == [(1, 1, "/r/a/x.py"), (2, 1, "/r/a/x.py"), (2, 2, "/r/b.md"), (3, 1, "/r/b.md")]


def test_text_helpers(spark):
    rows = [("claimed", "x", T0, T0 + 15 * MINUTE), ("pending", "", 0, 0), ("done", "x", 5, 7), (None, "", 0, 0)]
    df = spark.createDataFrame(rows, "state string, holder string, lease_until long, deadline long")
    assert [r[0] for r in df.select(text.task_suffix("state", "holder", "lease_until", "deadline")).collect()] == ["  ⟨claimed by x · lease 22:13 · due 22:28⟩", "  ⟨pending⟩", "  ⟨done⟩", ""]
    readme = spark.createDataFrame([("\n\n# Title \n\n> first  line\nsecond\n\nother",), (None,), ("é" * 400,)], "t string")
    got = [r[0] for r in readme.select(text.intro("t")).collect()]
    assert got[:2] == ["Title first line second", ""] and got[2] == "é" * 250
    urls = spark.createDataFrame([("git@host:org/repo.git",), ("https://host:8/org/repo.git",), ("https://host/repo",), (None,)], "u string")
    assert [r[0] for r in urls.select(text.owner_slug("u")).collect()] == ["org/repo", "org/repo", "", ""]
    q = spark.createDataFrame([("s", "i", "f"), ("s", "", "f"), ("", None, "f")], "s string, i string, f string")
    assert [r[0] for r in q.select(text.recall_query("s", "i", "f")).collect()] == ["s: i", "s", "f"]


def test_fnv1a_and_division_trees(spark):
    def fnv(values):
        h = 0xCBF29CE484222325
        for b in np.asarray(values, "<f4").tobytes():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    vectors = [[1.0, 2.5], [], None, [0.0, -0.0, 3.0]]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<float>")
    assert [r[0] for r in df.select(vec.fnv1a("v")).collect()] == [None if v is None else fnv(v) for v in vectors]
    tree = ("var", 0)
    for _ in range(12):  # would grow to 3**12 operands if a division repeated its own
        tree = ("/", tree, ("/", ("var", 1), tree))
        if tune.depth_of(tree) > 8:
            break
    values = spark.createDataFrame([(2.0, 3.0), (0.0, 1.0)], "a double, b double")
    got = [r[0] for r in values.select(tune.compile_tree(tree, ["a", "b"])).collect()]
    assert got == pytest.approx([tune.evaluate(tree, list(r)) for r in values.collect()])


def test_streams_follow_and_draw(spark):
    items = spark.createDataFrame([(i, 1.0) for i in range(10)], "id long, weight double")
    rows = lab.self_exciting(spark, 300, [0.0, 1.0], lambda x: lab.drawn(items, x, "id"), 10).collect()
    chain = [r.item for r in sorted((r for r in rows if r.eta == 1.0), key=lambda r: r.t)]
    assert all((a + 1) % 10 == b for a, b in zip(chain, chain[1:], strict=False))
    free = [r.item for r in rows if r.eta == 0.0]
    assert set(free) == set(range(10)) and min(free.count(i) for i in range(10)) > 10


def test_sweep_all_drops_state_with_its_message(spark):
    messages = spark.createDataFrame([(1, 1, T0, "a", "x", "task", 0, T0 - 5), (1, 2, T0 - 9 * MINUTE, "a", "x", "task", 0, 0), (1, 3, T0, "a", "x", "task", T0 + 1, 0)], "tenant int, seq long, ts_ns long, area string, target string, kind string, expires_ns long, deadline_ns long")
    states = spark.createDataFrame([(1, 1, 10, "claimed", "h", T0 - 1), (1, 9, 11, "done", "h", 0)], "tenant int, task_seq long, seq long, state string, holder string, lease_until long")
    none = spark.createDataFrame([], "tenant int, blob_id string, seq long, on boolean")
    clears = spark.createDataFrame([], "tenant int, area string, seq long")
    index = comms.rebuild(messages, messages.filter("false"), clears, states, none, T0)
    beats = spark.createDataFrame([(1, "h", "a", "busy", T0 - 3, 5)], "tenant int, agent string, area string, status string, ts_ns long, seq long")
    out = comms.sweep_all(index, beats, T0 + 2, MINUTE, 5 * MINUTE, 0)
    assert [(r.seq, r.state, r.holder) for r in out["tasks"].collect()] == [(1, "overdue", "")]
    assert [(r.seq, r.n) for r in out["nudges"].collect()] == [(1, 2)] and out["presence"].count() == 1 and [r.seq for r in out["messages"].collect()] == [1]
    assert comms.presence_lines(out["presence"], T0).first().line == "~ h [a]: busy (0s)"
    seen = F.col("seq")
    assert comms.cleared(messages, spark.createDataFrame([(1, "a", 3), (1, "a", 9)], "tenant int, area string, seq long")).orderBy(seen).first().dropped == 2
