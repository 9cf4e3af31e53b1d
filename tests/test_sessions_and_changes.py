import random

import pytest

from engrava.operators import changes
from engrava.operators.changes import apply_changes
from engrava.operators.sessions import sessions

GAP = 10


def brute_sessions(rows):
    out, by = [], {}
    for key, t, s in {r for r in rows if r[1] is not None}:
        by.setdefault(key, []).append((t, s))
    for key, times in by.items():
        times.sort(key=lambda x: (x[0], x[1] is not None, x[1]))
        start = last = None
        n = 0
        for t, _ in times:
            if last is not None and t - last > GAP:
                out.append((key, start, last, n))
                start, n = None, 0
            start, last, n = t if start is None else start, t, n + 1
        out.append((key, start, last, n))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_sessions_match_brute_force_with_hot_key(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([7] * 6 + [1, 2, None]), rng.randrange(4000), i) for i in range(3000)]
    rows += rng.sample(rows, 500) + [(7, None, 9_999)]
    df = spark.createDataFrame([(k, t, s, "x", "y") for k, t, s in rows], "k int, ts_ns long, seq long, edge string, start_ns string").repartition(7)
    got = sessions(df, ["k"], gap=GAP)
    assert got.columns == ["k", "start_ns", "end_ns", "n_records", "duration_ns"]
    mine = sorted(((r.k, r.start_ns, r.end_ns, r.n_records) for r in got.collect()), key=str)
    assert mine == brute_sessions(rows)
    assert all(r.duration_ns == r.end_ns - r.start_ns for r in got.collect())


def test_sessions_boundary_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 10, 2), (1, 10, 3), (1, 21, 4), (1, 0, 1)], "k int, ts_ns long, seq long")
    assert sorted((r.start_ns, r.end_ns, r.n_records) for r in sessions(df, ["k"], gap=10).collect()) == [(0, 10, 3), (21, 21, 1)]
    assert sessions(df.filter("k = 9"), ["k"], gap=10).count() == 0
    with pytest.raises(ValueError):
        sessions(df, [], gap=10)


def brute_replay(rows):
    state = {}
    for key, seq, step, op, a, b in sorted({r for r in rows if r[0] is not None and r[1] is not None}, key=lambda r: (r[1], r[2])):
        if op == "delete":
            state.pop(key, None)
        else:
            old = state.get(key, (None, None, None))
            state[key] = (seq, a if a is not None else old[1], b if b is not None else old[2])
    return sorted((k, *v) for k, v in state.items())


@pytest.mark.parametrize("seed", range(3))
def test_replay_matches_brute_force_out_of_order_and_repeated(spark, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(1500):
        op = rng.choice(["upsert", "upsert", "delete"])
        value = lambda: rng.choice([None, "x", "y", "z"]) if op == "upsert" else None  # noqa: B023,E731
        rows.append((rng.choice([5] * 5 + list(range(20))), seq, rng.randrange(2), op, value(), value()))
    rows += rng.sample(rows, 300)
    rng.shuffle(rows)
    feed = rows + [(None, 3, 0, "upsert", "n", None), (4, None, 0, "upsert", "n", None)]
    df = spark.createDataFrame(feed, "k int, seq long, step int, op string, a string, b string").repartition(5)
    got = apply_changes(df, ["k"], ["a", "b"], step="step").collect()
    assert sorted((r.k, r.seq, r.a, r.b) for r in got) == brute_replay(feed)


def test_replay_of_nothing_and_of_unknown_operations(spark):
    df = spark.createDataFrame([(1, 1, "merge")], "k int, seq long, op string")
    assert apply_changes(df.filter("k = 2"), ["k"]).count() == 0
    with pytest.raises(Exception, match="unknown operation"):
        apply_changes(df, ["k"]).collect()


def test_a_feed_in_parts_equals_one_run(spark):
    rng = random.Random(9)
    rows = []
    for seq in range(400):
        k = rng.randrange(25)
        if rng.random() < 0.25:
            rows.append((k, seq, 0, "delete", None, None))
        else:
            rows.append((k, seq, 0, "upsert", rng.choice([None, f"a{seq}"]), rng.choice([None, seq])))
            if rng.random() < 0.2:
                rows.append((rng.randrange(25), seq, 1, "delete", None, None))
    rows += rng.sample(rows, 60) + [(None, 5, 0, "upsert", "x", 1), (3, None, 0, "upsert", "x", 1)]
    frame = lambda part: spark.createDataFrame(part, "k int, seq long, step int, op string, a string, b long").repartition(3)
    run = lambda state, part: spark.createDataFrame(changes.apply_feed(state, frame(part), ["k"], ["a", "b"], step="step").collect(), STATE)
    STATE = "k int, a struct<v:string,s:long,p:int>, b struct<v:long,s:long,p:int>, _write struct<v:boolean,s:long,p:int>, deleted struct<s:long,p:int>"
    wanted = sorted(map(tuple, changes.apply_changes(frame(rows), ["k"], ["a", "b"], step="step").collect()))
    in_order = ([r for r in rows if (r[1] or 0) < 200], [r for r in rows if (r[1] or 0) >= 200])
    mixed = rows[:]
    rng.shuffle(mixed)
    for first, second in (in_order, in_order[::-1], (mixed[:230], mixed[230:])):
        state = run(run(run(None, first), second), second)
        assert sorted(map(tuple, changes.current(state, ["k"], ["a", "b"]).collect())) == wanted
        n = changes.skipped(state, frame(second), ["k"], ["a", "b"], step="step").first()
        assert 0 < n.n_skipped <= n.n_changes
    whole = run(None, [r for r in rows if r[3] == "delete"][:1] + [(1, 900, 0, "upsert", "z", 1)])
    assert changes.skipped(whole, frame([(1, 900, 0, "upsert", "z", 1)]), ["k"], ["a", "b"], step="step").first().n_skipped == 1
