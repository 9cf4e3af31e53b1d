import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from engrava.llm import clusters
from engrava.llm.clusters import labelled_clusters, markov_flow
from engrava.llm.patterns import frequent_chains
from engrava.llm.posting_lists import CentroidGraph, ListConfig, nearest_neighbours
from engrava.llm.vectors import usable_vectors

GAP = 50


def brute_chains(rows, share, least_length):
    by = {}
    for e, item, t, s in {r for r in rows if None not in r}:
        by.setdefault(e, []).append((t, s, item))
    count = {}
    for events in by.values():
        events.sort()
        seen = set()

        def grow(chain, at):
            seen.add(chain)
            t = events[at][0]
            for j in range(at + 1, len(events)):
                if events[j][0] > t + GAP:
                    break
                if events[j][2] not in chain and len(chain) < 5:
                    grow((*chain, events[j][2]), j)

        for i in range(len(events)):
            grow((events[i][2],), i)
        for c in seen:
            count[c] = count.get(c, 0) + 1
    return {c: n for c, n in count.items() if n >= share * len(by) - 1e-9 and len(c) >= least_length}


@pytest.mark.parametrize("seed", range(2))
def test_chains_match_brute_force(spark, seed):
    rng, rows, s = random.Random(seed), [], 0
    for e in range(12):
        t = 0
        for _ in range(60 if e else 200):
            t += rng.choice([0, 5, 20, 50, 51, 400])
            s += 1
            rows.append((e, rng.choice([1, 2, 3, 4, 5, 6, None]), t, s))
    rows += rng.sample(rows, 100) + [(None, 1, 0, 0), (1, 1, None, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "tenant int, item_id long, ts_ns long, seq long, pattern string").repartition(5)
    for share, least in ((0.7, 3), (0.9, 1)):
        got = {tuple(r.pattern): r.support for r in frequent_chains(df, share, least, GAP).collect()}
        short = {c: n for c, n in got.items() if len(c) < 5}
        assert short == {c: n for c, n in brute_chains(rows, share, least).items() if len(c) < 5}


def test_no_chains_in_nothing(spark):
    df = spark.createDataFrame([], "tenant int, item_id long, ts_ns long, seq long")
    assert frequent_chains(df, 0.1, 3).count() == 0
    with pytest.raises(ValueError):
        frequent_chains(df, 0)


def clustered(seed, sizes, dim=64, noise=0.5):
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        for _ in range(n):
            e = rng.normal(size=dim)
            out.append(c + noise * e / np.linalg.norm(e))
    return np.array(out, np.float32)


def test_usable_vectors(spark):
    good = [1.0] * 64
    rows = [(1, 1, good), (1, 1, good), (2, None, [2.0] * 64), (3, 1, None), (4, 1, [1.0] * 63), (5, 1, [0.0] * 64), (6, 1, [float("nan")] + good[1:]), (7, 1, [None] + good[1:]), (8, 1, [float("inf")] + good[1:]), (None, 1, good)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "mem_id long, tenant int, vec array<float>, grp int")
    assert sorted(r.id for r in usable_vectors(df, "mem_id", "vec", "tenant").collect()) == [1, 2]


def brute_neighbours(ids, groups, x, k):
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    out = set()
    for i in range(len(x)):
        mine = [j for j in range(len(x)) if groups[j] == groups[i] and j != i]
        for j in sorted(mine, key=lambda j: (-round(float(x[i] @ x[j]), 9), ids[j]))[:k]:
            out.add((ids[i], ids[j]))
    return out


def test_neighbours_exact_in_small_groups_and_recall_in_lists(spark):
    x = clustered(1, [150, 100, 60, 40, 3, 1])
    x = np.concatenate([x, np.repeat(x[:1], 8, 0)])  # ties
    ids, groups = list(range(len(x))), [7 if i < 300 or i >= 354 else 1 + i % 3 for i in range(len(x))]
    df = spark.createDataFrame([(i, g, v.tolist()) for i, g, v in zip(ids, groups, x, strict=True)], "id long, grp long, vec array<float>").repartition(5)
    v = usable_vectors(df, "id", "vec", "grp")
    truth = brute_neighbours(ids, groups, x, 5)
    exact = nearest_neighbours(v, 5).collect()
    assert {(r.id, r.neighbour) for r in exact} == truth and len(exact) == len(truth)
    lists = nearest_neighbours(v, 5, ListConfig(list_size=30, block_postings=25, block_queries=40)).collect()
    assert len(lists) == len(truth) and len({(r.id, r.neighbour) for r in lists} & truth) >= 0.9 * len(truth)
    assert nearest_neighbours(v.filter("id < 0"), 5).count() == 0
    with pytest.raises(ValueError):
        nearest_neighbours(v, 0)


def test_graph_search_finds_nearest_centroids():
    c = clustered(2, [20] * 40)
    graph = CentroidGraph(c.astype(float), dense=10)
    q = clustered(3, [50])[:50].astype(float)
    at, d = graph.search(q, 10)
    truth = np.argsort(((q[:, None] - c[None]) ** 2).sum(-1), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(at, truth, strict=True)]) >= 9 and (np.diff(d, axis=1) >= 0).all()
    row, cell, rank, far = graph.within(q, 1.2, np.zeros(len(c)))
    d = ((q[:, None] - c[None]) ** 2).sum(-1)
    wanted = {(i, j) for i, j in zip(*np.nonzero(d <= d.min(1)[:, None] * 1.44), strict=True)}
    assert len(wanted & set(zip(row, cell, strict=True))) >= 0.98 * len(wanted) == 0.98 * len(set(zip(row, cell, strict=True)) | wanted)
    assert np.allclose(far, d[row, cell]) and (rank[far == far.min()] == 0).all()


def recall(spark, x, config, k=5):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>").repartition(4)
    got = {(r.id, r.neighbour) for r in nearest_neighbours(usable_vectors(df, "id", "vec"), k, config).collect()}
    hits = 0
    for lo in range(0, len(u), 1000):
        close = u[lo : lo + 1000] @ u.T
        close[np.arange(len(close)), lo + np.arange(len(close))] = -2
        near = np.argpartition(-close, k, axis=1)[:, :k]
        hits += sum((lo + i, j) in got for i, row in enumerate(near) for j in row.tolist())
    return hits / (k * len(x)), len(got)


def test_recall_holds_with_many_lists_and_nothing_to_tell_them_apart(spark):
    x = np.random.default_rng(5).normal(size=(8000, 64)).astype(np.float32)
    found, n = recall(spark, x, ListConfig(list_size=16))  # 500 lists, searched by the graph
    assert found >= 0.97 and n == 5 * len(x)


def test_recall_holds_with_few_lists_a_query(spark):
    found, n = recall(spark, clustered(6, [300] * 20, noise=0.8), ListConfig(list_size=40))
    assert found >= 0.99 and n == 5 * 6000


def test_clusters_are_components_with_labels(spark):
    x = clustered(4, [60, 30, 9, 8, 7, 1, 1, 1])
    tags = [["  A ", "a", "", None]] * 60 + [["b", "c"]] * 15 + [["c"]] * 15 + [None] * 9 + [["z"], ["y"]] * 4 + [["q"]] * 10
    rows = [(i, v.tolist(), t) for i, (v, t) in enumerate(zip(x, tags, strict=True))]
    rows += rows[:5] + [(900, None, ["a"]), (901, [0.0] * 64, ["a"]), (None, x[0].tolist(), ["a"])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "mem_id long, vec array<float>, tags array<string>, cluster int").repartition(4)
    members, profiles = labelled_clusters(df)
    got = sorted((r.id, r.cluster_label) for r in members.collect())
    wanted = [(i, "a") for i in range(60)] + [(i, "c") for i in range(60, 90)] + [(i, "") for i in range(90, 99)] + [(i, "y") for i in range(99, 107)]
    assert got == wanted
    assert sorted((r.cluster_label, r.size) for r in profiles.collect()) == [("", 9), ("a", 60), ("c", 30), ("y", 8)]
    assert all(1 <= len(r.typical) <= 3 for r in profiles.collect())
    none, _ = labelled_clusters(df.filter("mem_id < 0"))
    assert none.count() == 0


def connected(x, threshold=0.70):
    """The least row of each row's connected set, by brute force."""
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near, root = x @ x.T >= threshold, np.arange(len(x))
    while True:
        low = np.where(near, root[None], len(x)).min(1)
        if (low == root).all():
            return root
        root = low


def two_groups(seed):
    """Two groups of ten equal directions whose cosine is 0.75, and one group on its own."""
    rng = np.random.default_rng(seed)
    a, b, c = np.linalg.qr(rng.normal(size=(64, 3)))[0].T
    b = 0.75 * a + np.sqrt(1 - 0.75**2) * b
    return np.concatenate([v + 0.002 * rng.normal(size=(10, 64)) for v in (a, b, c)])


def chain(seed, n, step):
    """n directions on a circle, neighbours ``step`` radians apart."""
    a, b = np.linalg.qr(np.random.default_rng(seed).normal(size=(64, 2)))[0].T
    return np.array([np.cos(i * step) * a + np.sin(i * step) * b for i in range(n)])


@pytest.mark.parametrize("pivots, block", [(3, 16384), (12, 20)])
def test_clusters_are_whole_with_few_pivots(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(clusters, "PIVOTS", pivots)
    monkeypatch.setattr(clusters, "BLOCK", block, raising=False)
    rng = np.random.default_rng(3)
    x = np.concatenate([two_groups(1), two_groups(2), chain(3, 8, 0.75), chain(4, 9, 0.78), clustered(5, [40, 12, 9, 5], noise=0.7), rng.normal(size=(60, 64))])
    x = x.astype(np.float32)
    root = connected(x)
    truth = {frozenset(np.flatnonzero(root == r).tolist()) for r in np.unique(root) if (root == r).sum() >= 8}
    df = spark.createDataFrame([(i, v.tolist(), ["t"]) for i, v in enumerate(x)], "mem_id long, vec array<float>, tags array<string>").repartition(3)
    got = {}
    for r in clusters.labelled_clusters(df)[0].collect():
        got.setdefault(r.cluster, []).append(r.id)
    assert all(len(set(m)) == len(m) for m in got.values())
    assert {frozenset(m) for m in got.values()} == truth and max(map(len, truth)) >= 20


def test_typical_members_are_those_the_flow_reaches_most(spark, monkeypatch):
    monkeypatch.setattr(clusters, "PIVOTS", 12)
    x = clustered(8, [50, 20, 10], noise=0.6).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), ["t"]) for i, v in enumerate(x)], "mem_id long, vec array<float>, tags array<string>").repartition(3)
    vectors = usable_vectors(df, "mem_id", "vec")
    members, nodes, reached = clusters.similarity_clusters(vectors)
    of, held = {r.id: r.cluster for r in members.collect()}, {r.id: r.strength for r in nodes.collect()}
    got = {r.id: r.strength for r in reached.collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    sample = [r.id for r in vectors.orderBy(F.xxhash64("id"), "id").limit(12).collect()]
    near = np.where(u @ u[sample].T >= 0.70, u @ u[sample].T, 0) ** 2
    flow = near @ (np.array([held[p] for p in sample]) / near.sum(0))
    for i in range(len(x)):
        if near[i].any():
            assert got.get(i, 0) == pytest.approx(flow[i], rel=1e-4)
    assert sum(v for i, v in got.items() if near[i].any()) == pytest.approx(sum(near.any(1)), rel=1e-4)  # no mass is lost
    for r in labelled_clusters(df)[1].collect():
        mine = sorted((i for i in of if of[i] == r.cluster), key=lambda i: (-np.float32(got.get(i, 0)), i))
        assert set(r.typical) <= set(mine[:4]) and r.typical[0] in mine[:2] and r.parts >= 1


def test_markov_flow_decides_typical_members_and_parts(spark, monkeypatch):
    x = clustered(8, [50, 20, 10], noise=0.6).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), ["t"]) for i, v in enumerate(x)], "mem_id long, vec array<float>, tags array<string>").repartition(3)
    with_flow = {r.size: (r.parts, r.typical) for r in labelled_clusters(df)[1].collect()}

    def still(edges, **_):
        ends = edges.select(F.col("src").alias("i")).union(edges.select("dst")).distinct()
        return ends.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))

    monkeypatch.setattr(clusters, "markov_flow", still)
    without = {r.size: (r.parts, r.typical) for r in labelled_clusters(df)[1].collect()}
    assert with_flow.keys() == without.keys() and with_flow != without


def test_markov_flow_separates_two_cliques_with_a_thin_bridge(spark):
    edges = [(a, b, 1.0) for g in (range(6), range(10, 16)) for a in g for b in g if a < b] + [(5, 10, 0.1), (3, 3, 9.0), (1, 2, None)]
    flow = markov_flow(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()
    total = {}
    for r in flow:
        assert (r.i < 10) == (r.j < 10)
        total[r.j] = total.get(r.j, 0) + r.v
    assert len(total) == 12 and all(abs(t - 1) < 1e-6 for t in total.values())


def test_found_clusters_run_no_stage_that_changes_nothing(spark, monkeypatch, tmp_path):
    from engrava.llm import queries

    x = clustered(8, [50, 20, 10, 3], noise=0.6).astype(np.float32)
    rows = [(i, v.tolist(), ["t"]) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "mem_id long, vec array<float>, tags array<string>").write.parquet(f"{tmp_path}/memories.parquet")

    def unwanted(*_, **__):
        raise AssertionError("without effect on p5_found")

    monkeypatch.setattr(clusters, "markov_flow", unwanted)
    monkeypatch.setattr(clusters, "nearest_neighbours", unwanted, raising=False)
    got = sorted((r.cluster_label, r.mem_id) for r in queries.p5_found(spark, str(tmp_path)).collect())
    root = connected(x)
    assert got == [("t", i) for i in range(len(x)) if (root == root[i]).sum() >= 8] and len(got) == 80


def test_blocks_compare_only_what_may_be_linked(monkeypatch):
    rng = np.random.default_rng(5)
    noise = rng.normal(size=(3000, 64)).astype(np.float32)
    x = np.concatenate([noise, noise[:40] + 0.3 * rng.normal(size=(40, 64)).astype(np.float32), noise[:1], noise[:1]])
    frame = pd.DataFrame({"part": -1, "label": np.arange(len(x)) * 7, "angle": np.float32(0), "asks": True, "stands": True, "vec": [v.tobytes() for v in x]})
    tiles, exact = [], clusters._linked
    monkeypatch.setattr(clusters, "_linked", lambda close, *rest: tiles.append(close.shape) or exact(close, *rest))
    out = clusters._joins(0.70, 64, 2)(frame)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cosine = np.where(np.eye(len(x), dtype=bool), -1, u @ u.T)
    forest = out[out["cosine"].isna()]
    root = connected(x)
    merged = np.arange(len(x))
    clusters.join_roots(merged, forest["src"].to_numpy() // 7, forest["dst"].to_numpy() // 7)
    assert (merged == root).all() and len(forest) == len(x) - len(np.unique(root))
    wanted = {(i * 7, j * 7) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -cosine[i].astype(np.float32)))[:2].tolist() if cosine[i, j] >= 0.70}
    near = out[out["cosine"].notna()]
    assert set(zip(near["src"], near["dst"], strict=True)) == wanted
    assert len(tiles) < 6  # of the 9 tiles of 1,024 by 1,024, those with a link
    tiles.clear()
    asks = np.arange(len(x)) < 1500
    apart = frame.assign(part=0, asks=asks, stands=~asks, angle=np.where(asks, 1.2, 0.5).astype(np.float32))
    assert len(clusters._joins(0.70, 64, 0)(apart)) == 0 and not tiles  # no partner within reach


def test_bands_of_partners_share_blocks_and_meet_their_askers(monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 10)
    asking = [(0, 30, 4), (0, 50, 25), (1, 90, 3)]
    standing = [(0, 60, 2), (0, 55, 3), (0, 40, 27), (0, 31, 1), (1, 80, 5)]
    got = sorted(clusters._blocks(asking, standing))
    assert [(p, b, s, a, top) for p, b, _, s, a, top in got] == [(0, 31, 1, 1, 31), (0, 40, 3, 1, 40), (0, 55, 1, 3, 60), (0, 60, 1, 3, 60)]
    assert len({k for _, _, k, *_ in got}) == 3
