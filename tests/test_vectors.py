import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engrava.functions import vec
from engrava.operators import knn, quant, tune
from engrava.operators.galaxy import galaxy
from engrava.operators.ivf import IvfConfig, IvfIndex, recommended

DIM = 16


def grid_vectors(n):
    """Vectors without random numbers, many of them close to each other."""
    return [[float(np.float32((i % 7) * 10) + np.float32((i * d) % 13) * np.float32(0.3)) for d in range(DIM)] for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, v, i % 3) for i, v in enumerate(np.random.default_rng(0).normal(size=(300, DIM)).tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def index(table):
    built = IvfIndex(IvfConfig(DIM, 4, 4, 16, 10, 10)).train(table)
    built.add(table)
    return built


def test_exact_search_is_exact_and_skips_bad_rows(spark, table):
    bad = spark.createDataFrame([(900, None, 1), (901, [1.0], 1), (None, [0.0] * DIM, 1)], "vec_id long, embedding array<float>, label int")
    got = knn.nearest(table.union(bad), table.filter("vec_id < 5"), 3, dim=DIM).collect()
    x = np.array([r.embedding for r in table.orderBy("vec_id").collect()], np.float32).astype(float)
    for q in range(5):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == q] == np.lexsort((np.arange(300), d))[:3].tolist()
    assert knn.nearest(table, table.filter("vec_id < 0"), 3, dim=DIM).count() == 0
    assert knn.nearest(table, table, 0, dim=DIM).count() == 0


def test_gap_cut_on_the_geometry_fixture(spark):
    ranked = spark.createDataFrame([(1, 1, 1, 0.01), (1, 2, 2, 0.16), (1, 3, 3, 198.01)], "qid long, rank int, id long, dist double")
    assert [r.id for r in knn.gap_cut(ranked, 1.25).collect()] == [1]
    assert knn.gap_cut(ranked, 0).count() == 3
    zero = spark.createDataFrame([(1, 1, 1, 0.0), (1, 2, 2, 0.0), (1, 3, 3, 0.1)], ranked.schema)
    assert knn.gap_cut(zero, 2.0).count() == 2


def test_margin_features(spark):
    one = spark.range(1)
    f = one.select(vec.margin_features(F.array(*(F.lit(float(x)) for x in (2, 4, 6, 8, 10, 12, 14, 16)))).alias("f")).first().f
    assert (f.f0, f.f2) == (2, 2) and abs(f.f1 - 2) < 1e-6 and abs(f.f3 - 4.5) < 1e-6
    none = one.select(vec.margin_features(F.array().cast("array<double>")).alias("f")).first().f
    assert tuple(none) == (0, 0, 0, 0)


@pytest.mark.parametrize("shape", [(0, 4, 8, 8), (15, 4, 8, 8), (16, 0, 8, 8), (16, 4, 257, 8), (16, 4, 0, 8), (16, 4, 8, 0)])
def test_bad_configurations(shape):
    dim, m, k, nlist = shape
    with pytest.raises(ValueError):
        IvfConfig(dim, nlist, m, k)


def test_preset():
    assert recommended(768)[1:] == (32, 200)
    with pytest.raises(ValueError):
        recommended(64)


def test_adding_again_stores_nothing(spark):
    rows = spark.createDataFrame(list(enumerate(grid_vectors(400))), "vec_id long, embedding array<float>")
    built = IvfIndex(IvfConfig(DIM, 8, 4, 32)).train(rows)
    first = rows.filter("vec_id < 50")
    distinct = first.select("embedding").distinct().count()
    assert built.add(first).filter("status = 'Inserted'").count() == distinct
    assert built.entries.count() == distinct
    again = built.add(first)
    assert again.filter("status = 'ExactDuplicate'").count() + again.filter("prior = vec_id").count() == 50
    assert built.entries.count() == distinct


def test_rerank_properties(table, index):
    q = table.filter("vec_id < 20")
    plain = index.search(q, 2, 10)
    assert sorted(map(tuple, index.rerank(plain, q, table, 10, 0).collect())) == sorted(map(tuple, plain.collect()))
    everything = index.search(q, 4, 300)
    exact = index.rerank(everything, q, table, 5, 300).collect()
    asked = q.withColumn("vec_id", -1 - F.col("vec_id"))
    truth = knn.nearest(table, asked, 5, dim=DIM).collect()
    assert sorted((r.qid, r["rank"], r.vec_id) for r in exact) == sorted((-1 - r.qid, r["rank"], r.id) for r in truth)
    kept = index.rerank(plain, q, table.filter("vec_id < 0"), 10, 10).collect()
    assert sorted((r.qid, r.vec_id, r.dist) for r in kept) == sorted((r.qid, r.vec_id, r.dist) for r in plain.collect())


def test_tier_policy_and_tolerance(table, index):
    q = table.filter("vec_id < 10")
    plain = sorted(map(tuple, index.search(q, 2, 5).collect()))
    assert sorted(map(tuple, index.tiered(q, table.filter("vec_id < 0"), 2, 5).collect())) == plain
    own = index.tiered(q, q, 1, 1).collect()
    assert {(r.qid, r.vec_id) for r in own} == {(i, i) for i in range(10)}
    assert sorted(map(tuple, index.search(q.withColumn("p", F.lit(2)), 9, 5, depth_col="p").collect())) == plain
    assert {(r.qid, r.vec_id) for r in index.recall(q, 0).filter("hamming = 0").collect()} >= set() and index.recall(q, 4).count() == 10


def test_save_and_load(table, index, tmp_path):
    index.save(str(tmp_path / "index"))
    q = table.filter("vec_id < 10")
    again = IvfIndex.load(table.sparkSession, str(tmp_path / "index"))
    assert sorted(map(tuple, again.search(q, 2, 5).collect())) == sorted(map(tuple, index.search(q, 2, 5).collect()))


def test_quantisers():
    x = np.random.default_rng(1).normal(size=(500, 8))
    books = quant.train_codebooks(x, 4, 16)
    assert ((x - books.decode(books.encode(x))) ** 2).sum() < ((x - x.mean(0)) ** 2).sum() / 4
    plain = quant.anisotropic_codebooks(x, 4, 16, 1.0)
    skewed = quant.anisotropic_codebooks(x, 4, 16, 8.0)
    along = lambda b: ((((x - b.decode(b.encode(x))).reshape(500, 4, 2) * x.reshape(500, 4, 2)).sum(-1)) ** 2).sum()
    assert along(skewed) < along(plain)
    r = quant.random_rotation(8)
    assert np.allclose(r @ r.T, np.eye(8))
    with pytest.raises(ValueError):
        quant.train_codebooks(x[:3], 4, 16)
    tie = quant.nearest_rows(np.array([[1.0]]), np.array([[0.0], [2.0]]))
    assert tie[0][0] == 0


def test_galaxy_is_stable(table):
    a = sorted(map(tuple, galaxy(table, DIM).collect()))
    b = sorted(map(tuple, galaxy(table.repartition(5), DIM).collect()))
    assert [r[4] for r in a] == [r[4] for r in b] and np.allclose([r[1:4] for r in a], [r[1:4] for r in b])


def test_genetic_search_finds_the_peak():
    config = tune.GaConfig(seed=3, generations=40, patience=40)
    best = tune.genetic_search([2] * 10, config, lambda gs: [float(sum(g)) for g in gs])
    assert best[0][1] >= 9 and best == tune.genetic_search([2] * 10, config, lambda gs: [float(sum(g)) for g in gs])


def test_trees_evaluate_as_columns(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([(1.5, -2.0), (0.0, 3.0), (4.0, 0.0)], "a double, b double")
    for _ in range(5):
        tree = tune.random_tree(rng, 3, 3)
        got = [r[0] for r in df.select(tune.compile_tree(tree, ["a", "b"]).cast("double")).collect()]
        assert np.allclose(got, [tune.evaluate(tree, [r.a, r.b]) for r in df.collect()]), tune.show_tree(tree)
    found = tune.genetic_programming(1, lambda ts: [-sum(abs(tune.evaluate(t, [x]) - x * x) for x in (1.0, 2.0, 3.0)) for t in ts], seed=2)
    assert found[0][1] >= found[-1][1]
