"""Neighbours: one vector in a third of the rows, repeated ids, and shards of one tree against brute force."""

import numpy as np

from webloom.llm import neighbours


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[q] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def answers(df, **options):
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0"), **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_hot_vector_and_many_shards(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 5)) * rng.choice([1, 8], (1200, 1))
    x[::3] = x[0]  # a third of all rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got, ids = answers(df, factor=1.0, shard=40), np.arange(1200)
    assert set(got) == set(range(0, 1200, 50))
    for q, found in got.items():
        want = brute(ids, x, q)
        assert [v for v, _ in found] == [v for v, _ in want] and np.allclose([s for _, s in found], [s for _, s in want], rtol=0, atol=1e-12)


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (0, [0.5, 0.0]), (1, [3.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answers(df) == {0: [(2, 0.5), (1, 1.5)]}


def test_regions_cover_all():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    regions = neighbours.Regions(x[:200], 16)
    leaf, bound = regions.leaf_of(x), np.full(500, 0.7)
    assert regions.leaves == 16 and set(leaf) == set(range(16))
    reached = np.zeros((500, 16), bool)
    for at, rows in regions.reached(x, bound, 1.0):
        reached[rows, at] = True
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.7
    assert reached[np.arange(500), leaf].all() and all(reached[i, leaf[j]] for i, j in zip(*np.nonzero(near), strict=True)) and not reached.all()
    assert neighbours.Regions(np.ones((9, 2)), 4).leaves == 1
