import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import forest as X
from flowloom.operators import models as L


def squares(n, w):
    return sum((n * w) ** 2) / max(sum(n * w), 1e-300)


def rows_of(tree, x):
    """The rows that pass each node, one by one."""
    left, feature, cut, _ = tree
    out = [[] for _ in left]
    for i in range(x.shape[1]):
        at = 0
        out[at].append(i)
        while left[at] >= 0:
            at = left[at] + int(x[feature[at], i] > cut[at])
            out[at].append(i)
    return out


@pytest.mark.parametrize("classes,least,depth,alone,large", [(2, 2, 20, 1 << 13, 128), (2, 1, 20, 8, 4), (3, 2, 20, 1 << 13, 0), (3, 3, 4, 1 << 13, 1 << 12), (2, 2, 20, 64, 1 << 6)])
def test_every_split_is_the_purest_one(monkeypatch, classes, least, depth, alone, large):
    """Two features, so every node draws both: each split is held against all splits, each leaf against the reasons for one."""
    monkeypatch.setattr(X, "_ALONE", alone)
    monkeypatch.setattr(X, "_LARGE", large)
    monkeypatch.setattr(X, "_PIECE", 64)
    r = np.random.default_rng(classes + least)
    x, y, count = r.integers(0, [[40], [256]], (2, 300)).astype(np.uint8), r.integers(0, classes, 300), r.poisson(1.0, 300)
    w = r.random(classes) + 0.5
    tree = X.grow(x, y, count, w, depth, least, np.random.default_rng(1))
    left, feature, cut, shares = tree
    held, level = rows_of(tree, x), {0: 0}
    assert len(left) > 9
    for node, rows in enumerate(held):
        n = lambda some: np.bincount(y[some], count[some], classes)
        rows = np.array(rows, int)
        own = n(rows)
        assert np.allclose(shares[node] / X.ONE, own * w / (own * w).sum(), atol=1e-8)
        found = {}
        for f in range(2):
            for b in np.unique(x[f, rows]):
                a, c = n(rows[x[f, rows] <= b]), n(rows[x[f, rows] > b])
                if min(a.sum(), c.sum()) >= least:
                    found[f, b] = squares(a, w) + squares(c, w)
        best = max(found.values(), default=0.0)
        if left[node] >= 0:
            level |= {left[node]: level[node] + 1, left[node] + 1: level[node] + 1}
            assert np.isclose(found[feature[node], cut[node]], best, rtol=1e-12) and best > squares(own, w)
        else:
            assert level[node] == depth or best <= squares(own, w) * (1 + 1e-9)
    got = X.descend(tree, x)
    assert all((got[i] == shares[max(k for k, rows in enumerate(held) if i in rows)]).all() for i in range(0, 300, 17))


def test_draws_and_features():
    keys = X.row_keys(np.zeros((3, 100_000), np.uint8), np.zeros(100_000, np.uint8), np.arange(100_000))
    one, other = X.draws(keys, 11, 0), X.draws(keys, 11, 1)
    assert len(np.unique(keys)) == len(keys) and abs(one.mean() - 1) < 0.02 and abs(one.astype(float).var() - 1) < 0.03
    assert abs(np.corrcoef(one, other)[0, 1]) < 0.02
    drawn = X._drawn(np.random.default_rng(3), 20_000, 10, 4)
    assert all(len(set(line)) == 4 for line in drawn[:500].tolist())
    assert np.allclose(np.bincount(drawn.ravel(), minlength=10) / 20_000, 0.4, atol=0.02)


def table(spark, n, seed):
    """The class is whether two features have the same sign, a third is noise, a fourth is constant."""
    m = np.random.default_rng(seed).normal(size=(n, 3)).astype(np.float32)
    rows = [(i, [float(v) for v in a] + [2.0], int(a[0] * a[1] > 0)) for i, a in enumerate(m)]
    return spark.createDataFrame(rows, "source_row_id bigint, x array<float>, y int")


def test_edges_are_exact_quantiles(spark):
    m = np.random.default_rng(5).normal(size=3000).astype(np.float32)
    df = spark.createDataFrame([([float(v), float(i % 3), 7.0],) for i, v in enumerate(m)], "x array<float>").repartition(5)
    many, few, one = X.bin_edges(df, "x")
    assert (many == np.sort(m)[np.arange(1, X.BINS) * 3000 // X.BINS]).all() and few.tolist() == [0.0, 1.0] and len(one) == 0


def test_forest_scores(spark):
    """As good as the library's, and the same whatever the partitions and the tasks that the trees are dealt to."""
    train, test = table(spark, 3000, 1), table(spark, 800, 2)

    def scored(a, b):
        return sorted((tuple(r["p"]), r["y"]) for r in X.forest_scores(a, b, [1.0, 1.5], trees=30, depth=12, least=2).collect())

    got = scored(train.repartition(1), test.repartition(3))
    assert len(got) == 800 and got == scored(train.repartition(7).orderBy(F.rand(4)), test.repartition(1))
    assert all(abs(sum(p) - 1) < 1e-6 for p, _ in got)
    ours = sum((p[1] > p[0]) == y for p, y in got) / 800
    model = L.fit_forest(train, "x", "y", None, trees=30, depth=12, least=2)
    theirs = model.transform(test.withColumn("features", L.array_to_vector(F.col("x").cast("array<double>")))).where("prediction = y").count() / 800
    assert ours > 0.9 and ours > theirs - 0.03


def test_more_tasks_than_trees(spark):
    a = X.forest_scores(table(spark, 200, 3), table(spark, 50, 4), [1.0, 1.0], trees=2, depth=5, least=2)
    assert a.count() == 50


def test_no_rows_to_score(spark):
    assert X.forest_scores(table(spark, 200, 3), table(spark, 50, 4).limit(0), [1.0, 1.0], trees=2, depth=5, least=2).count() == 0


def test_pilot_forest_grows_in_the_tasks(spark, small, monkeypatch):
    """The library's forest would hold all trees in the driver."""
    from flowloom.plans import catalog

    monkeypatch.setattr(L, "fit_forest", lambda *a, **k: pytest.fail("a forest of the library"))
    got = catalog.QUERIES["m3_pilot_forest"](spark, small).collect()
    assert len(got) == 1 and 0 < got[0]["macro_f1"] <= 1
