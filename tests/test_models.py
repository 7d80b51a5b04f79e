import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import graph as G
from flowloom.operators import models as L
from flowloom.operators.features import Preprocessor


def graph(spark, seed=4, n=60, f=3):
    r = np.random.default_rng(seed)
    rows = [(i, f"n{r.integers(9)}", f"n{r.integers(9)}", [float(v) for v in r.normal(size=f)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "source_row_id bigint, src string, dst string, x array<float>")


def by_hand(rows, model):
    """Messages first, then their mean, edge by edge."""
    w, f, h = model.weights, model.features, model.hidden
    msgs = [(a, b, np.float32(x).astype(float)) for _, a, b, x in rows] + [(b, a, np.float32(x).astype(float)) for _, a, b, x in rows if a != b]
    state = {v: np.ones(f) for m in msgs for v in m[:2]}
    for n in (1, 2):
        new = {}
        for v in state:
            got = [np.concatenate([state[a], x]) @ w[f"m{n}"] + w[f"bm{n}"] for a, b, x in msgs if b == v]
            mean = np.mean(got, 0) if got else np.zeros(h)
            new[v] = np.maximum(np.concatenate([state[v], mean]) @ w[f"a{n}"] + w[f"ba{n}"], 0)
        state = new
    own = w["e"] if model.use_edge else np.zeros_like(w["e"])
    return {i: L.softmax((state[a] @ w["s"] + state[b] @ w["d"] + np.float32(x).astype(float) @ own + w["b"])[None])[0] for i, a, b, x in rows}


@pytest.mark.parametrize("use_edge", [False, True])
def test_sage_equals_the_equations(spark, use_edge):
    rows, e = graph(spark)
    model = L.Sage(3, 4, 5, use_edge, hidden=8)
    got = {r["source_row_id"]: r["p"] for r in model.edge_probabilities(e, G.message_edges(e)).collect()}
    want = by_hand(rows, model)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[i], want[i], atol=1e-5) for i in want)


def test_renamed_nodes_do_not_matter(spark):
    _, e = graph(spark)
    model = L.Sage(3, 2, 5, hidden=8)
    named = e.withColumns({c: F.concat(F.lit("z"), F.reverse(c)) for c in ("src", "dst")})
    a, b = ({r["source_row_id"]: r["p"] for r in model.edge_probabilities(x, G.message_edges(x)).collect()} for x in (e, named))
    assert all(np.allclose(a[i], b[i], atol=1e-6) for i in a)


def test_perceptron_learns_and_scores(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 4))
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y)], "x array<float>, y int").repartition(3)
    model = L.Perceptron.start(4, 2, 7, hidden=16)
    losses = model.fit(df, [1.0, 1.0], steps=40, rate=0.05)
    assert losses[-1] < losses[0] / 2
    right = model.probabilities(df).select((F.expr("p[1] > p[0]").cast("int") == F.col("y")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.95
    with pytest.raises(ValueError):
        model.fit(df.limit(0), [1.0, 1.0], steps=1)


def test_gradient_is_the_derivative():
    r = np.random.default_rng(2)
    m = L.Perceptron.start(3, 2, 1, hidden=5)
    x, y, w = r.normal(size=(9, 3)), r.integers(0, 2, 9), r.random(9)
    g = m.gradients(x, y, w)
    for place, array in ((2, m.w1), (2 + m.w1.size + m.b1.size, m.w2)):
        old, eps = array.flat[0], 1e-6
        array.flat[0] = old + eps
        up = m.gradients(x, y, w)[0]
        array.flat[0] = old - eps
        down = m.gradients(x, y, w)[0]
        array.flat[0] = old
        assert abs((up - down) / (2 * eps) - g[place]) < 1e-4


def test_forest_arrays_equal_the_library(spark, small):
    from flowloom.plans import catalog

    assert catalog.QUERIES["m4_forest_traverse"](spark, small).first()["equal"]


def test_preprocessor(flows):
    train = flows([{"IN_BYTES": v, "L7_PROTO": p} for v, p in ((1, 1e200), (2, -3e250), (3, 0.0))])
    p = Preprocessor.fit(train, ["IN_BYTES", "L7_PROTO", "PROTOCOL"], "multiclass")
    assert p.log_features == ["L7_PROTO"] and p.scale[2] == 1.0 and p.mean[0] == 2.0
    assert p.equivalent(Preprocessor.from_json(p.to_json()))
    z = [r["x"] for r in p.transform(train).orderBy("source_row_id").collect()]
    assert abs(z[0][0] + 1.2247449) < 1e-6 and z[0][2] == 0.0
    with pytest.raises(Exception, match="not finite"):
        p.transform(flows([{"IN_BYTES": None}])).select("x").collect()
    with pytest.raises(Exception, match="unknown class"):
        p.labels(flows([{"Attack": "new"}])).select("y").collect()
    with pytest.raises(ValueError):
        Preprocessor.fit(flows([{"IN_BYTES": None}]), ["IN_BYTES"], "binary")


def labelled(spark, n=200):
    r = np.random.default_rng(8)
    rows = []
    for i in range(n):
        hot = int(r.random() < 0.5)
        rows.append((i, f"s{r.integers(8)}{'h' * hot}", f"d{r.integers(8)}", [float(v) for v in r.normal(2.0 * hot, 1.0, 3)], hot))
    return spark.createDataFrame(rows, "source_row_id bigint, src string, dst string, x array<float>, y int")


def test_sampled_batches_are_bounded(spark):
    e = labelled(spark)
    b = L.sampled_batches(G.message_edges(e.drop("y")), e, 50, (3, 2), 1).toPandas()
    assert sorted(b.batch.unique()) == [0, 1, 2, 3] and (b.kind == 0).sum() == 200
    assert b[b.kind == 1].groupby(["batch", "b"]).size().max() <= 3 and b[b.kind == 2].groupby(["batch", "b"]).size().max() <= 2


def test_sage_gradient_is_the_derivative(spark):
    e = labelled(spark, 40)
    pdf = L.sampled_batches(G.message_edges(e.drop("y")), e, 40, (4, 3), 1).toPandas()
    model, cw = L.Sage(3, 2, 1, True, hidden=4), np.array([1.0, 2.0])
    g, order = L.sage_gradients(model, pdf, cw)
    place = 2
    for k in order:
        a = model.weights[k]
        old, eps = a.flat[-1], 1e-6
        a.flat[-1] = old + eps
        up = L.sage_gradients(model, pdf, cw)[0][0]
        a.flat[-1] = old - eps
        down = L.sage_gradients(model, pdf, cw)[0][0]
        a.flat[-1] = old
        place += a.size
        assert abs((up - down) / (2 * eps) - g[place - 1]) < 1e-4, k


def test_unsampled_batch_equals_full_inference(spark):
    e = labelled(spark, 60)
    m = G.message_edges(e.drop("y"))
    model = L.Sage(3, 2, 3, hidden=6)
    full = {r["source_row_id"]: r["p"] for r in model.edge_probabilities(e, m).collect()}
    want = -sum(np.log(full[r["source_row_id"]][r["y"]]) for r in e.collect())
    pdf = L.sampled_batches(m, e, 60, (10_000, 10_000), 1).toPandas()
    assert abs(L.sage_gradients(model, pdf, np.ones(2))[0][0] - want) < 1e-3


def test_sage_learns(spark):
    e = labelled(spark)
    model = L.Sage(3, 2, 1, True, hidden=8)
    losses = L.fit_sage(model, e, G.message_edges(e.drop("y")), [1.0, 1.0], passes=8, batch_size=50, fanout=(5, 3), together=2, rate=0.03)
    assert len(losses) == 16 and np.mean(losses[-3:]) < 0.7 * losses[0]


def test_dropout_keeps_the_derivative():
    """With a fixed mask the gradient is still the derivative."""
    r = np.random.default_rng(5)
    m = L.Perceptron.start(3, 2, 1, hidden=5)
    x, y, w, mask = r.normal(size=(9, 3)), r.integers(0, 2, 9), r.random(9), L.kept_units(r, (9, 5), 0.4)
    g, eps, old, ends = m.gradients(x, y, w, mask), 1e-6, m.w1.flat[1], []
    for v in (old + eps, old - eps):
        m.w1.flat[1] = v
        ends.append(m.gradients(x, y, w, mask)[0])
    assert abs((ends[0] - ends[1]) / (2 * eps) - g[3]) < 1e-4


def test_sage_dropout_derivative(spark):
    e = labelled(spark, 40)
    pdf = L.sampled_batches(G.message_edges(e.drop("y")), e, 40, (4, 3), 1).toPandas()
    model, cw, eps = L.Sage(3, 2, 1, True, hidden=4), np.ones(2), 1e-6
    g, order = L.sage_gradients(model, pdf, cw, 0.3, 4)
    place = 2
    for k in order:
        a = model.weights[k]
        ends, old = [], a.flat[0]
        for v in (old + eps, old - eps):
            a.flat[0] = v
            ends.append(L.sage_gradients(model, pdf, cw, 0.3, 4)[0][0])
        a.flat[0] = old
        assert abs((ends[0] - ends[1]) / (2 * eps) - g[place]) < 1e-4, k
        place += a.size


def test_best_weights_budget_and_storage(spark, tmp_path):
    e = labelled(spark, 120)
    model, scores = L.Sage(3, 2, 1, True, hidden=4), iter([0.1, 0.9, 0.3, 0.2, 0.1])
    seen = []

    def score():
        seen.append({k: v.copy() for k, v in model.weights.items()})
        return next(scores)

    losses = L.fit_sage(model, e, G.message_edges(e.drop("y")), [1.0, 1.0], passes=9, batch_size=40, fanout=(3, 2), together=1, dropout=0.2, max_steps=4, evaluate=score, every=1)
    assert len(losses) == 4 == len(seen)  # a whole pass of three, then up to the budget
    assert all(np.array_equal(model.weights[k], seen[1][k]) for k in model.weights)
    L.save_weights(spark, model.weights, f"{tmp_path}/w")
    back = L.load_weights(spark, f"{tmp_path}/w")
    assert back.keys() == model.weights.keys() and all(np.array_equal(back[k], model.weights[k]) for k in back)
    with pytest.raises(Exception, match="exist"):
        L.save_weights(spark, model.weights, f"{tmp_path}/w")


def test_replay_finds_a_planted_error(spark):
    from flowloom.operators import metrics as M

    rows = [(i, float(i) / 50, 1 - float(i) / 50) for i in range(50)]
    stored = spark.createDataFrame(rows, "id bigint, p0 double, p1 double")
    wrong = stored.withColumn("p1", F.when(F.col("id") == 17, F.col("p1") + 0.25).otherwise(F.col("p1"))).where("id <> 3")
    assert tuple(M.replay_error(stored, stored, "id", ["p0", "p1"]).first()) == (50, 0, 0.0)
    assert tuple(M.replay_error(stored, wrong, "id", ["p0", "p1"]).first()) == (49, 1, 0.25)


def test_hub_is_sampled_in_every_batch(spark):
    """A node with all edges gives each batch at most its fanout, without repeats, and other batches other edges."""
    rows = [(i, f"s{i}", "hub", [float(i)], 0) for i in range(400)]
    e = spark.createDataFrame(rows, "source_row_id bigint, src string, dst string, x array<float>, y int")
    b = L.sampled_batches(G.message_edges(e.drop("y")), e, 40, (7, 2), 3).toPandas()
    hop = b[(b.kind == 1) & (b.b == "hub")]
    assert set(hop.groupby("batch").size()) == {7} and set(hop.groupby("batch").a.nunique()) == {7} and hop.a.nunique() > 14


@pytest.mark.parametrize("use_edge", [False, True])
def test_packed_batches_are_the_sampled_rows(spark, use_edge):
    """Means of samples, taken once, give the gradients of the sampled edges one by one, for hubs too."""
    import io

    r = np.random.default_rng(6)
    rows = [(i, f"s{r.integers(40)}", f"d{int(r.integers(40) ** 2 / 200)}", [float(v) for v in r.normal(size=3)], int(r.random() < 0.4)) for i in range(150)]
    e = spark.createDataFrame(rows, "source_row_id bigint, src string, dst string, x array<float>, y int")
    m, model, cw = G.message_edges(e.drop("y")), L.Sage(3, 2, 1, use_edge, hidden=4), np.array([1.0, 2.0])
    spelled = L.sampled_batches(m, e, 40, (4, 3), 1).toPandas()
    got = {b["batch"]: dict(np.load(io.BytesIO(b["data"]))) for b in L.packed_batches(m, e, 40, (4, 3), 1, use_edge).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for b, arrays in got.items():
        want, names = L.sage_gradients(model, spelled[spelled.batch == b], cw)
        assert np.allclose(L.batch_gradient(model, arrays, cw)[0], want, rtol=1e-4, atol=1e-4)


def test_hub_that_no_batch_has_whole(spark):
    """A node whose rows several Arrow batches share has the states of the equations."""
    rows = [(i, f"s{i}", "hub", [float(i % 7), 1.0, -float(i % 3)]) for i in range(50)]
    e = spark.createDataFrame(rows, "source_row_id bigint, src string, dst string, x array<float>")
    key, model = "spark.sql.execution.arrow.maxRecordsPerBatch", L.Sage(3, 2, 5, hidden=8)
    old = spark.conf.get(key)
    spark.conf.set(key, "8")
    try:
        got = {r["source_row_id"]: r["p"] for r in model.edge_probabilities(e, G.message_edges(e)).collect()}
    finally:
        spark.conf.set(key, old)
    want = by_hand(rows, model)
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-5) for i in want)
