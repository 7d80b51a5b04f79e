"""Metrics of stored predictions, and analysis of the run table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import canon
from flowloom.functions import scalar as S
from flowloom.operators import metrics as M
from flowloom.operators import results as R
from flowloom.operators.audit import beside, n_rows
from flowloom.operators.skew import ordinals
from flowloom.operators.splitting import evenly_spaced
from flowloom.operators.validation import nonfinite
from flowloom.plans.registry import Registry, Tables
from flowloom.schema import SPLITS

Q = Registry()
KEY = ["dataset", "task", "model", "seed"]
_RUNS = "u AS (SELECT DISTINCT * FROM runs)"


def runs(t: Tables) -> DataFrame:
    """The run table, each key once."""
    return R.one_per_key(t.runs, KEY)


def sql_ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN round(({a}) / ({b}), 9) ELSE 0 END"


@Q("a27_confusion", "WITH c AS (SELECT range::INT AS c FROM range(3)) SELECT a.c AS y_true, b.c AS y_pred, (SELECT count(*) FROM predictions p WHERE p.y_true = a.c AND p.y_pred = b.c) AS n FROM c a, c b")
def confusion(t: Tables) -> DataFrame:
    """Confusion counts over a fixed set of three classes, one of which never occurs."""
    return M.confusion(t.predictions, [0, 1, 2])


@Q("a28_accuracy", "SELECT round(avg((y_true = y_pred)::INT), 9) AS accuracy FROM predictions")
def accuracy(t: Tables) -> DataFrame:
    """Share of right predictions."""
    return t.predictions.agg(F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")), 9).alias("accuracy"))


_PC = f"""pc AS (SELECT c AS class, count(*) FILTER (WHERE y_true = c) AS support, count(*) FILTER (WHERE y_true = c AND y_pred = c) AS tp, count(*) FILTER (WHERE y_true <> c AND y_pred = c) AS fp,
  count(*) FILTER (WHERE y_true = c AND y_pred <> c) AS fn FROM predictions, (SELECT range::INT AS c FROM range(3)) GROUP BY c),
pr AS (SELECT *, {sql_ratio('tp', 'tp + fp')} AS precision, {sql_ratio('tp', 'tp + fn')} AS recall, {sql_ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM pc)"""


def by_class(t: Tables) -> DataFrame:
    return M.per_class(t.predictions, [0, 1, 2])


@Q("a29_per_class", f"WITH {_PC} SELECT class, support, tp, fp, fn, precision, recall, f1 FROM pr")
def per_class(t: Tables) -> DataFrame:
    """Precision, recall and F1 of each class."""
    return by_class(t)


@Q("a30_macro_f1", f"WITH {_PC} SELECT round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM pr")
def macro_f1(t: Tables) -> DataFrame:
    """Macro F1 over the fixed set, and F1 weighted by support."""
    return M.summary(by_class(t)).select("macro_f1", "weighted_f1")


@Q("a31_macro_averages", f"WITH {_PC} SELECT round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(sum(tp) / sum(support), 9) AS accuracy FROM pr")
def macro_averages(t: Tables) -> DataFrame:
    """Macro precision and recall."""
    return M.summary(by_class(t)).select("macro_precision", "macro_recall", "accuracy")


@Q("a34_replay_error", "SELECT count(*) AS matched, CAST(0 AS BIGINT) AS unmatched, round(max(greatest(abs(x.p_benign - y.p_benign), abs(x.p_attack - y.p_attack), 0)), 9)::DOUBLE AS max_error FROM predictions x JOIN predictions y USING (row_offset)")
def replay(t: Tables) -> DataFrame:
    """The largest error of predictions against a replay of them, here against themselves: no stored model could recompute them."""
    e = M.replay_error(t.predictions, t.predictions, "row_offset", ["p_benign", "p_attack"])
    return e.select("matched", "unmatched", F.round("max_error", 9).alias("max_error"))


@Q("a35_probability_sums", "SELECT count(*) FILTER (WHERE abs(p_benign + p_attack - 1) > 1e-3) AS off, count(*) FILTER (WHERE p_benign IS NULL OR p_attack IS NULL) AS unknown FROM predictions")
def probability_sums(t: Tables) -> DataFrame:
    """Rows whose probabilities do not sum to one."""
    total = F.aggregate(F.array("p_benign", "p_attack"), F.lit(0.0), lambda a, x: a + x)
    return t.predictions.agg(F.count_if(F.abs(total - 1) > 1e-3).alias("off"), F.count_if(total.isNull()).alias("unknown"))


_W = "w AS (SELECT y_true AS c, (SELECT count(*) FROM predictions) / (2.0 * count(*)) AS w FROM predictions GROUP BY 1)"


@Q("a36_weighted_ce", f"WITH {_W} SELECT round(sum(w * -ln(greatest(CASE WHEN y_true = 1 THEN p_attack ELSE p_benign END, 1e-12))) / sum(w), 9) AS loss FROM predictions JOIN w ON c = y_true WHERE p_attack IS NOT NULL AND p_benign IS NOT NULL")
def weighted_ce(t: Tables) -> DataFrame:
    """Class-weighted cross-entropy of the stored probabilities."""
    n = t.predictions.groupBy("y_true").agg(n_rows().alias("n")).collect()  # one row a class
    total = sum(r["n"] for r in n)
    weight = F.lit(None).cast("double")
    for r in n:
        weight = F.when(F.col("y_true") == r["y_true"], total / (2.0 * r["n"])).otherwise(weight)
    known = t.predictions.where("p_attack IS NOT NULL AND p_benign IS NOT NULL")
    p = F.when(F.col("y_true") == 1, F.col("p_attack")).otherwise(F.col("p_benign"))
    return known.agg(F.round(M.weighted_cross_entropy(p, weight), 9).alias("loss"))


@Q("t8_argmax", "SELECT row_offset, CASE WHEN p_attack > p_benign THEN 1 ELSE 0 END AS y FROM predictions WHERE p_attack IS NOT NULL AND p_benign IS NOT NULL")
def argmax(t: Tables) -> DataFrame:
    """The class of highest probability, the first on ties."""
    known = t.predictions.where("p_attack IS NOT NULL AND p_benign IS NOT NULL")
    return known.select("row_offset", S.argmax(F.array("p_benign", "p_attack")).alias("y"))


@Q("f10_softmax", "SELECT row_offset, round(exp(p_attack) / (exp(p_attack) + exp(p_benign)), 9) AS s FROM predictions WHERE p_attack IS NOT NULL AND p_benign IS NOT NULL")
def softmax(t: Tables) -> DataFrame:
    """Softmax of two logits."""
    known = t.predictions.where("p_attack IS NOT NULL AND p_benign IS NOT NULL")
    return known.select("row_offset", F.round(S.softmax(F.array("p_benign", "p_attack"))[1], 9).alias("s"))


@Q("f17_scatter_classes", "SELECT row_offset, coalesce(p_benign, 0)::DOUBLE AS c0, 0::DOUBLE AS c1, coalesce(p_attack, 0)::DOUBLE AS c2 FROM predictions")
def scatter(t: Tables) -> DataFrame:
    """A model's classes laid into the full class vector, zeros elsewhere."""
    m = F.create_map(F.lit(0), F.col("p_benign"), F.lit(2), F.col("p_attack"))
    return t.predictions.select("row_offset", *[F.coalesce(F.try_element_at(m, F.lit(c)), F.lit(0.0)).alias(f"c{c}") for c in range(3)])


@Q("j7_prediction_rows", "SELECT count(*) AS matched, count(*) FILTER (WHERE p.y_true IS DISTINCT FROM f.Label) AS contradicting FROM predictions p JOIN full_splits f USING (source_row_id)")
def prediction_rows(t: Tables) -> DataFrame:
    """Stored predictions laid on their flows by row id."""
    j = t.predictions.select("source_row_id", "y_true").join(t.full_splits.select("source_row_id", "Label"), "source_row_id")
    return j.agg(n_rows().alias("matched"), F.count_if(~F.col("y_true").eqNullSafe(F.col("Label"))).alias("contradicting"))


@Q("k8_prediction_output", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY row_offset) - 1 AS i, count(*) OVER () AS n FROM predictions),
k AS (SELECT CASE WHEN j = 49 THEN (SELECT max(n) FROM r) - 1 ELSE CAST(floor(j * (((SELECT max(n) FROM r) - 1)::DOUBLE / 49)) AS BIGINT) END AS i FROM range(50) x(j))
SELECT row_offset, y_true, y_pred FROM r WHERE i IN (SELECT i FROM k)""")
def prediction_output(t: Tables) -> DataFrame:
    """A bounded output of 50 evenly spaced predictions."""
    rows = ordinals(t.predictions.select("row_offset", "y_true", "y_pred"), [], ["row_offset"], "i")
    return evenly_spaced(rows, "i", t.predictions.count(), 50).select("row_offset", "y_true", "y_pred")


@Q("a33_timing_windows", """
WITH w AS (SELECT avg(p_attack) AS m FROM predictions WHERE row_offset >= 50 GROUP BY (row_offset - 50) // 50 HAVING count(*) = 50), s AS (SELECT quantile_cont(m, 0.5) AS med FROM w)
SELECT 'all' AS run, count(*) AS windows, round(quantile_cont(m, 0.5), 9) AS median, round(quantile_cont(m, 0.9), 9) AS p90, round((SELECT quantile_cont(abs(m - med), 0.5) FROM w, s), 9) AS mad FROM w HAVING count(*) > 0""")
def timing(t: Tables) -> DataFrame:
    """Robust timing of full windows after a warm-up, on the predictions as a series of batches."""
    return R.timing_windows(t.predictions.withColumn("run", F.lit("all")), ["run"], "row_offset", "p_attack")


@Q("a39_interval_loss", "SELECT row_offset // 100 AS evaluation, round(sum(p_attack * (1 + row_offset % 3)) / sum(1 + row_offset % 3), 9) AS loss FROM predictions WHERE p_attack IS NOT NULL GROUP BY 1")
def interval_loss(t: Tables) -> DataFrame:
    """Loss per evaluation interval, weighted by the edges of its batches."""
    n = 1 + F.col("row_offset") % 3
    d = t.predictions.where("p_attack IS NOT NULL")
    return d.groupBy(F.floor(F.col("row_offset") / 100).alias("evaluation")).agg(F.round(F.sum(F.col("p_attack") * n) / F.sum(n), 9).alias("loss"))


_MODELS = ["edge_mlp", "sage", "sage_edge"]
_WIDE = "w AS (SELECT dataset, task, seed, " + ", ".join(f"max(test_macro_f1) FILTER (WHERE model = '{m}') AS {m}" for m in _MODELS) + " FROM u GROUP BY ALL)"


@Q("a20_pivot", f"WITH {_RUNS}, {_WIDE} SELECT * FROM w")
def pivot(t: Tables) -> DataFrame:
    """Scores by cell and model."""
    return R.wide(runs(t).where(F.col("model").isin(_MODELS)), _MODELS, "test_macro_f1")


_PAIRS = " UNION ALL ".join(f"SELECT dataset, task, seed, '{a}-{b}' AS contrast, round({a} - {b}, 9) AS delta FROM w" for a, b in R.MODEL_PAIRS)


@Q("a20_paired_deltas", f"WITH u AS (SELECT DISTINCT * FROM runs WHERE model <> 'random_forest'), {_WIDE} {_PAIRS}")
def deltas(t: Tables) -> DataFrame:
    """Contrasts of the models in each cell."""
    return R.paired_deltas(runs(t).where("model <> 'random_forest'"), R.MODEL_PAIRS, "test_macro_f1")


Q("r1_model_deltas", f"WITH u AS (SELECT DISTINCT * FROM runs WHERE model <> 'random_forest'), {_WIDE} {_PAIRS}")(deltas)

_TAB = (("edge_mlp", "random_forest"), ("sage", "random_forest"), ("sage_edge", "random_forest"))
_ALL = "w AS (SELECT dataset, task, seed, " + ", ".join(f"max(test_macro_f1) FILTER (WHERE model = '{m}') AS {m}" for m in [*_MODELS, "random_forest"]) + " FROM u GROUP BY ALL)"


@Q("r2_tabular_deltas", f"WITH {_RUNS}, {_ALL} " + " UNION ALL ".join(f"SELECT dataset, task, seed, '{a}-{b}' AS contrast, round({a} - {b}, 9) AS delta FROM w" for a, b in _TAB))
def tabular_deltas(t: Tables) -> DataFrame:
    """Contrasts of the relational models with the forest."""
    return R.paired_deltas(runs(t), _TAB, "test_macro_f1")


_CONDITIONS = {"RR": "edge_mlp", "RW": "sage", "WW": "sage_edge", "WR": "random_forest"}  # models stand for the conditions in the test data


@Q("r3_topology_deltas", f"WITH {_RUNS} " + " UNION ALL ".join(f"SELECT a.dataset, a.task, a.seed, 'RR-{c}' AS contrast, round(a.test_macro_f1 - b.test_macro_f1, 9) AS delta FROM u a JOIN u b USING (dataset, task, seed) WHERE a.model = 'edge_mlp' AND b.model = '{m}'" for c, m in _CONDITIONS.items() if c != "RR"))
def topology_deltas(t: Tables) -> DataFrame:
    """One condition less each other, aligned by key."""
    return R.condition_deltas({c: runs(t).where(F.col("model") == m) for c, m in _CONDITIONS.items()}, "RR", R.CELL, "test_macro_f1")


@Q("r4_budget_deltas", f"WITH {_RUNS} " + " UNION ALL ".join(f"SELECT a.dataset, a.task, a.model, '{n}pass-2pass' AS contrast, round(b.test_macro_f1 - a.test_macro_f1, 9) AS delta FROM u a JOIN u b USING (dataset, task, model) WHERE a.seed = 11 AND b.seed = {s}" for n, s in ((4, 23), (8, 37))))
def budget_deltas(t: Tables) -> DataFrame:
    """Larger budgets less the base, seeds standing for budgets in the test data."""
    k, u = ["dataset", "task", "model"], runs(t)
    base = u.where("seed = 11").select(*k, F.col("test_macro_f1").alias("b"))
    parts = [u.where(F.col("seed") == s).join(base, k).select(*k, F.lit(f"{n}pass-2pass").alias("contrast"), F.round(F.col("test_macro_f1") - F.col("b"), 9).alias("delta")) for n, s in ((4, 23), (8, 37))]
    return parts[0].unionByName(parts[1])


Q("j10_aligned_difference", f"WITH {_RUNS} SELECT a.dataset, a.task, a.seed, 'RR-RW' AS contrast, round(a.test_macro_f1 - b.test_macro_f1, 9) AS delta FROM u a JOIN u b USING (dataset, task, seed) WHERE a.model = 'edge_mlp' AND b.model = 'sage'")(
    lambda t: R.condition_deltas({c: runs(t).where(F.col("model") == _CONDITIONS[c]) for c in ("RR", "RW")}, "RR", R.CELL, "test_macro_f1")
)


@Q("r5_unmatched", f"WITH {_RUNS}, a AS (SELECT * FROM u WHERE model = 'sage'), b AS (SELECT * FROM u WHERE model = 'random_forest') SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.task, b.task) AS task, coalesce(a.seed, b.seed) AS seed FROM a FULL JOIN b ON a.dataset = b.dataset AND a.task = b.task AND a.seed = b.seed WHERE a.test_macro_f1 - b.test_macro_f1 IS NULL")
def unmatched(t: Tables) -> DataFrame:
    """Cells that cannot be contrasted."""
    u = runs(t)
    return R.unmatched(u.where("model = 'sage'"), u.where("model = 'random_forest'"), R.CELL, "test_macro_f1")


_METRICS = ["val_macro_f1", "test_macro_f1", "test_accuracy", "seconds_fit"]


@Q("a21_mean_std", f"WITH {_RUNS} SELECT dataset, task, model, count(*) AS n, " + ", ".join(f"round(avg({m}), 9) AS {m}_mean, round(stddev_samp({m}), 9) AS {m}_std" for m in _METRICS) + " FROM u GROUP BY ALL")
def mean_std(t: Tables) -> DataFrame:
    """Mean and sample deviation of the metrics over the seeds."""
    return R.summaries(runs(t), ["dataset", "task", "model"], _METRICS)


@Q("a40_extremes", f"WITH {_RUNS} SELECT dataset, task, model, count(test_macro_f1) AS n, round(avg(test_macro_f1), 9) AS mean, round(stddev_samp(test_macro_f1), 9) AS std, min(test_macro_f1) AS least, max(test_macro_f1) AS most FROM u GROUP BY ALL")
def extremes(t: Tables) -> DataFrame:
    """Count, mean, deviation and extremes by cell."""
    m = F.col("test_macro_f1")
    return runs(t).groupBy("dataset", "task", "model").agg(F.count(m).alias("n"), F.round(F.avg(m), 9).alias("mean"), F.round(F.stddev_samp(m), 9).alias("std"), F.min(m).alias("least"), F.max(m).alias("most"))


_DELTAS = f"u AS (SELECT DISTINCT * FROM runs WHERE model <> 'random_forest'), {_WIDE}, d AS ({_PAIRS})"


@Q("a22_effect_summary", f"WITH {_DELTAS} SELECT task, contrast, count(delta) AS n, round(avg(delta), 9) AS mean, round(stddev_samp(delta), 9) AS std, round(quantile_cont(delta, 0.5), 9) AS median, min(delta) AS least, max(delta) AS most, count(*) FILTER (WHERE delta > 0) AS positive, count(*) FILTER (WHERE delta < 0) AS negative, count(*) FILTER (WHERE delta = 0) AS zero FROM d GROUP BY ALL")
def effects(t: Tables) -> DataFrame:
    """Summary of the contrasts."""
    return R.effect_summary(deltas(t), ["task", "contrast"])


_CELLS = "c AS (SELECT dataset, task, model AS class, seed, test_macro_f1 AS f1, 40 * seed AS support FROM u)"


@Q("a23_rare_class", f"WITH {_RUNS}, {_CELLS} SELECT dataset, task, class, max(support) AS support, round(avg(f1), 9) AS f1_mean, round(stddev_samp(f1), 9) AS f1_std FROM c WHERE support < 1000 GROUP BY ALL")
def rare(t: Tables) -> DataFrame:
    """Low-support rows of a per-class table."""
    c = runs(t).select("dataset", "task", F.col("model").alias("class"), "seed", F.col("test_macro_f1").alias("f1"), (40 * F.col("seed")).alias("support"))
    return R.rare_classes(c, ["dataset", "task", "class"])


Q("r7_rare_class_table", f"WITH {_RUNS}, {_CELLS} SELECT dataset, task, class, max(support) AS support, round(avg(f1), 9) AS f1_mean, round(stddev_samp(f1), 9) AS f1_std FROM c WHERE support < 1000 GROUP BY ALL ORDER BY support, dataset, task, class")(
    lambda t: rare(t).orderBy("support", "dataset", "task", "class")
)


@Q("r6_per_class_long", f"WITH {_RUNS} " + " UNION ALL ".join(f"SELECT dataset, task, model, seed, '{m}' AS metric, {m} AS value FROM u" for m in ("test_macro_f1", "test_weighted_f1", "test_accuracy")))
def long_metrics(t: Tables) -> DataFrame:
    """Nested metrics as a long table: a map exploded."""
    names = ("test_macro_f1", "test_weighted_f1", "test_accuracy")
    m = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return runs(t).select(*KEY, F.explode(m).alias("metric", "value"))


@Q("a25_two_level_max", f"WITH {_RUNS} SELECT task, round(sum(top), 6) AS seconds FROM (SELECT task, dataset, max(seconds_fit) AS top FROM u GROUP BY ALL) GROUP BY 1")
def two_level(t: Tables) -> DataFrame:
    """Maximum by dataset, then summed."""
    top = runs(t).groupBy("task", "dataset").agg(F.max("seconds_fit").alias("top"))
    return top.groupBy("task").agg(F.round(F.sum("top"), 6).alias("seconds"))


@Q("a26_weighted_seconds", f"WITH {_RUNS} SELECT dataset, round(6 * sum(1.35 * seconds_fit + 2 * coalesce(best_epoch, 0)), 6) AS seconds FROM u GROUP BY 1")
def weighted_seconds(t: Tables) -> DataFrame:
    """Weighted sum of the cost of the runs."""
    return runs(t).groupBy("dataset").agg(F.round(6 * F.sum(1.35 * F.col("seconds_fit") + 2 * F.coalesce("best_epoch", F.lit(0))), 6).alias("seconds"))


@Q("a42_mean_std_by_class", f"WITH {_RUNS} SELECT dataset, model, round(avg(test_accuracy), 9) AS mean, round(stddev_samp(test_accuracy), 9) AS std FROM u GROUP BY ALL")
def mean_std_by_class(t: Tables) -> DataFrame:
    """Mean and sample deviation over the seeds."""
    return runs(t).groupBy("dataset", "model").agg(F.round(F.avg("test_accuracy"), 9).alias("mean"), F.round(F.stddev_samp("test_accuracy"), 9).alias("std"))


_BEST = "b AS (SELECT dataset, task, model, round(avg(test_macro_f1), 9) AS score FROM u GROUP BY ALL), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY dataset, task ORDER BY score DESC NULLS LAST, model) = 1)"


def best(t: Tables) -> DataFrame:
    mean = runs(t).groupBy("dataset", "task", "model").agg(F.round(F.avg("test_macro_f1"), 9).alias("score"))
    return R.best_rows(mean, ["dataset", "task"], [F.col("score").desc_nulls_last(), F.col("model")])


@Q("t4_best_model", f"WITH {_RUNS}, {_BEST} SELECT dataset, task, model, score FROM f")
def best_model(t: Tables) -> DataFrame:
    """The best model of each cell."""
    return best(t)


@Q("t4_win_counts", f"WITH {_RUNS}, {_BEST} SELECT model, count(*) AS wins FROM f GROUP BY 1")
def win_counts(t: Tables) -> DataFrame:
    """How many cells each model wins."""
    return best(t).groupBy("model").agg(n_rows().alias("wins"))


@Q("t14_leader", f"WITH {_RUNS}, b AS (SELECT dataset, model, round(avg(test_macro_f1), 9) AS score FROM u GROUP BY ALL) SELECT dataset, arg_max(model, score) AS leader FROM b GROUP BY 1")
def leader(t: Tables) -> DataFrame:
    """The model with the best mean."""
    mean = runs(t).groupBy("dataset", "model").agg(F.round(F.avg("test_macro_f1"), 9).alias("score"))
    return mean.groupBy("dataset").agg(F.max_by("model", "score").alias("leader"))


@Q("t9_early_stop", f"""
WITH {_RUNS}, h AS (SELECT dataset, task, model, seed, val_macro_f1 AS v, row_number() OVER w AS i, max(val_macro_f1) OVER (PARTITION BY dataset, task, model ORDER BY seed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u WINDOW w AS (PARTITION BY dataset, task, model ORDER BY seed)),
n AS (SELECT *, max(CASE WHEN coalesce(v > before, v IS NOT NULL) THEN i END) OVER (PARTITION BY dataset, task, model ORDER BY seed) AS last FROM h),
s AS (SELECT *, min(CASE WHEN i - last >= 2 THEN i END) OVER (PARTITION BY dataset, task, model) AS stop FROM n),
k AS (SELECT * FROM s WHERE stop IS NULL OR i <= stop)
SELECT dataset, task, model, first(seed ORDER BY v DESC NULLS LAST, i) AS best_step, max(v) AS best_score, max(seed) AS stopped_at FROM k GROUP BY ALL""")
def early_stop(t: Tables) -> DataFrame:
    """Early stopping with patience 2 over a series of scores, the seeds standing for steps."""
    return R.early_stop(runs(t), ["dataset", "task", "model"], "seed", "val_macro_f1", 2)


_NEAR = "n AS (SELECT *, max(val_macro_f1) OVER (PARTITION BY dataset, task) AS top FROM u)"


@Q("t10_choose", f"WITH {_RUNS}, {_NEAR} SELECT dataset, task, model, seed FROM n WHERE val_macro_f1 >= top - 0.005 QUALIFY row_number() OVER (PARTITION BY dataset, task ORDER BY seconds_fit, model, seed) = 1")
def choose(t: Tables) -> DataFrame:
    """Of the candidates near the best, the cheapest."""
    return R.tolerant_choice(runs(t), ["dataset", "task"], "val_macro_f1", ["seconds_fit", "model", "seed"]).select("dataset", "task", "model", "seed")


Q("m7_grid_choice", f"WITH u AS (SELECT DISTINCT * FROM runs WHERE model = 'sage_edge'), {_NEAR} SELECT dataset, task, model, seed FROM n WHERE val_macro_f1 >= top - 0.005 QUALIFY row_number() OVER (PARTITION BY dataset, task ORDER BY seconds_fit, seed) = 1")(
    lambda t: R.tolerant_choice(runs(t).where("model = 'sage_edge'"), ["dataset", "task"], "val_macro_f1", ["seconds_fit", "seed"]).select("dataset", "task", "model", "seed")
)

_AXES = {"dataset": ["NF-BoT-IoT-v2", "NF-ToN-IoT-v2"], "task": ["binary", "multiclass"], "model": _MODELS, "seed": [11, 22, 23]}


@Q("m8_missing_runs", "SELECT d.dataset, k.task, m.model, CAST(s.seed AS BIGINT) AS seed FROM (VALUES ('NF-BoT-IoT-v2'), ('NF-ToN-IoT-v2')) d(dataset), (VALUES ('binary'), ('multiclass')) k(task), (VALUES ('edge_mlp'), ('sage'), ('sage_edge')) m(model), (VALUES (11), (22), (23)) s(seed) WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.dataset = d.dataset AND r.task = k.task AND r.model = m.model AND r.seed = s.seed)")
def missing_runs(t: Tables) -> DataFrame:
    """Cells of a run matrix still to be run."""
    return R.missing_cells(_AXES, t.runs)


@Q("r15_eligible_matrix", "WITH flow , n AS (SELECT s.split, count(f.source_row_id) AS n FROM split_shares s LEFT JOIN flow f ON f.split = s.split AND f.Label = 1 GROUP BY 1) SELECT m.model, CAST(s.seed AS BIGINT) AS seed, (SELECT bool_and(n >= 30) FROM n) AS eligible FROM (VALUES ('edge_mlp'), ('sage'), ('sage_edge')) m(model), (VALUES (11), (22), (33), (44), (55)) s(seed)")
def eligible_matrix(t: Tables) -> DataFrame:
    """The matrix of models and seeds for a task, run only where every split has enough attacks."""
    one = t.flow.where("Label = 1").agg(F.least(*[F.count_if(F.col("split") == s) for s in SPLITS]).alias("n"))
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).cast("bigint").alias("seed")) for m in _MODELS for s in (11, 22, 33, 44, 55)])
    return one.select(F.explode(cells).alias("c"), (F.col("n") >= 30).alias("eligible")).select("c.model", "c.seed", "eligible")


@Q("r8_gate", """
WITH s AS (SELECT dataset, count(*) AS n, count(DISTINCT seed) AS seeds, max(seconds_fit) AS top, count(*) FILTER (WHERE test_macro_f1 IS NULL) AS unknown FROM runs GROUP BY 1),
r AS (SELECT dataset, concat_ws(',', CASE WHEN n <> 40 THEN 'rows' END, CASE WHEN seeds < 5 THEN 'seeds' END, CASE WHEN top > 300 THEN 'seconds' END, CASE WHEN unknown > 0 THEN 'scores' END) AS reasons FROM s)
SELECT dataset, reasons, reasons = '' AS safe FROM r""")
def gate(t: Tables) -> DataFrame:
    """Reasons against a launch; safe without any."""
    s = t.runs.groupBy("dataset").agg(n_rows().alias("n"), F.countDistinct("seed").alias("seeds"), F.max("seconds_fit").alias("top"), F.count_if(F.col("test_macro_f1").isNull()).alias("unknown"))
    why = S.reasons({"rows": F.col("n") != 40, "seeds": F.col("seeds") < 5, "seconds": F.col("top") > 300, "scores": F.col("unknown") > 0})
    return s.select("dataset", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("safe"))


@Q("r16_reusable_run", "SELECT dataset, count(*) >= 40 AND count(DISTINCT model) = 4 AND count(test_macro_f1) = count(*) AS reusable FROM runs GROUP BY 1")
def reusable(t: Tables) -> DataFrame:
    """Whether a stored benchmark is complete."""
    return t.runs.groupBy("dataset").agg(((n_rows() >= 40) & (F.countDistinct("model") == 4) & (F.count("test_macro_f1") == n_rows())).alias("reusable"))


@Q("r9_provenance_equal", f"WITH {_RUNS} SELECT a.dataset, count(*) FILTER (WHERE a.best_epoch IS NOT DISTINCT FROM b.best_epoch AND a.val_accuracy IS NOT DISTINCT FROM b.val_accuracy) AS equal, count(*) AS pairs FROM u a JOIN u b ON a.dataset = b.dataset AND a.task = b.task AND a.model = b.model WHERE a.seed = 11 AND b.seed = 23 GROUP BY 1")
def provenance_equal(t: Tables) -> DataFrame:
    """How many stored entries equal their counterpart in two columns, null being equal to null; `r9_entries_equal` compares all."""
    k, u = ["dataset", "task", "model"], runs(t)
    a, b = u.where("seed = 11").alias("a"), u.where("seed = 23").select(*k, F.col("best_epoch").alias("e"), F.col("val_accuracy").alias("v"))
    same = F.col("best_epoch").eqNullSafe(F.col("e")) & F.col("val_accuracy").eqNullSafe(F.col("v"))
    return a.join(b, k).groupBy("dataset").agg(F.count_if(same).alias("equal"), n_rows().alias("pairs"))


@Q("r11_replay_verdict", "SELECT model, count(*) FILTER (WHERE test_accuracy BETWEEN 0 AND 1) AS plausible, count(*) AS runs, bool_and(coalesce(test_macro_f1 <= 1, false)) AS ok FROM runs GROUP BY 1")
def replay_verdict(t: Tables) -> DataFrame:
    """Stored scores checked run by run for their range only; `r11_replay_predictions` recomputes."""
    return t.runs.groupBy("model").agg(F.count_if(F.col("test_accuracy").between(0, 1)).alias("plausible"), n_rows().alias("runs"), F.bool_and(F.coalesce(F.col("test_macro_f1") <= 1, F.lit(False))).alias("ok"))


_SCORED = ["seconds_fit", "best_epoch", *(f"{s}_{m}" for s in ("val", "test") for m in ("macro_f1", "weighted_f1", "accuracy"))]


@Q("r9_entries_equal", f"WITH {_RUNS} SELECT a.dataset, count(*) FILTER (WHERE {' AND '.join(f'a.{c} IS NOT DISTINCT FROM b.{c}' for c in _SCORED)}) AS equal, count(*) AS pairs FROM u a JOIN u b ON a.dataset = b.dataset AND a.task = b.task AND a.model = b.model WHERE a.seed = 11 AND b.seed = 23 GROUP BY 1")
def entries_equal(t: Tables) -> DataFrame:
    """How many stored entries equal their counterpart in all but the seed that is ignored, null being equal to null."""
    k, u = ["dataset", "task", "model"], runs(t)
    a, b = u.where("seed = 11"), u.where("seed = 23").select(*k, *[F.col(c).alias(f"_{c}") for c in _SCORED])
    same = S.both([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SCORED])
    return a.join(b, k).groupBy("dataset").agg(F.count_if(same).alias("equal"), n_rows().alias("pairs"))


_REPLAYED = ("accuracy", "macro_f1", "weighted_f1")
_SUM_OFF = 1e-6  # how far probabilities may sum from one


def _metrics_sql(name: str, y: str, p: str) -> str:
    counts = f"SELECT c AS class, count(*) FILTER (WHERE {y} = c) AS support, count(*) FILTER (WHERE {y} = c AND {p} = c) AS tp, count(*) FILTER (WHERE {y} <> c AND {p} = c) AS fp FROM (SELECT range::INT AS c FROM range(2)), j WHERE {y} IS NOT NULL AND {p} IS NOT NULL GROUP BY c"
    f1 = sql_ratio("2 * tp", "tp + fp + support")
    return f"{name} AS (SELECT {sql_ratio('sum(tp)', 'sum(support)')} AS {name}_accuracy, round(avg(f1), 9) AS {name}_macro_f1, {sql_ratio('sum(f1 * support)', 'sum(support)')} AS {name}_weighted_f1 FROM (SELECT *, {f1} AS f1 FROM ({counts})))"


_GATES = ("repeated", "clashes", "unknown_ids", "not_test", "wrong_groups", "wrong_truth", "unknown_probabilities", "off_sums", "wrong_predictions")


@Q("r11_replay_predictions", f"""
WITH flow , d AS (SELECT DISTINCT * FROM predictions),
j AS (SELECT d.*, f.source_row_id IS NOT NULL AS found, f.Label, f.split, {canon.group_key_sql('f.flow_group_id')} AS g, isfinite(p_benign) AND isfinite(p_attack) AS known,
  CASE WHEN isfinite(p_benign) AND isfinite(p_attack) THEN CASE WHEN p_attack > p_benign THEN 1 ELSE 0 END END AS y FROM d LEFT JOIN flow f USING (source_row_id)),
n AS (SELECT (SELECT count(*) FROM predictions) AS stored, (SELECT count(*) FROM predictions) - count(*) AS repeated, count(*) - count(DISTINCT row_offset) AS clashes, count(*) FILTER (WHERE NOT found) AS unknown_ids,
  count(*) FILTER (WHERE found AND split IS DISTINCT FROM 'test') AS not_test, count(*) FILTER (WHERE found AND {canon.group_key_sql('flow_group_id')} IS DISTINCT FROM g) AS wrong_groups, count(*) FILTER (WHERE found AND y_true IS DISTINCT FROM Label) AS wrong_truth,
  count(*) FILTER (WHERE known IS NOT TRUE) AS unknown_probabilities, count(*) FILTER (WHERE known AND abs(p_benign + p_attack - 1) > {_SUM_OFF}) AS off_sums, count(*) FILTER (WHERE known AND y_pred IS DISTINCT FROM y) AS wrong_predictions FROM j),
{_metrics_sql('stored', 'y_true', 'y_pred')}, {_metrics_sql('replayed', 'Label', 'y')}
SELECT n.*, s.*, r.*, {' AND '.join(f'{c} = 0' for c in _GATES)} AND {' AND '.join(f'coalesce(stored_{m} = replayed_{m}, false)' for m in _REPLAYED)} AS ok FROM n, stored s, replayed r""")
def replay_predictions(t: Tables) -> DataFrame:
    """Stored predictions against what their probabilities and the flows give: row ids, groups, labels, classes and metrics recomputed. Any difference, gap or repeat makes ok false.

    Groups are compared in canonical spelling. A row without a flow, a label or finite probabilities has no part in the replayed metrics; its count speaks against it. Ids of flows are unique.
    """
    known = ~nonfinite("p_benign") & ~nonfinite("p_attack")
    flow = t.flow.select("source_row_id", F.lit(True).alias("found"), "Label", "split", canon.group_key("flow_group_id").alias("g"))
    d = t.predictions.distinct().withColumns({"known": known, "y": F.when(known, S.argmax(F.array("p_benign", "p_attack")))})
    j = d.join(flow, "source_row_id", "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(b)
    found, known = F.col("found").isNotNull(), F.col("known")
    counts = {
        "clashes": n_rows() - F.countDistinct("row_offset"),
        "unknown_ids": F.count_if(~found),
        "not_test": F.count_if(found & differs("split", F.lit("test"))),
        "wrong_groups": F.count_if(found & ~canon.group_key("flow_group_id").eqNullSafe(F.col("g"))),
        "wrong_truth": F.count_if(found & differs("y_true", F.col("Label"))),
        "unknown_probabilities": F.count_if(~known),
        "off_sums": F.count_if(known & (F.abs(F.col("p_benign") + F.col("p_attack") - 1) > _SUM_OFF)),
        "wrong_predictions": F.count_if(known & differs("y_pred", F.col("y"))),
    }
    n = j.agg(n_rows().alias("_rows"), *[c.alias(k) for k, c in counts.items()])
    metrics = [M.summary(M.per_class(j.where(f"{y} IS NOT NULL AND {p} IS NOT NULL"), [0, 1], y, p)).select(*[F.col(m).alias(f"{name}_{m}") for m in _REPLAYED]) for name, y, p in (("stored", "y_true", "y_pred"), ("replayed", "Label", "y"))]
    one = beside(t.predictions.agg(n_rows().alias("stored")), n, *metrics).withColumn("repeated", F.col("stored") - F.col("_rows"))
    same = [F.coalesce(F.col(f"stored_{m}") == F.col(f"replayed_{m}"), F.lit(False)) for m in _REPLAYED]
    ok = S.both([*[F.col(c) == 0 for c in _GATES], *same])
    return one.select("stored", *_GATES, *[f"{name}_{m}" for name in ("stored", "replayed") for m in _REPLAYED], ok.alias("ok"))


@Q("f8_step_budget", "WITH flow , n AS (SELECT Dataset, count(*) AS n FROM flow WHERE split = 'train' GROUP BY 1) SELECT Dataset, CAST(ceil(n / 256.0) AS BIGINT) AS per_pass, greatest(20, 2 * CAST(ceil(n / 256.0) AS BIGINT)) AS steps FROM n")
def step_budget(t: Tables) -> DataFrame:
    """Steps of a run from the rows of train."""
    n = t.flow.where("split = 'train'").groupBy("Dataset").agg(n_rows().alias("n"))
    b = F.lit(256)
    return n.select("Dataset", S.steps_per_pass(F.col("n"), b).alias("per_pass"), S.step_budget(F.col("n"), b, F.lit(2), F.lit(20)).alias("steps"))


@Q("f9_validation_count", "SELECT seed, CAST(1 + CASE WHEN 1000 > seed THEN ceil((1000 - seed) / 70.0) ELSE 0 END AS BIGINT) AS evaluations FROM (SELECT DISTINCT seed FROM runs)")
def validation_count(t: Tables) -> DataFrame:
    """Evaluations of a run of 1000 steps whose first pass takes `seed` of them."""
    return t.runs.select("seed").distinct().select("seed", S.validation_count(F.lit(1000), F.col("seed"), F.lit(70)).alias("evaluations"))


@Q("f15_units", f"WITH {_RUNS} SELECT dataset, round(sum(seconds_fit) / 3600, 9) AS hours, round(sum(seconds_fit) / 86400, 9) AS days, sum(seconds_fit) / 86400 > 14 AS too_long FROM u GROUP BY 1")
def units(t: Tables) -> DataFrame:
    """Seconds as hours and days, and a threshold."""
    s = F.sum("seconds_fit")
    return runs(t).groupBy("dataset").agg(F.round(s / 3600, 9).alias("hours"), F.round(s / 86400, 9).alias("days"), (s / 86400 > 14).alias("too_long"))


@Q("f16_mean_std_text", f"WITH {_RUNS} SELECT dataset, task, model, printf('%.4f ± %.4f', avg(test_macro_f1), stddev_samp(test_macro_f1)) AS shown FROM u GROUP BY ALL")
def mean_std_text(t: Tables) -> DataFrame:
    """Mean and deviation as text."""
    return runs(t).groupBy("dataset", "task", "model").agg(F.format_string("%.4f ± %.4f", F.avg("test_macro_f1"), F.stddev_samp("test_macro_f1")).alias("shown"))


@Q("j11_run_manifest", "WITH n AS (SELECT Dataset, count(*) AS rows FROM full_splits GROUP BY 1) SELECT r.dataset, r.task, r.model, r.seed, n.rows FROM runs r LEFT JOIN n ON n.Dataset = r.dataset")
def run_manifest(t: Tables) -> DataFrame:
    """Runs with the rows of their Dataset."""
    n = t.full_splits.groupBy(F.col("Dataset").alias("d")).agg(n_rows().alias("rows"))
    return t.runs.join(n, F.col("dataset") == F.col("d"), "left").select(*KEY, "rows")


@Q("s13_run_key_check", "SELECT dataset, task, model, seed, count(*) AS n FROM runs GROUP BY ALL HAVING count(*) > 1")
def run_key_check(t: Tables) -> DataFrame:
    """Keys of the run table that repeat."""
    return t.runs.groupBy(*KEY).agg(n_rows().alias("n")).where("n > 1")


QUERIES, SQL = Q.queries, Q.sql
