"""Models on the flow table; none of these can be written in SQL, so tests check them against plain NumPy."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom import schema
from flowloom.functions import canon
from flowloom.functions.scalar import argmax
from flowloom.operators import graph as G
from flowloom.operators import metrics as M
from flowloom.operators import models as L
from flowloom.operators.features import Preprocessor
from flowloom.operators.forest import forest_scores
from flowloom.plans.registry import Registry, Tables
from flowloom.session import materialize, shared_dir

Q = Registry()


DROPOUT = 0.2
_MODELS: dict[tuple, L.Sage] = {}  # a few models of this session, some ten thousand numbers each


def prepared(t: Tables, *kept: str, task: str = "binary") -> tuple[Preprocessor, DataFrame]:
    """Complete rows with x and y, standardised by train; rows of classes that train does not have are left out."""
    known = t.flow.where(" AND ".join(f"{c} IS NOT NULL" for c in schema.FEATURES)).where("Label IN (0, 1) AND split IS NOT NULL")
    if task == "multiclass":
        known = known.withColumn("Attack", canon.word_key("Attack")).where("Attack IS NOT NULL")
    p = Preprocessor.fit(known.where("split = 'train'"), list(schema.FEATURES), task)
    if task == "multiclass":
        known = known.where(F.col("Attack").isin(p.classes))
    return p, p.labels(p.transform(known)).select("source_row_id", "split", "x", "y", *kept)


def _weights(train: DataFrame, classes: int = 2) -> list[float]:
    n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    return [sum(n.values()) / (classes * n[c]) if n.get(c) else 0.0 for c in range(classes)]


def _scores(pred: DataFrame, classes: int = 2) -> DataFrame:
    return M.summary(M.per_class(pred.select(F.col("y").alias("y_true"), argmax(F.col("p")).alias("y_pred")), list(range(classes))))


def _trained_perceptron(t: Tables, task: str) -> tuple[L.Perceptron, DataFrame, int]:
    """A perceptron trained on train with dropout, the weights of best macro F1 on val kept; with the prepared rows and the number of classes."""
    p, rows = prepared(t, task=task)
    rows = materialize(rows, "rows")
    train, val, k = rows.where("split = 'train'"), rows.where("split = 'val'"), len(p.classes)
    model = L.Perceptron.start(len(schema.FEATURES), k, 11)
    model.fit(train, _weights(train, k), steps=20, dropout=DROPOUT, evaluate=lambda: _scores(model.probabilities(val), k).first()["macro_f1"] or 0.0, every=5)
    return model, rows, k


@Q("m1_perceptron")
def perceptron(t: Tables) -> DataFrame:
    """A perceptron trained on train, chosen on val and scored on val and test."""
    model, rows, _ = _trained_perceptron(t, "binary")
    return _scores(model.probabilities(rows.where("split <> 'train'")))


@Q("m1_multiclass")
def multiclass(t: Tables) -> DataFrame:
    """The same over all classes that train has, scored on test."""
    model, rows, k = _trained_perceptron(t, "multiclass")
    return _scores(model.probabilities(rows.where("split = 'test'")), k)


@Q("r11_replay_model")
def replay_model(t: Tables) -> DataFrame:
    """Weights and test probabilities are stored, the weights are read back and score again: rows matched, unmatched, and whether no probability is off."""
    model, rows, _ = _trained_perceptron(t, "binary")
    test = rows.where("split = 'test'")
    path = f"{shared_dir(t.spark)}/flowloom-weights-{uuid.uuid4().hex}"
    L.save_weights(t.spark, model.weights, path)
    named = lambda m: m.probabilities(test).select("source_row_id", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"))
    stored = materialize(named(model), "stored")
    again = named(L.Perceptron(**L.load_weights(t.spark, path)))
    e = M.replay_error(stored, again, "source_row_id", ["p0", "p1"])
    return e.select("matched", "unmatched", (F.coalesce("max_error", F.lit(0.0)) < 1e-6).alias("equal"))


def _edges(rows: DataFrame, split: str, rewire: bool = False, *kept: str) -> DataFrame:
    rows = rows.where(F.col("split") == split)
    return materialize(G.label_edges(G.rewired(rows) if rewire else rows, "x", *kept), "edges")


def _graphs(t: Tables) -> DataFrame:
    return prepared(t, *schema.ENDPOINTS, "Dataset")[1]


def _context(edges: DataFrame) -> DataFrame:
    """A graph's part of the scores; the model lends its sizes only."""
    return L.Sage(len(schema.FEATURES), 2, 11).context(G.message_edges(edges.select("source_row_id", "src", "dst", "x")))


def _model(t: Tables, rows: DataFrame, use_edge: bool = False, rewire: bool = False, val: tuple[DataFrame, DataFrame] | None = None) -> L.Sage:
    """Two layers trained by one pass over the graph of train, as it is or rewired, the weights of least error on val kept; once a session and folder.

    val: its edges and their context, if they are there already.
    """
    key = (t.spark.sparkContext.applicationId, t.sf_dir, use_edge, rewire)
    if key not in _MODELS:
        edges = _edges(rows, "train", rewire, "y")
        if val is None:
            val = (e := _edges(rows, "val", rewire, "y"), _context(e))
        model = L.Sage(len(schema.FEATURES), 2, 11, use_edge)

        def score() -> float:
            return _scores(model.scored(*val, "y")).first()["macro_f1"] or 0.0

        L.fit_sage(model, edges, G.message_edges(edges.drop("y")), _weights(edges), passes=1, batch_size=1024, together=4, dropout=DROPOUT, evaluate=score, every=64)
        _MODELS[key] = model
    return _MODELS[key]


def _sage(t: Tables, use_edge: bool, split: str = "test") -> DataFrame:
    rows = _graphs(t)
    edges = _edges(rows, split)
    return _model(t, rows, use_edge).scored(edges, _context(edges))


@Q("g5_sage_forward")
def sage(t: Tables) -> DataFrame:
    """Both layers and the head over the graph of test, with trained weights."""
    return _sage(t, False).select("source_row_id", F.round(F.col("p")[1].cast("double"), 3).alias("p_attack"))


@Q("g3_sage_edge_forward")
def sage_edge(t: Tables) -> DataFrame:
    """The same with the edge's own features in the head."""
    return _sage(t, True).select("source_row_id", F.round(F.col("p")[1].cast("double"), 3).alias("p_attack"))


@Q("g6_chunked_inference")
def chunked(t: Tables) -> DataFrame:
    """Inference over val in one partition and in many: partitions take the place of chunks, so the results must agree."""
    rows = _graphs(t)
    edges, model = _edges(rows, "val"), _model(t, rows)
    one, many = (model.edge_probabilities(edges.repartition(n), G.message_edges(edges.repartition(n))).select("source_row_id", F.col("p")[1].alias(f"p{n}")) for n in (1, 23))
    return one.join(many, "source_row_id").agg(F.count(F.lit(1)).alias("rows"), (F.max(F.abs(F.col("p1") - F.col("p23"))) < 1e-4).alias("equal"))


@Q("m9_rewired_scores")
def rewired_scores(t: Tables) -> DataFrame:
    """Weights trained on the graph of train as it is (R) or rewired (W), each scored on val as it is or rewired: RR, RW, WR and WW."""
    rows = _graphs(t)
    edges = [_edges(rows, "val", scored, "y") for scored in (False, True)]
    val, parts = [(e, _context(e)) for e in edges], []
    for trained in (False, True):
        model = _model(t, rows, rewire=trained, val=val[trained])
        for scored in (False, True):
            parts.append(_scores(model.scored(*val[scored], "y")).select(F.lit("RW"[trained] + "RW"[scored]).alias("condition"), "macro_f1", "accuracy"))
    return reduce(DataFrame.unionByName, parts)


@Q("m6_unlabelled")
def unlabelled(t: Tables) -> DataFrame:
    """Scores of the late delivery, which needs no labels: its rows without a missing feature are the graph's context."""
    p, rows = prepared(t, *schema.ENDPOINTS, "Dataset")
    late = t.late_flows.drop("Label", "Attack").where(" AND ".join(f"{c} IS NOT NULL" for c in schema.FEATURES)).dropDuplicates(["source_row_id"])
    edges = materialize(G.label_edges(p.transform(late), "x"), "edges")
    return _model(t, rows).scored(edges, _context(edges)).select("source_row_id", argmax(F.col("p")).alias("y_pred"))


@Q("m2_sage_training")
def sage_training(t: Tables) -> DataFrame:
    """One pass of mini-batch training with dropout over the graph of train: the mean loss before each step."""
    edges = _edges(_graphs(t), "train", False, "y")
    model = L.Sage(len(schema.FEATURES), 2, 11)
    losses = L.fit_sage(model, edges, G.message_edges(edges.drop("y")), _weights(edges), passes=1, batch_size=1024, together=16, dropout=DROPOUT)
    return t.spark.createDataFrame([(i, float(v)) for i, v in enumerate(losses)], "step int, loss double")


_GRID = [(size, fanout) for size in (2048, 4096) for fanout in ((10, 5), (15, 10))]


@Q("m7_grid")
def grid(t: Tables) -> DataFrame:
    """Batch size and fanout: each is trained for one pass and scored on val."""
    known = _graphs(t)
    edges, val = _edges(known, "train", False, "y"), _edges(known, "val", False, "y")
    context, weights, rows = _context(val), _weights(edges), []
    for size, fanout in _GRID:
        model = L.Sage(len(schema.FEATURES), 2, 11)
        losses = L.fit_sage(model, edges, G.message_edges(edges.drop("y")), weights, passes=1, batch_size=size, fanout=fanout, dropout=DROPOUT)
        got = _scores(model.scored(val, context, "y")).first()
        rows.append((size, *fanout, len(losses), float(got["macro_f1"] or 0.0)))
    return t.spark.createDataFrame(rows, "batch_size int, first_hop int, second_hop int, steps int, val_macro_f1 double")


def _forest(t: Tables, trees: int, depth: int, least: int) -> DataFrame:
    _, rows = prepared(t)
    rows = materialize(rows, "rows")
    train = rows.where("split = 'train'")
    w = _weights(train)
    model = L.fit_forest(train.withColumn("w", F.when(F.col("y") == 0, w[0]).otherwise(w[1])), "x", "y", "w", trees, depth, least=least)
    return _scores(model.transform(_features(rows.where("split = 'test'"))).withColumn("p", vector_to_array("probability")))


@Q("m3_random_forest")
def forest(t: Tables) -> DataFrame:
    """A balanced forest of 25 trees of depth 16 trained on train and scored on test."""
    return _forest(t, 25, 16, 1)


@Q("m3_pilot_forest")
def pilot_forest(t: Tables) -> DataFrame:
    """The pilot's form: 100 trees with at least two rows a leaf, as deep as 20. They grow in the tasks: so many deep trees do not fit in a driver."""
    rows = materialize(prepared(t)[1], "rows")
    train = rows.where("split = 'train'")
    return _scores(forest_scores(train, rows.where("split = 'test'"), _weights(train), trees=100, depth=20, least=2))


def _features(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col("x").cast("array<double>")))


@Q("m4_forest_traverse")
def traverse(t: Tables) -> DataFrame:
    """An exported forest's vectorised traversal against the library's own scores: the largest difference."""
    _, rows = prepared(t)
    rows = materialize(rows, "rows")
    model = L.fit_forest(rows.where("split = 'train'"), "x", "y", None, trees=10, depth=6)
    arrays = L.export_forest(model, f"{shared_dir(t.spark)}/flowloom-forest-{uuid.uuid4().hex}")
    ours = L.forest_probabilities(rows.where("split = 'test'"), arrays).select("source_row_id", F.col("p")[1].alias("p"))
    theirs = model.transform(_features(rows.where("split = 'test'"))).select("source_row_id", vector_to_array("probability")[1].alias("q"))
    return ours.join(theirs, "source_row_id").agg(F.count(F.lit(1)).alias("rows"), (F.max(F.abs(F.col("p") - F.col("q"))) < 1e-6).alias("equal"))


QUERIES, SQL = Q.queries, Q.sql
