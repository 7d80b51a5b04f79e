"""Models on flows: multi-layer perceptron, two-layer edge-aware message passing, forests.

Scoring is NumPy on Arrow batches with weights that travel with the task. Training of the perceptron is data-parallel: every step sums the
gradients of all partitions; message passing takes its steps one after the other in a task. Scoring aggregates features over neighbours in the JVM, states in NumPy.
"""

from __future__ import annotations

import io
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.hashing import digest, hash60
from flowloom.operators.skew import ordinals, ranged
from flowloom.session import discard, materialize

HIDDEN = 128


def _matrix(rng: np.random.Generator, rows: int, cols: int) -> np.ndarray:
    return rng.normal(0, np.sqrt(2 / (rows + cols)), (rows, cols))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def stacked(column) -> np.ndarray:
    """An Arrow or pandas column of equally long lists as a matrix."""
    if isinstance(column, (pa.Array, pa.ChunkedArray)):
        flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
        return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return np.stack([np.asarray(x, float) for x in column]) if len(column) else np.zeros((0, 0))


def lists(m: np.ndarray, kind=None) -> pa.Array:
    """A matrix as an Arrow column of lists."""
    kind = kind or pa.float32()
    flat = pa.array(np.ascontiguousarray(m).ravel(), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), flat)


def with_array(df: DataFrame, inputs: list[str], name: str, f) -> DataFrame:
    """df with `name`, an array<float> that f computes from the matrices of the input columns, batch by batch."""
    kept = [c for c in df.columns if c != name]
    schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in kept) + f", `{name}` array<float>"

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = f(*[stacked(b.column(b.schema.get_field_index(c))) for c in inputs])
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], lists(out)], names=[*kept, name])

    return df.mapInArrow(run, schema)


def kept_units(rng: np.random.Generator, shape: tuple[int, int], dropout: float, kind=np.float64) -> np.ndarray | float:
    """Which units are kept, scaled so that their expectation stays."""
    return (rng.random(shape, kind) >= dropout).astype(kind) * kind(1 / (1 - dropout)) if dropout else 1.0


class Best:
    """The weights with the best score so far: the first of equal scores."""

    def __init__(self, parts: Callable[[], list[np.ndarray]], evaluate: Callable[[], float] | None):
        self.parts, self.evaluate, self.score, self.step, self.kept = parts, evaluate, -np.inf, 0, None

    def after(self, step: int, due: bool) -> None:
        if self.evaluate and due:
            score = self.evaluate()
            if score > self.score:
                self.score, self.step, self.kept = score, step, [a.copy() for a in self.parts()]

    def restore(self) -> None:
        for a, b in zip(self.parts(), self.kept or [], strict=False):
            a[...] = b


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    """A model's arrays as a small Parquet table; an existing one is not overwritten."""
    rows = [(k, list(a.shape), [float(v) for v in a.ravel()]) for k, a in sorted(weights.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1).write.parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.asarray(r["data"], float).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


@dataclass
class Perceptron:
    """One hidden layer with rectifier; weights drawn from a seed until they are trained."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def start(cls, inputs: int, classes: int, seed: int, hidden: int = HIDDEN) -> Perceptron:
        rng = np.random.default_rng(seed)
        return cls(_matrix(rng, inputs, hidden), np.zeros(hidden), _matrix(rng, hidden, classes), np.zeros(classes))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, df: DataFrame, vector: str = "x", name: str = "p") -> DataFrame:
        return with_array(df, [vector], name, lambda x: softmax(self.logits(x.astype(float))))

    def gradients(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, mask: np.ndarray | float = 1.0) -> np.ndarray:
        """Loss, weight and gradient sums of weighted cross-entropy, flat; the mask scales hidden units (dropout)."""
        raw = x @ self.w1 + self.b1
        h = np.maximum(raw, 0) * mask
        p = softmax(h @ self.w2 + self.b2)
        rows = np.arange(len(y))
        loss = -(w * np.log(np.maximum(p[rows, y], 1e-12))).sum()
        p[rows, y] -= 1
        p *= w[:, None]
        back = (p @ self.w2.T) * (raw > 0) * mask
        return np.concatenate([[loss, w.sum()], (x.T @ back).ravel(), back.sum(0), (h.T @ p).ravel(), p.sum(0)])

    @property
    def weights(self) -> dict[str, np.ndarray]:
        return {"w1": self.w1, "b1": self.b1, "w2": self.w2, "b2": self.b2}

    def _parts(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2]

    def fit(self, df: DataFrame, weights: list[float], steps: int = 50, rate: float = 1e-2, vector: str = "x", label: str = "y", dropout: float = 0.0, seed: int = 11, evaluate: Callable[[], float] | None = None, every: int = 10) -> list[float]:
        """Adam over full passes; returns the mean loss before each step. Each partition sends one gradient, summed by Spark.

        With `evaluate`, a score of the weights as they stand, it is asked after every so many steps and after the last; the best weights are kept.
        """
        size = sum(a.size for a in self._parts())
        first, second, losses, best = np.zeros(size), np.zeros(size), [], Best(self._parts, evaluate)
        data = df.select(vector, label)
        if data.isEmpty():
            raise ValueError("no rows to train on")
        for step in range(1, steps + 1):
            model, cw = self, np.asarray(weights)

            def run(batches, model=model, cw=cw, step=step):
                total = None
                rng = np.random.default_rng([seed, step, TaskContext.get().partitionId()])
                for b in batches:
                    if b.num_rows:
                        y = b.column(1).to_numpy(zero_copy_only=False).astype(int)
                        g = model.gradients(stacked(b.column(0)).astype(float), y, cw[y], kept_units(rng, (len(y), len(model.b1)), dropout))
                        total = g if total is None else total + g
                if total is not None:
                    yield pa.RecordBatch.from_arrays([lists(total[None], pa.float64())], names=["g"])

            summed = data.mapInArrow(run, "g array<double>").agg(Summarizer.sum(array_to_vector("g")).alias("g")).first()["g"]
            g = summed.toArray()
            losses.append(g[0] / g[1])
            d = g[2:] / g[1]
            first, second = 0.9 * first + 0.1 * d, 0.999 * second + 0.001 * d * d
            move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            at = 0
            for a in self._parts():
                a -= move[at : at + a.size].reshape(a.shape)
                at += a.size
            best.after(step, step % every == 0 or step == steps)
        best.restore()
        return losses


@dataclass
class Sage:
    """Two message-passing layers and an edge head. Messages are linear, so their inputs are averaged before the matrix is applied.

    With `use_edge` the head sees the edge's own features too. Weights are drawn from a seed.
    """

    features: int
    classes: int
    seed: int
    use_edge: bool = False
    hidden: int = HIDDEN
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        rng, f, h = np.random.default_rng(self.seed), self.features, self.hidden
        if not self.weights:
            self.weights = {"m1": _matrix(rng, 2 * f, h), "a1": _matrix(rng, f + h, h), "m2": _matrix(rng, h + f, h), "a2": _matrix(rng, 2 * h, h), "s": _matrix(rng, h, self.classes), "d": _matrix(rng, h, self.classes), "e": _matrix(rng, f, self.classes)}
            self.weights |= {"bm1": rng.normal(0, 0.1, h), "ba1": rng.normal(0, 0.1, h), "bm2": rng.normal(0, 0.1, h), "ba2": rng.normal(0, 0.1, h), "b": rng.normal(0, 0.1, self.classes)}

    def layer(self, n: int, own: np.ndarray, mean: np.ndarray, degree: np.ndarray) -> np.ndarray:
        """A node's next state from its own and the mean of its incoming messages' inputs; without any, the message is 0."""
        w = self.weights
        message = (mean @ w[f"m{n}"] + w[f"bm{n}"]) * (degree > 0)
        return np.maximum(np.concatenate([own, message], 1) @ w[f"a{n}"] + w[f"ba{n}"], 0)

    def context(self, messages: DataFrame, vector: str = "x") -> DataFrame:
        """What the states of a graph's nodes need, whatever the weights: (node, parts, c, degree, z), written once and ordered by node.

        A node has a row of its own (c = 0, parts the number of all its rows) and one for each source of its messages (parts = 0, c messages). z is the mean
        of the features of the messages into that row's node or source, of which there are `degree`. messages: src, dst and the features, in both
        directions, so every node has an incoming edge or is its own source. A hub's rows are spread over partitions, as they are ordered by source too.
        """
        f = self.features
        every = messages.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        sums = [F.sum(F.col(vector)[i].cast("double")).alias(f"_{i}") for i in range(f)]
        means = messages.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).cast("int").alias("degree"), *sums)
        means = means.select("node", "degree", F.array(*[(F.col(f"_{i}") / F.col("degree")).cast("float") for i in range(f)]).alias("z"))
        zero = F.array_repeat(F.lit(0.0).cast("float"), f)
        nodes = materialize(every.join(means, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("z", zero).alias("z")), "nodes")
        pairs = materialize(messages.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("int").alias("c")), "pairs")
        sources = pairs.groupBy(F.col("dst").alias("node")).agg((F.count(F.lit(1)) + 1).cast("int").alias("parts"))
        own = nodes.join(sources, "node", "left").select("node", F.lit(None).cast("string").alias("_src"), F.coalesce("parts", F.lit(1)).alias("parts"), F.lit(0).alias("c"), "degree", "z")
        into = pairs.join(nodes.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.col("src").alias("_src"), F.lit(0).alias("parts"), "c", "degree", "z")
        out = materialize(ranged(own.unionByName(into), ["node"], ["_src"]).drop("_src"), "context")
        for df in (nodes, pairs):
            discard(df)
        return out

    def _second(self, first: np.ndarray, mean: np.ndarray, z: np.ndarray, degree: np.ndarray) -> np.ndarray:
        """Shares of the logits that a node has for the edges that leave and that reach it."""
        h = self.layer(2, first, np.concatenate([mean, z], 1), degree)
        return np.concatenate([h @ self.weights["s"], h @ self.weights["d"]], 1)

    def _first(self, z: np.ndarray, degree: np.ndarray) -> np.ndarray:
        ones = np.ones((len(z), self.features))
        return self.layer(1, ones, np.concatenate([ones, z], 1), degree)

    def shares(self, context: DataFrame) -> DataFrame:
        """(node, sd): each node's shares of the logits as source and as destination, `classes` numbers each, after both layers.

        Rows of a node that an Arrow batch has all of are finished there; of others, the sum of the sources' states is added up afterwards.
        """
        kind = "node string, sd array<float>, sum array<double>, c bigint, degree int, z array<float>"

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                node, parts, c, degree, z = (b.column(i) for i in range(5))
                parts, c, degree, z = parts.to_numpy(), c.to_numpy().astype(np.int64), degree.to_numpy(), stacked(z).astype(float)
                start = np.flatnonzero(np.concatenate([[True], ~pc.equal(node[1:], node[:-1]).to_numpy(zero_copy_only=False)]))
                h = self._first(z, degree[:, None])
                total, count, rows = np.add.reduceat(h * c[:, None], start), np.add.reduceat(c, start), np.diff(np.append(start, b.num_rows))
                at = np.searchsorted(start, np.arange(b.num_rows), "right") - 1
                own = np.full(len(start), -1)
                mine = np.flatnonzero(parts > 0)
                own[at[mine]] = mine
                whole = (own >= 0) & (parts[own] == rows)
                w, o = np.flatnonzero(whole), own[whole]
                names = node.take(pa.array(start))
                sd = self._second(h[o], total[w] / np.maximum(count[w], 1)[:, None], z[o], degree[o][:, None])
                none = lambda n, t: pa.nulls(n, t)
                floats, doubles = pa.list_(pa.float32()), pa.list_(pa.float64())
                names_of = ["node", "sd", "sum", "c", "degree", "z"]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(w)), lists(sd), none(len(w), doubles), none(len(w), pa.int64()), none(len(w), pa.int32()), none(len(w), floats)], names=names_of)
                q = np.flatnonzero(~whole)
                if len(q):
                    has = own[q] >= 0
                    zs = pa.array([z[i].astype(np.float32) if i >= 0 else None for i in own[q]], floats)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), none(len(q), floats), lists(total[q], pa.float64()), pa.array(count[q]), pa.array(degree[own[q]], pa.int32(), mask=~has), zs], names=names_of)

        done = materialize(context.mapInArrow(run, kind), "shares")
        torn = done.where("sd IS NULL").groupBy("node").agg(vector_to_array(Summarizer.sum(array_to_vector("sum"))).cast("array<float>").alias("sum"), F.sum("c").alias("c"), F.max("degree").alias("degree"), F.max("z").alias("z"))
        torn = torn.select("node", F.array(F.greatest("c", F.lit(1)).cast("float")).alias("c"), F.array(F.col("degree").cast("float")).alias("degree"), "sum", "z")
        torn = with_array(torn, ["c", "degree", "sum", "z"], "sd", lambda c, d, m, z: self._second(self._first(z, d), m / c, z, d))
        return done.where("sd IS NOT NULL").select("node", "sd").unionByName(torn.select("node", "sd"))

    def scored(self, edges: DataFrame, context: DataFrame, *kept: str, vector: str = "x") -> DataFrame:
        """(source_row_id, *kept, p) of edges whose graph has that context. The head is linear, so nodes send it their share of the logits instead of a state."""
        w, c, shares = self.weights, self.classes, self.shares(context)
        a = shares.select(F.col("node").alias("src"), F.slice("sd", 1, c).alias("from_src"))
        b = shares.select(F.col("node").alias("dst"), F.slice("sd", c + 1, c).alias("from_dst"))
        inputs = ["from_src", "from_dst", *([vector] if self.use_edge else [])]
        j = edges.select("source_row_id", "src", "dst", *kept, *inputs[2:]).join(a, "src").join(b, "dst").select("source_row_id", *kept, *inputs)
        return with_array(j, inputs, "p", lambda s, d, *x: softmax(s + d + w["b"] + (x[0] @ w["e"] if x else 0.0))).select("source_row_id", *kept, "p")

    def edge_probabilities(self, edges: DataFrame, messages: DataFrame, vector: str = "x") -> DataFrame:
        """(source_row_id, p)."""
        return self.scored(edges, self.context(messages, vector), vector=vector)


def _samples(messages: DataFrame, fanout: tuple[int, int], seed: int) -> tuple[DataFrame, DataFrame]:
    """The samples that batches choose from: (dst, degree), and (dst, k, g, source_row_id, src), the edges of the g-th sample of at most k edges into a node.

    The edges into a node are put in a hashed order and cut into groups of k; the last group is filled up with those before it, so each sample has k edges
    and each edge the same chance. Of a node with at most k edges the one sample has all, and stands for all fanouts (k = 0) if it is within the least.
    """
    least = min(fanout)
    into = messages.select("source_row_id", "src", "dst", "reverse")
    degree = materialize(into.groupBy("dst").agg(F.count(F.lit(1)).alias("degree")), "degree")
    few = degree.where(F.col("degree") <= least).select("dst")
    many = degree.where(F.col("degree") > least)
    whole = into.join(few, "dst").select("dst", F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("g"), "source_row_id", "src")
    edge = digest(F.concat_ws("|", F.col("source_row_id").cast("string"), F.col("reverse").cast("string")), seed)
    placed = ordinals(into.join(many.select("dst"), "dst", "left_semi").withColumn("_h", edge), ["dst"], ["_h", "source_row_id", "reverse"], "_no").join(many, "dst")

    def groups(k: int) -> Column:
        no, n = F.col("_no"), F.col("degree")
        full, last = F.floor(n / k), F.floor((n - 1) / k)
        return F.array_compact(F.array(F.when(F.floor(no / k) < full, F.floor(no / k)), F.when((full <= last) & (no >= n - F.least(n, F.lit(k))), last)))

    parts = [placed.select("dst", F.lit(k).alias("k"), F.explode(groups(k)).alias("g"), "source_row_id", "src") for k in sorted({*fanout})]
    return degree, reduce(DataFrame.unionByName, [whole, *parts])


def _sought(frontier: DataFrame, degree: DataFrame, k: int, least: int, hop: int, seed: int) -> DataFrame:
    """(batch, dst, k, g): the sample that each node of a batch gets, by hash of both."""
    draw = hash60(F.concat_ws("|", F.col("batch").cast("string"), F.col("dst").cast("string")), f"{seed}|{hop}")
    return frontier.join(degree, "dst").select("batch", "dst", F.when(F.col("degree") <= least, 0).otherwise(k).alias("k"), F.when(F.col("degree") <= k, F.lit(0).cast("bigint")).otherwise(draw % F.floor((F.col("degree") - 1) / k + 1)).alias("g"))


def _seeds(edges: DataFrame, batch_size: int, seed: int, most: int | None, *kept: str) -> DataFrame:
    """(batch, src, dst, *kept): the edges in hashed order, so many a batch."""
    key = F.col("source_row_id").cast("string")
    placed = ordinals(edges.select("source_row_id", "src", "dst", *kept).withColumn("_h", digest(key, seed)), [], ["_h", "source_row_id"], "_at")
    seeds = placed.select(F.floor(F.col("_at") / batch_size).cast("int").alias("batch"), "src", "dst", *kept)
    return materialize(seeds if most is None else seeds.where(F.col("batch") < most), "seeds")


def sampled_batches(messages: DataFrame, edges: DataFrame, batch_size: int, fanout: tuple[int, int], seed: int, most: int | None = None) -> DataFrame:
    """(batch, kind, a, b, x, y): seed edges (kind 0) in hashed order and the sampled incoming edges of each hop (kinds 1, 2) of every batch, row by row.

    A batch of n seed edges has at most 2n x (1 + fanout[0] + fanout[0] x fanout[1]) rows, so a group fits in a task. edges: source_row_id,
    src, dst, x, y; messages: source_row_id, src, dst, reverse, x. Training takes the same samples from `packed_batches`.
    """
    seeds = _seeds(edges, batch_size, seed, most, "x", "y")
    out = [seeds.select("batch", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "x", "y")]
    ends = seeds.select("batch", F.explode(F.array("src", "dst")).alias("dst")).distinct()
    degree, members = _samples(messages, fanout, seed)
    members = materialize(members.join(edges.select("source_row_id", "x"), "source_row_id"), "members")
    frontier = ends
    for hop, k in enumerate(fanout, 1):
        got = members.join(_sought(frontier, degree, k, min(fanout), hop, seed), ["dst", "k", "g"])
        got = materialize(got.select("batch", "src", "dst", "x"), "hop")
        out.append(got.select("batch", F.lit(hop).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "x", F.lit(None).cast("int").alias("y")))
        # Nodes of the first frontier need their own first-layer state too.
        frontier = got.select("batch", F.col("src").alias("dst")).unionByName(ends).distinct()
    return reduce(DataFrame.unionByName, out)


def _sample_means(batches):
    """(dst, k, g, z, srcs) of rows sorted by (dst, k, g): the mean of x and the sources. The rows of a sample that the next batch may go on with are kept back."""
    rest = None
    names = ["dst", "k", "g", "z", "srcs"]

    def reduced(b: pa.RecordBatch, start: np.ndarray):
        first = b.take(pa.array(start))
        ends = np.append(start, b.num_rows)
        z = np.add.reduceat(stacked(b.column(4)).astype(float), start) / np.diff(ends)[:, None]
        return pa.RecordBatch.from_arrays([first.column(0), first.column(1), first.column(2), lists(z), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), b.column(3))], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        if rest is not None:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        same = np.logical_and.reduce([pc.equal(b.column(i)[1:], b.column(i)[:-1]).to_numpy(zero_copy_only=False) for i in range(3)]).astype(bool)
        start = np.flatnonzero(np.concatenate([[True], ~same]))
        rest = b.slice(start[-1])
        if len(start) > 1:
            yield reduced(b.slice(0, start[-1]), start[:-1])
    if rest is not None:
        yield reduced(rest, np.zeros(1, int))


def packed(seeds: tuple, one: tuple, two: tuple) -> dict[str, np.ndarray]:
    """The arrays that a batch's gradient needs; nodes are numbered by appearance, the end points of the seed edges first.

    seeds: a, b, y, x or None. one: the nodes whose samples of the first hop these are, means of features, offsets, sources. two: nodes and means of the second.
    """
    a, b, y, x0 = seeds
    into, z2, offsets, srcs = one
    node, z = two
    names = pa.concat_arrays([a, b, srcs, node, into]).dictionary_encode()
    code = names.indices.to_numpy().astype(np.int32)
    s, t, from1, at2, at1 = np.split(code, np.cumsum([len(a), len(b), len(srcs), len(node)]))
    n, ends = len(names.dictionary), int(max(s.max(), t.max())) + 1
    z1 = np.zeros((n, z.shape[1]), z.dtype)
    z1[at2] = z
    got = np.zeros(n, bool)
    got[at2] = True
    # Only the end points of seed edges and the sources of the first hop have a state that is used.
    used = max(ends, int(from1.max()) + 1 if len(from1) else 0)
    order = np.argsort(from1, kind="stable").astype(np.int32)
    return {"s": s, "t": t, "y": y.astype(np.int8), "z1": z1[:used], "got": got[:used], "at1": at1, "z2": z2, "offsets": offsets.astype(np.int32), "from1": from1, "order": order, "ends": np.int32(ends), **({} if x0 is None else {"x0": x0})}


def _packer(batches: pa.Table) -> pa.Table:
    """One row (batch, data) of a batch's rows (batch, kind, a, b, z, srcs, y)."""
    t = batches.combine_chunks()
    kind = t["kind"].to_numpy()
    seeds, one, two = (t.filter(pa.array(kind == k)) for k in (0, 1, 2))
    text = lambda d, c: d[c].combine_chunks().cast(pa.string()) if d.num_rows else pa.array([], pa.string())
    width = max((len(d["z"][0]) for d in (one, two) if d.num_rows), default=0)
    mean = lambda d: stacked(d["z"]).astype(np.float32) if d.num_rows else np.zeros((0, width), np.float32)
    srcs = one["srcs"].combine_chunks() if one.num_rows else pa.array([], pa.list_(pa.string()))
    sizes = pc.list_value_length(srcs).to_numpy(zero_copy_only=False).astype(int)
    x0 = stacked(seeds["z"]).astype(np.float32) if seeds["z"].null_count == 0 else None
    arrays = packed((text(seeds, "a"), text(seeds, "b"), seeds["y"].to_numpy(), x0), (text(one, "b"), mean(one), np.cumsum(sizes) - sizes, srcs.flatten().cast(pa.string())), (text(two, "b"), mean(two)))
    data = io.BytesIO()
    np.savez(data, **arrays)
    return pa.table({"batch": t["batch"].slice(0, 1), "data": pa.array([data.getvalue()], pa.binary())})


def packed_batches(messages: DataFrame, edges: DataFrame, batch_size: int, fanout: tuple[int, int], seed: int, use_edge: bool = False, most: int | None = None) -> DataFrame:
    """(batch, data): the samples of `sampled_batches`, each batch's arrays in one value.

    Messages are linear in the features, so a sample's mean stands for its edges: it is computed once, not for every batch that takes it.
    """
    seeds = _seeds(edges, batch_size, seed, most, "y", *(["x"] if use_edge else []))
    ends = seeds.select("batch", F.explode(F.array("src", "dst")).alias("dst")).distinct()
    degree, members = _samples(messages, fanout, seed)
    rows = members.join(edges.select("source_row_id", "x"), "source_row_id").select("dst", "k", "g", "src", "x")
    samples = materialize(rows.repartition("dst", "k", "g").sortWithinPartitions("dst", "k", "g").mapInArrow(_sample_means, "dst string, k int, g bigint, z array<float>, srcs array<string>"), "samples")
    least, on = min(fanout), ["dst", "k", "g"]
    one = materialize(samples.join(_sought(ends, degree, fanout[0], least, 1, seed), on).select("batch", "dst", "z", "srcs"), "hop")
    frontier = one.select("batch", F.explode("srcs").alias("dst")).unionByName(ends).distinct()
    two = samples.drop("srcs").join(_sought(frontier, degree, fanout[1], least, 2, seed), on)
    none = lambda kind: F.lit(None).cast(kind)
    rows = [
        seeds.select("batch", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("x") if use_edge else none("array<float>")).alias("z"), none("array<string>").alias("srcs"), F.col("y").cast("int").alias("y")),
        one.select("batch", F.lit(1).alias("kind"), none("string").alias("a"), F.col("dst").alias("b"), "z", "srcs", none("int").alias("y")),
        two.select("batch", F.lit(2).alias("kind"), none("string").alias("a"), F.col("dst").alias("b"), "z", none("array<string>").alias("srcs"), none("int").alias("y")),
    ]
    return reduce(DataFrame.unionByName, rows).groupBy("batch").applyInArrow(_packer, "batch int, data binary")


def run_sums(values: np.ndarray, index: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of values[index] over the runs that begin at start, place by place: most runs are short, which reduceat is slow at. Long runs are summed each by itself."""
    count = np.diff(np.append(start, len(index)))
    out = values[index[start]]
    for j in range(1, min(int(count.max()), 16)):
        more = np.flatnonzero(count > j)
        out[more] += values[index[start[more] + j]]
    for i in np.flatnonzero(count > 16):
        out[i] += values[index[start[i] + 16 : start[i] + count[i]]].sum(0)
    return out


def batch_gradient(model: Sage, d: dict[str, np.ndarray], class_weights: np.ndarray, dropout: float = 0.0, seed: list[int] | int = 0, kind=np.float64) -> tuple[np.ndarray, list[str]]:
    """Loss, weight and gradient sums of one packed batch, flat in the order of the sorted weight names.

    Layer 1 is computed for the nodes whose state is used, layer 2 for the end points of the seed edges. No rectifier stands between a message and the
    matrix it meets, so both matrices are multiplied first.
    """
    f, h = model.features, model.hidden
    w = {k: a.astype(kind) for k, a in model.weights.items()}
    s, t, y, z1, got, at1, order, from1, offsets, ends = (d[k] for k in ("s", "t", "y", "z1", "got", "at1", "order", "from1", "offsets", "ends"))
    ends, y, z1, got = int(ends), y.astype(int), z1.astype(kind), got.astype(kind)[:, None]
    n = len(z1)
    rng = np.random.default_rng(seed)
    k1, k2 = (kept_units(rng, (m, h), dropout, kind) for m in (n, ends))
    m1x, r1, a1u = w["m1"][f:], w["m1"][:f].sum(0) + w["bm1"], w["a1"][f:]
    raw = z1 @ (m1x @ a1u)
    raw += got * (r1 @ a1u)
    raw += w["a1"][:f].sum(0) + w["ba1"]
    h1 = np.maximum(raw, 0) * k1
    counts = np.diff(np.append(offsets, len(from1)))
    mean, c2 = np.zeros((ends, h + f), kind), np.zeros((ends, 1), kind)
    if len(at1):
        mean[at1, :h] = run_sums(h1, from1, offsets) / counts[:, None].astype(kind)
        mean[at1, h:] = d["z2"]
        c2[at1, 0] = counts
    has = (c2 > 0).astype(kind)
    u2 = (mean @ w["m2"] + w["bm2"]) * has
    in2 = np.concatenate([h1[:ends], u2], 1)
    h2 = np.maximum(in2 @ w["a2"] + w["ba2"], 0) * k2
    z = h2[s] @ w["s"] + h2[t] @ w["d"] + w["b"]
    if model.use_edge:
        z = z + d["x0"].astype(kind) @ w["e"]
    p = softmax(z)
    rows, cw = np.arange(len(y)), class_weights[y]
    loss = -(cw * np.log(np.maximum(p[rows, y], 1e-12))).sum()
    p[rows, y] -= 1
    p *= cw[:, None].astype(kind)
    ps, pd_ = (np.stack([np.bincount(i, p[:, c], ends) for c in range(p.shape[1])], 1).astype(kind) for i in (s, t))
    g = {"s": h2.T @ ps, "d": h2.T @ pd_, "e": d["x0"].astype(kind).T @ p if model.use_edge else np.zeros_like(w["e"]), "b": p.sum(0)}
    d2 = (ps @ w["s"].T + pd_ @ w["d"].T) * (h2 > 0) * k2
    g |= {"a2": in2.T @ d2, "ba2": d2.sum(0)}
    back = d2 @ w["a2"].T
    du2 = back[:, h:] * has
    g |= {"m2": mean.T @ du2, "bm2": du2.sum(0)}
    d1 = np.zeros((n, h), kind)
    d1[:ends] = back[:, :h]
    if len(from1):
        to = np.zeros((ends, h), kind)
        to[at1] = (du2[at1] @ w["m2"][:h].T) / counts[:, None].astype(kind)
        sorted_from, at = from1[order], np.repeat(at1, counts)[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_from[1:] != sorted_from[:-1]]))
        d1[sorted_from[first]] += run_sums(to, at, first)
    d1 *= h1 > 0
    d1 *= k1
    gz, gs, all1 = z1.T @ d1, got[:, 0] @ d1, d1.sum(0)  # z1 is 0 where nothing was got
    g |= {"a1": np.concatenate([np.tile(all1, (f, 1)), m1x.T @ gz + np.outer(r1, gs)]), "ba1": all1}
    bm1 = gs @ a1u.T
    g |= {"m1": np.concatenate([np.tile(bm1, (f, 1)), gz @ a1u.T]), "bm1": bm1}
    names = sorted(w)
    return np.concatenate([[loss, cw.sum()], *[np.ravel(g[k]).astype(float) for k in names]]), names


def sage_gradients(model: Sage, pdf: pd.DataFrame, class_weights: np.ndarray, dropout: float = 0.0, seed: list[int] | int = 0) -> tuple[np.ndarray, list[str]]:
    """`batch_gradient` of one batch that is given row by row."""
    seeds, one, two = (pdf[pdf.kind == k].sort_values("b", kind="stable") for k in (0, 1, 2))
    text = lambda v: pa.array(list(v), pa.string())
    mat = lambda d: np.stack([np.asarray(v, float) for v in d.x]) if len(d) else np.zeros((0, model.features))

    def means(d: pd.DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        nodes, start, count = np.unique(d.b.to_numpy(str), return_index=True, return_counts=True)
        d = d.iloc[np.argsort(d.b.to_numpy(str), kind="stable")]
        return text(nodes), (np.add.reduceat(mat(d), start) if len(d) else mat(d)) / count[:, None], start

    (into, z2, offsets), (node, z, _) = means(one), means(two)
    srcs = text(one.a.iloc[np.argsort(one.b.to_numpy(str), kind="stable")])
    return batch_gradient(model, packed((text(seeds.a), text(seeds.b), seeds.y.to_numpy(int), mat(seeds)), (into, z2, offsets, srcs), (node, z)), class_weights, dropout, seed)


# Seed edges of the batches that a task trains on one after the other before the weights return to the driver.
CHUNK = 1 << 18


class Adam:
    """The moments of a descent over flat gradients."""

    def __init__(self, size: int, rate: float):
        self.rate, self.first, self.second, self.step = rate, np.zeros(size), np.zeros(size), 0

    def descend(self, weights: dict[str, np.ndarray], d: np.ndarray) -> None:
        self.step += 1
        self.first, self.second = 0.9 * self.first + 0.1 * d, 0.999 * self.second + 0.001 * d * d
        move, place = self.rate * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8), 0
        for k in sorted(weights):
            a = weights[k]
            weights[k] = a - move[place : place + a.size].reshape(a.shape)
            place += a.size


def _trainer(model: Sage, adam: Adam, class_weights: np.ndarray, dropout: float, seed: int, together: int):
    """Trains on a task's batches in their order; one row of losses, weights and moments."""

    def gradient(n: int, data: pa.Scalar) -> np.ndarray:
        return batch_gradient(model, dict(np.load(io.BytesIO(data.as_buffer()))), class_weights, dropout, [seed, n], np.float32)[0]

    def run(batches):
        losses, waiting = [], []

        def descend():
            g = sum(pool.map(lambda x: gradient(*x), waiting))
            losses.append(g[0] / g[1])
            adam.descend(model.weights, g[2:] / g[1])
            waiting.clear()

        with ThreadPoolExecutor(min(together, 4)) as pool:
            for b in batches:
                for n, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if waiting and n // together != waiting[0][0] // together:
                        descend()
                    waiting.append((n, data))
            if waiting:
                descend()
        if losses:
            flat = np.concatenate([np.ravel(model.weights[k]) for k in sorted(model.weights)])
            yield pa.RecordBatch.from_arrays([pa.array([list(v)], pa.list_(pa.float64())) for v in (losses, flat, adam.first, adam.second)], names=["losses", "weights", "first", "second"])

    return run


def fit_sage(model: Sage, edges: DataFrame, messages: DataFrame, class_weights: list[float], passes: int = 2, batch_size: int = 4096, fanout: tuple[int, int] = (15, 10), together: int = 8, rate: float = 1e-3, seed: int = 11, dropout: float = 0.0, max_steps: int | None = None, evaluate: Callable[[], float] | None = None, every: int = 50) -> list[float]:
    """Mini-batch training on sampled neighbourhoods: the gradients of `together` batches are summed for one Adam step.

    Returns the mean loss of each step. Batches are reshuffled and resampled in each pass, in parallel. Steps need each other's weights, so a task takes
    those up to the next evaluation, or of CHUNK seed edges, one after the other; only weights and moments reach the driver. After the first
    whole pass training stops at max_steps. With `evaluate`, a score of the weights as they stand, it is asked after every so many steps and after
    the last; the best weights are kept.
    """
    adam, losses, cw = Adam(sum(a.size for a in model.weights.values()), rate), [], np.asarray(class_weights)
    batches = max(1, -(-edges.count() // batch_size))
    best = Best(lambda: [model.weights[k] for k in sorted(model.weights)], evaluate)
    at_once = max(1, CHUNK // (batch_size * together))
    due = every if evaluate else at_once
    for turn in range(passes):
        steps = -(-batches // together)
        if turn and max_steps is not None:
            steps = min(steps, max_steps - adam.step)
        if steps <= 0:
            break
        begun, per = adam.step, -(-due // at_once)
        chunk = lambda step: (step // due) * per + (step % due) // at_once
        step = F.floor(F.col("batch") / together) + begun
        name = F.floor(step / due) * per + F.floor((step % due) / at_once)
        drawn = packed_batches(messages, edges, batch_size, fanout, seed + turn, model.use_edge, steps * together)
        drawn = materialize(drawn.withColumn("chunk", name.cast("int")), "batches", by="chunk")
        for c in sorted({chunk(begun + i) for i in range(steps)}):
            some = drawn.where(F.col("chunk") == c).select("batch", "data").coalesce(1).sortWithinPartitions("batch")
            got = some.mapInArrow(_trainer(model, adam, cw, dropout, seed + turn, together), "losses array<double>, weights array<double>, first array<double>, second array<double>").collect()[0]
            losses += got["losses"]
            adam.step, adam.first, adam.second, place = adam.step + len(got["losses"]), np.asarray(got["first"]), np.asarray(got["second"]), 0
            for k in sorted(model.weights):
                shape, size = model.weights[k].shape, model.weights[k].size
                model.weights[k] = np.asarray(got["weights"][place : place + size]).reshape(shape)
                place += size
            best.after(adam.step, adam.step % every == 0)
        discard(drawn)
    best.after(adam.step, adam.step % every != 0)
    best.restore()
    return losses


def fit_forest(rows: DataFrame, vector: str, label: str, weight: str | None, trees: int = 25, depth: int = 16, seed: int = 11, least: int = 1):
    """A random forest of spark.ml: square root of the features at a split, at least `least` rows a leaf, optional balanced weights."""
    data = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"), *([F.col(weight)] if weight else []))
    kind = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=least, featureSubsetStrategy="sqrt", seed=seed, **({"weightCol": weight} if weight else {}))
    return kind.fit(data)


def export_forest(model, path: str) -> pd.DataFrame:
    """(tree, node, left, right, feature, threshold, leaf): the forest as arrays; leaf holds a node's normalised class distribution.

    A forest has at most trees x 2**(depth + 1) nodes, whatever the number of rows.
    """
    model.write().overwrite().save(path)
    d = SparkSession.active().read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas()
    stats = np.stack([np.asarray(s, float) for s in d["impurityStats"]])
    split = d["split"]
    return pd.DataFrame({"tree": d["treeID"], "node": d["id"], "left": d["leftChild"], "right": d["rightChild"], "feature": [s["featureIndex"] for s in split], "threshold": [s["leftCategoriesOrThreshold"][0] if len(s["leftCategoriesOrThreshold"]) else 0.0 for s in split], "leaf": list(stats / np.maximum(stats.sum(1, keepdims=True), 1e-300))}).sort_values(["tree", "node"], ignore_index=True)


def forest_probabilities(df: DataFrame, forest: pd.DataFrame, vector: str = "x", name: str = "p") -> DataFrame:
    """Mean of the trees' leaf distributions: all rows of a batch go down a tree together until each has reached a leaf."""
    trees = []
    for _, t in forest.groupby("tree"):
        t = t.sort_values("node")
        trees.append(tuple(t[c].to_numpy() for c in ("left", "right", "feature", "threshold")) + (np.stack(t["leaf"].to_list()),))

    def score(x: np.ndarray) -> np.ndarray:
        total = 0.0
        for left, right, feature, threshold, leaf in trees:
            at = np.zeros(len(x), int)
            while True:
                inner = np.flatnonzero(left[at] >= 0)
                if not len(inner):
                    break
                n = at[inner]
                at[inner] = np.where(x[inner, feature[n]] <= threshold[n], left[n], right[n])
            total = total + leaf[at]
        return total / max(len(trees), 1)

    return with_array(df, [vector], name, lambda x: score(x.astype(float)))
