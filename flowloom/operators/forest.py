"""Forests whose trees grow side by side: each task gets all binned rows of train and grows some of the trees, level by level for all nodes at once.

The driver sees neither rows nor trees, so deep trees over many rows need no room there; a tree stays in the task that grew it and scores there.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.models import stacked
from flowloom.session import discard, materialize

BINS = 256
ONE = 1 << 30  # a leaf's shares are whole multiples of 1 / ONE, so that sums do not depend on their order
_LARGE = 128  # nodes of at least so many rows are counted by bin, smaller ones sorted
_ALONE = 1 << 13  # nodes of at least so many rows are looked at each by itself
_PIECE = 1 << 18  # rows that are looked at together

Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _drawn(rng: np.random.Generator, nodes: int, features: int, most: int) -> np.ndarray:
    """For each node `most` different features, all sets equally likely (Floyd's draw)."""
    out = np.empty((nodes, most), np.int64)
    for i, last in enumerate(range(features - most, features)):
        got = rng.integers(0, last + 1, nodes)
        out[:, i] = np.where((out[:, :i] == got[:, None]).any(1), last, got)
    return out


def _gini(left: list[np.ndarray], total: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """What a split leaves of the weighted squares; the larger, the purer. An empty side counts as nothing."""
    a, b, down, up = 0.0, 0.0, 0.0, 0.0
    for n, t, w in zip(left, total, weights, strict=True):
        x, y = n * w, (t - n) * w
        a, b, down, up = a + x * x, b + y * y, down + x, up + y
    return a / np.maximum(down, 1e-300) + b / np.maximum(up, 1e-300)


Best = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _by_bin(at: np.ndarray | int, y: np.ndarray, count: np.ndarray, total: np.ndarray, weights: np.ndarray, least: int) -> Best:
    """From a feature's bins to (node, score, bin), the best split of each node that has one, by counts. at, y: node and class of each row."""
    n, k = total.shape
    rows, classes = total.sum(1)[:, None], [total[:, c, None] for c in range(k)]
    base = np.multiply(at * k + y.astype(np.int32), BINS, dtype=np.int32 if n * k * BINS < 1 << 31 else np.int64)

    def best(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = (slice(i, i + 2 * _PIECE) for i in range(0, len(bins), 2 * _PIECE))  # the largest nodes in parts
        upto = reduce(np.add, (np.bincount(base[i] + bins[i], count[i], n * k * BINS) for i in each)).reshape(n, k, BINS).cumsum(2)
        left = [upto[:, c] for c in range(k)]
        drawn = reduce(np.add, left)
        score = _gini(left, classes, weights)
        score[(drawn < least) | (rows - drawn < least)] = -1.0
        where = score.argmax(1)
        top = score[np.arange(n), where]
        some = np.flatnonzero(top >= 0)
        return some, top[some], where[some]

    return best


def _by_order(at: np.ndarray | int, y: np.ndarray, count: np.ndarray, total: np.ndarray, weights: np.ndarray, least: int) -> Best:
    """The same from the rows in the order of node and bin."""
    k, wide = total.shape[1], (int(count.max()) + 1) * total.shape[1]
    base, rows = at * (BINS * wide) + count.astype(np.int64) * k + y.astype(np.int64), total.sum(1)
    kind = np.uint32 if len(total) * BINS * wide < 1 << 32 else np.int64
    before = np.zeros_like(total)
    np.cumsum(total[:-1], 0, out=before[1:])

    def best(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.sort((base + bins.astype(np.int64) * wide).astype(kind))
        cell = key // wide
        rest = (key - cell * wide).astype(np.int64)
        n, of = rest // k, rest % k
        ends = np.flatnonzero(cell[1:] != cell[:-1])
        node = cell // BINS
        ends = ends[node[ends] == node[ends + 1]]
        on = node[ends].astype(np.int64)
        left = [np.cumsum(np.where(of == c, n, 0))[ends] - before[on, c] for c in range(k)]
        drawn = reduce(np.add, left)
        fit = np.flatnonzero((drawn >= least) & (rows[on] - drawn >= least))
        if not len(fit):
            return fit, np.zeros(0), fit
        ends, on, left = ends[fit], on[fit], [x[fit] for x in left]
        score = _gini(left, [total[on, c] for c in range(k)], weights)
        first = np.flatnonzero(np.append(True, on[1:] != on[:-1]))
        top = np.maximum.reduceat(score, first)
        hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(first, len(on)))))
        hit = hit[np.append(True, on[hit[1:]] != on[hit[:-1]])]
        return on[first], top, (cell[ends[hit]] % BINS).astype(np.int64)

    return best


def grow(x: np.ndarray, y: np.ndarray, count: np.ndarray, weights: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> Tree:
    """(left, feature, bin, shares) of a tree over the rows that count says how often were drawn; x has a line for each feature, values below BINS.

    A node goes to `left` if its feature's bin is at most `bin`, else to the node after; left is -1 at a leaf. Each node draws the square root of
    the features, rounded up, and takes the purest split with `least` drawn rows on both sides, if it is purer than the node; the weights are
    those of the classes. shares: the weighted classes of a node, in multiples of 1 / ONE.
    """
    d, k, most = len(x), len(weights), int(np.ceil(np.sqrt(len(x))))
    if not (drawn := count > 0).all():
        x, y, count = x[:, drawn], y[drawn], count[drawn]
    n, flat = len(y), x.ravel()
    place = np.int32 if n < 1 << 31 else np.int64
    rows, of, times = np.arange(n, dtype=place), y, count  # kept in the order of the nodes
    size, parts, begun = np.array([n]), [], 0
    for level in range(depth + 1):
        nodes, start = len(size), np.append(0, np.cumsum(size))
        total = np.stack([np.add.reduceat(np.where(of == c, times, 0), start[:-1], dtype=np.int64) if n else np.zeros(1, np.int64) for c in range(k)], 1)
        mass = total * weights
        all_of = np.maximum(mass.sum(1), 1e-300)
        left, feature, cut = np.full(nodes, -1), np.zeros(nodes, np.uint8 if d <= 256 else np.int32), np.zeros(nodes, np.uint8)
        parts.append((left, feature, cut, np.rint(mass / all_of[:, None] * ONE).astype(np.int32)))
        ids = np.flatnonzero(((total > 0).sum(1) > 1) & (total.sum(1) >= 2 * least) & (level < depth))
        features = _drawn(rng, len(ids), d, most)
        top = (mass[ids] ** 2).sum(1) / all_of[ids] * (1 + 1e-12)
        chosen, bins = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        for piece, by_bin in _pieces(size[ids]):
            node, there = ids[piece], total[ids[piece]]
            if len(piece) == 1:
                own, within = slice(start[node[0]], start[node[0] + 1]), 0
            else:
                within = np.repeat(np.arange(len(piece)), size[node])
                own = np.arange(len(within)) + np.repeat(start[node] - np.append(0, np.cumsum(size[node])[:-1]), size[node])
            find, at = (_by_bin if by_bin else _by_order)(within, of[own], times[own], there, weights, least), rows[own]
            for f in features[piece].T:
                on, score, where = find(flat[f[0] * n : (f[0] + 1) * n][at] if len(piece) == 1 else flat[np.repeat(f * n, size[node]) + at])
                better = score > top[piece[on]]
                on, at_ = on[better], piece[on[better]]
                top[at_], chosen[at_], bins[at_] = score[better], f[on], where[better]
        split = np.flatnonzero(chosen >= 0)
        if not len(split):
            break
        ids, chosen, bins, begun = ids[split], chosen[split], bins[split], begun + nodes
        left[ids], feature[ids], cut[ids] = begun + 2 * np.arange(len(ids)), chosen, bins
        keep = np.repeat(np.isin(np.arange(nodes), ids), size)
        rows, of, times, size = rows[keep], of[keep], times[keep], size[ids]
        right = flat[np.repeat(chosen * n, size) + rows] > np.repeat(bins.astype(np.uint8), size)
        start, past = np.append(0, np.cumsum(size)), np.append(place(0), np.cumsum(right, dtype=place))
        rights = past[start[1:]] - past[start[:-1]]
        lefts = size - rights
        nth = past[1:] - np.repeat(past[start[:-1]], size)  # rows of the node up to this one that go right
        del past
        to = np.where(right, np.repeat((start[:-1] + lefts - 1).astype(place), size) + nth, np.arange(len(rows), dtype=place) - nth)
        del nth, right
        rows, of, times = (_moved(v, to) for v in (rows, of, times))
        size = np.stack([lefts, rights], 1).ravel()
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _moved(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[place] = values
    return out


def _pieces(size: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """Nodes that are looked at together, and whether by bin: the largest each by itself."""
    for least, most, alone in ((_ALONE, np.inf, True), (_LARGE, _ALONE, False), (0, _LARGE, False)):
        group = np.flatnonzero((size >= least) & (size < most))
        sums = np.cumsum(size[group])
        cuts = np.arange(1, len(group)) if alone else np.searchsorted(sums, np.arange(_PIECE, sums[-1] if len(sums) else 0, _PIECE))
        for piece in np.split(group, cuts):
            if len(piece):
                yield piece, least > 0


def descend(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The shares of the leaf that each row (a column of x) reaches."""
    left, feature, cut, shares = tree
    flat, n = x.ravel(), x.shape[1]
    at, rows = np.zeros(n, np.int64), np.arange(n)
    while len(rows := rows[left[at[rows]] >= 0]):
        on = at[rows]
        at[rows] = left[on] + (flat[feature[on].astype(np.int64) * n + rows] > cut[on])
    return shares[at]


def _matrices(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    for b in batches:
        if len(b):
            yield stacked(b.column(vector)).astype(np.float32, copy=False), b


def bin_edges(train: DataFrame, vector: str) -> list[np.ndarray]:
    """For each feature the values that a split may have: all but the largest where train has at most BINS, else the BINS - 1 quantiles of all rows."""

    def values(batches):
        held, rows = [], 0

        def out():
            m = np.concatenate(held)
            for f in range(m.shape[1]):
                v, n = np.unique(m[:, f], return_counts=True)
                yield pa.RecordBatch.from_pydict({"feature": pa.array([f], pa.int32()), "v": [v.astype("<f4").tobytes()], "n": [n.astype("<i8").tobytes()]})

        for m, _ in _matrices(batches, vector):
            held, rows = [*held, m], rows + len(m)
            if rows >= _PIECE:
                yield from out()
                held, rows = [], 0
        if held:
            yield from out()

    def edges(t: pa.Table) -> pa.Table:
        v, n = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("v", "<f4"), ("n", "<i8")))
        order = np.argsort(v, kind="stable")
        v, n = v[order], np.cumsum(n[order])
        distinct = np.unique(v)
        if len(distinct) > BINS:
            at = np.unique(v[np.searchsorted(n, np.arange(1, BINS) * int(n[-1]) // BINS, "right")])
            distinct = at if at[-1] < distinct[-1] else at[:-1]
        else:
            distinct = distinct[:-1]
        return pa.table({"feature": t.column("feature")[:1], "edges": pa.array([distinct.tolist()], pa.list_(pa.float32()))})

    one = train.select(vector).mapInArrow(values, "feature int, v binary, n binary")
    found = one.groupBy("feature").applyInArrow(edges, "feature int, edges array<float>").collect()
    return [np.asarray(r["edges"], np.float32) for r in sorted(found, key=lambda r: r["feature"])]


def _packed(rows: DataFrame, edges: list[np.ndarray], part: int, row_id: str, vector: str, label: str) -> DataFrame:
    """(part, chunk, x, y, row_keys): the bins, classes and keys of up to a batch of rows in one value each."""

    def pack(batches):
        begun = TaskContext.get().partitionId() << 32
        for i, (m, b) in enumerate(_matrices(batches, vector)):
            x = np.stack([np.searchsorted(e, m[:, f]).astype(np.uint8) for f, e in enumerate(edges)])
            y, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in (label, row_id))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": [begun + i], "x": [x.tobytes()], "y": [y.astype("<i4").tobytes()], "row_keys": [row_keys(x, y, ids).astype("<u8").tobytes()]})

    return rows.select(row_id, vector, label).mapInArrow(pack, "part int, chunk bigint, x binary, y binary, row_keys binary")


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def row_keys(x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A number for each row from its id, class and bins; equal for exact copies under one id only."""
    h = _mixed(ids.astype(np.uint64)) + y.astype(np.uint64)
    for line in x:
        h = h * np.uint64(0x9E3779B97F4A7C15) + line
    return _mixed(h)


_POISSON = np.cumsum([np.exp(-1.0) / factorial(n) for n in range(20)])


def draws(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row: a Poisson variable of mean 1, from the seed, the tree and the row's key alone."""
    salt = np.random.default_rng([seed, tree, 1]).integers(0, 1 << 63, dtype=np.uint64)
    return np.searchsorted(_POISSON, (_mixed(keys ^ salt) >> np.uint64(11)) * 2.0**-53, "right").astype(np.uint8)


class _Rows:
    """Chunks of rows in a nameless file: all of train, of which a tree takes into memory what it draws. A mapped file is no memory that the executor must have."""

    def __init__(self, features: int) -> None:
        self.features, self.file, self.chunks = features, tempfile.TemporaryFile(), []

    def add(self, x: pa.Buffer, y: pa.Buffer, keys: pa.Buffer) -> None:
        self.chunks.append((self.file.tell(), keys.size // 8))
        for part in (keys, y, x):
            self.file.write(part)

    def bag(self, seed: int, tree: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bins, classes and times of the rows that a tree draws."""
        self.file.flush()
        held = np.memmap(self.file, np.uint8, "r") if self.chunks else None
        keys = (held[at : at + 8 * n].view("<u8") for at, n in self.chunks)
        count = [draws(k, seed, tree) for k in keys]
        drawn = [np.flatnonzero(c) for c in count]
        total, place = sum(map(len, drawn)), 0
        x, y = np.empty((self.features, total), np.uint8), np.empty(total, kind)
        for (at, n), rows in zip(self.chunks, drawn, strict=True):
            own = slice(place, place := place + len(rows))
            y[own] = held[at + 8 * n : at + 12 * n].view("<i4")[rows]
            x[:, own] = held[at + 12 * n : at + (12 + self.features) * n].reshape(self.features, n)[:, rows]
        return x, y, np.concatenate([np.zeros(0, np.uint8), *(c[d] for c, d in zip(count, drawn, strict=True))])


@contextmanager
def _few_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows go to Python while this is open."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def forest_scores(train: DataFrame, test: DataFrame, weights: list[float], trees: int, depth: int, least: int, seed: int = 11, row_id: str = "source_row_id", vector: str = "x", label: str = "y") -> DataFrame:
    """(y, p) of the rows of test: the mean of the shares in the leaves of `trees` trees grown on train, see `grow`.

    Every tree draws each row of train as often as a Poisson variable of mean 1 says. The draws depend on the seed, the tree and the rows, and a split
    on counts, so the result does not depend on partitions or the order of rows.
    A task keeps all of train in a file, a byte a value, and in memory the rows that its tree draws and the trees that it has grown.
    """
    spark, k = train.sparkSession, len(weights)
    edges, w = bin_edges(train, vector), np.asarray(weights, float)
    d, groups = len(edges), max(1, min(trees, spark.sparkContext.defaultParallelism))
    packed = materialize(_packed(train, edges, 0, row_id, vector, label).unionByName(_packed(test, edges, 1, row_id, vector, label)), "binned")
    sums = [f"s{c}" for c in range(k)]

    def score(batches):
        rows, forest, kind = _Rows(d), None, np.uint8 if k <= 256 else np.int32
        for b in batches:
            for i, (part, group, chunk) in enumerate(zip(*(b.column(c).to_pylist() for c in ("part", "grp", "chunk")), strict=True)):
                x, y, keys = (b.column(c)[i].as_buffer() for c in ("x", "y", "row_keys"))
                if not part:
                    rows.add(x, y, keys)
                    continue
                if forest is None:
                    forest = [grow(*rows.bag(seed, tree, kind), w, depth, least, np.random.default_rng([seed, tree])) for tree in range(group, trees, groups)]
                x, y = np.frombuffer(x, np.uint8).reshape(d, -1), np.frombuffer(y, "<i4")
                total = sum((descend(t, x).astype(np.int64) for t in forest), np.zeros((len(y), k), np.int64))
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(y), chunk)), "row": pa.array(np.arange(len(y), dtype=np.int32)), "y": pa.array(y)} | {s: pa.array(np.ascontiguousarray(total[:, c])) for c, s in enumerate(sums)})

    every = packed.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartitionById(groups, "grp").sortWithinPartitions("part", "chunk")
    some = every.mapInArrow(score, "chunk bigint, row int, y int, " + ", ".join(f"{s} bigint" for s in sums))
    whole = some.groupBy("chunk", "row", "y").agg(*[F.sum(s).alias(s) for s in sums])
    with _few_at_once(spark, 16):
        out = materialize(whole.select("y", F.array(*[F.col(s) / F.lit(float(trees * ONE)) for s in sums]).alias("p")), "scored")
    discard(packed)
    return out
