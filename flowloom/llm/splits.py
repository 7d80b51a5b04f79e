"""Problem 2: splits in given proportions such that linked rows never stand apart.

Clusters are moved whole, each by itself. All start where a hash of their key puts them. CHAINS annealing chains, each in a task of its own, then move and
exchange clusters: the HEAVY largest, which are candidates of every chain, and a SAMPLE of all others drawn by hash, another one
for each chain. A chain knows the totals of all clusters, so it balances those that are no candidates too. The best chain is kept. Rounds with other
samples go on from there until the shares are met or a round gains little, so the number of candidates bounds a round, not the search, and any cluster may be one.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.hashing import hash60
from flowloom.llm.clusters import anchored, components, host_edges, host_roots, linked_rows
from flowloom.session import materialize

HEAVY, SAMPLE, CHAINS, STEPS, SEED = 1024, 1024, 8, 40_000, 20260920
# A round that lowers the cost by less than this part is the last, as is one that leaves every part this near its share (or within a row).
GAIN, NEAR = 0.1, 1e-4


def clustered(flows: DataFrame) -> DataFrame:
    """(id, cluster, bit, label): the rows of flows with the key of their cluster.

    A cluster is named by its smallest host (h...), else its flow group (g...), else, for a row that nothing links, the row (r...).
    """
    rows = materialize(linked_rows(flows), "rows")
    anchors = anchored(rows)
    hosts = host_roots(anchors, components(host_edges(rows))).select("host", "root")
    root = F.concat(F.lit("h"), F.col("root").cast("string"))
    with_host = anchors.where("host IS NOT NULL").join(hosts, "host").select("id", root.alias("cluster"), "bit", "label")
    lone = F.coalesce(F.concat(F.lit("g"), F.lower(F.hex("g"))), F.concat(F.lit("r"), F.coalesce(F.col("id").cast("string"), F.lit("?"))))
    return with_host.unionByName(anchors.where("host IS NULL").select("id", lone.alias("cluster"), "bit", "label"))


def _cost(have: list[list[float]], want: list[list[float]]) -> float:
    return sum((h - w) ** 2 for hs, ws in zip(have, want, strict=True) for h, w in zip(hs, ws, strict=True))


def anneal(units: list[tuple[str, list[float]]], shares: list[float], seed: int, steps: int, start: list[int] | None = None, totals: list[list[float]] | None = None) -> tuple[float, list[int]]:
    """The least cost found, and the split of each unit: moves and exchanges of units under a falling temperature.

    A unit's weights are its parts of the whole by rows and by label; the cost is the squared deviation of each split's
    part from its share, summed over the weights. start: the split of each unit, else by hash; totals: each split's parts at the start, those
    of what is no unit included, else those of the units.
    """
    rng, k, dims = random.Random(seed), len(shares), len(units[0][1]) if units else 0
    edges = [sum(shares[: i + 1]) for i in range(k)]
    if start is None:
        draws = [random.Random(f"{seed if seed > 1 else 0}|{name}").random() * edges[-1] for name, _ in units]
        start = [next((i for i in range(k) if x < edges[i]), k - 1) for x in draws]
    at = list(start)
    have = [list(x) for x in totals] if totals else [[0.0] * dims for _ in shares]
    want = [[s] * dims for s in shares]
    for (_, w), i in zip(units if totals is None else [], at, strict=False):
        for d in range(dims):
            have[i][d] += w[d]
    cost = _cost(have, want)
    best, kept, heat = cost, list(at), max(cost, 1e-9)
    # Large units are tried more often: half of the draws come from the heaviest hundred.
    heavy = sorted(range(len(units)), key=lambda j: -units[j][1][0])[:100]
    for step in range(steps if len(units) and k > 1 else 0):
        t = heat * (1 - step / steps) ** 3 * 0.05 + 1e-15
        a = rng.choice(heavy) if rng.random() < 0.5 else rng.randrange(len(units))
        i, j = at[a], rng.randrange(k)
        if i == j:
            continue
        b = None
        if rng.random() < 0.5:
            b = rng.randrange(len(units))
            if at[b] != j:
                b = None
        wa, wb = units[a][1], units[b][1] if b is not None else [0.0] * dims
        delta = 0.0
        for d in range(dims):
            x = wa[d] - wb[d]
            p, q = have[i][d] - shares[i], have[j][d] - shares[j]
            delta += x * (2 * (q - p) + 2 * x)
        if delta <= 0 or rng.random() < math.exp(-delta / t):
            for d in range(dims):
                x = wa[d] - wb[d]
                have[i][d] -= x
                have[j][d] += x
            at[a] = j
            if b is not None:
                at[b] = i
            cost += delta
            if cost < best - 1e-15:
                best, kept = cost, list(at)
    return best, kept


def _chain(shares: list[tuple[str, float]], totals: list[list[float]]):
    """totals: rows, rows of label 0 and of label 1 of each split at the start."""
    names, parts = [s for s, _ in shares], [p for _, p in shares]
    whole = [max(sum(t[d] for t in totals), 1.0) for d in range(3)]
    begun = [[t[d] / whole[d] for d in range(3)] for t in totals]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        units = [(u, [a / whole[0], b / whole[1], c / whole[2]]) for u, a, b, c in zip(pdf.cluster, pdf.n, pdf.n0, pdf.n1, strict=True)]
        chain = int(pdf.chain.iloc[0])
        cost, at = anneal(units, parts, chain, STEPS, [names.index(x) for x in pdf.start], begun)
        return pd.DataFrame({"cluster": pdf.cluster, "cost": cost, "chain": chain, "split": [names[i] for i in at]})

    return run


def _start(shares: list[tuple[str, float]]) -> Column:
    """The split where a cluster's hash puts it."""
    u, out, upto = hash60(F.col("cluster"), SEED) / float(1 << 60), F.lit(shares[-1][0]), 1.0
    for (name, _), (_, share) in zip(reversed(shares[:-1]), reversed(shares[1:]), strict=True):
        upto -= share
        out = F.when(u < upto, name).otherwise(out)
    return out


def place_clusters(flows: DataFrame, shares: list[tuple[str, float]]) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, label, split) of every row, and (cluster, n, n0, n1, split) of every cluster."""
    total = sum(p for _, p in shares)
    shares = [(s, p / total) for s, p in sorted(shares)]
    rows = materialize(clustered(flows), "clustered")
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    sizes = materialize(sizes.withColumn("start", _start(shares)), "sizes")
    heavy = materialize(sizes.orderBy(F.desc("n"), "cluster").limit(HEAVY).select("cluster"), "heavy")
    moved, before = None, math.inf
    while True:
        now = sizes if moved is None else sizes.join(F.broadcast(moved), "cluster", "left").withColumn("start", F.coalesce("split", "start")).drop("split")
        sums = {r["start"]: [float(r[c]) for c in ("n", "n0", "n1")] for r in now.groupBy("start").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")]).collect()}
        totals = [sums.get(s, [0.0] * 3) for s, _ in shares]
        whole = [max(sum(t[d] for t in totals), 1.0) for d in range(3)]
        off = [[t[d] / whole[d] - p if sum(x[d] for x in totals) else 0.0 for d in range(3)] for t, (_, p) in zip(totals, shares, strict=True)]
        cost = sum(x * x for xs in off for x in xs)
        if cost > (1 - GAIN) * before or max(abs(x) for xs in off for x in xs) <= max(NEAR if moved is not None else 0.0, 1 / whole[0]):
            break
        before, turn = cost, 0 if moved is None else turn + 1
        # Candidates: at most HEAVY clusters for all chains, and CHAINS x SAMPLE others, each for one chain; others again in every round.
        h = hash60(F.col("cluster"), f"{SEED}|sample" + (f"|{turn}" if turn else ""))
        large = now.join(F.broadcast(heavy), "cluster", "left_semi")
        others = now.join(F.broadcast(heavy), "cluster", "left_anti").withColumn("h", h).orderBy("h", "cluster").limit(CHAINS * SAMPLE)
        candidates = large.withColumn("chain", F.explode(F.sequence(F.lit(1), F.lit(CHAINS)))).unionByName(others.withColumn("chain", (F.col("h") % CHAINS + 1).cast("int")).drop("h"))
        tried = materialize(candidates.groupBy("chain").applyInPandas(_chain(shares, totals), "cluster string, cost double, chain int, split string"), "tried")
        best = tried.groupBy("chain").agg(F.min(F.round("cost", 12)).alias("cost")).orderBy("cost", "chain").limit(1)
        chosen = tried.join(F.broadcast(best.select("chain")), "chain", "left_semi").select("cluster", "split")  # at most HEAVY + CHAINS x SAMPLE rows
        moved = materialize(chosen if moved is None else chosen.unionByName(moved.join(F.broadcast(chosen), "cluster", "left_anti")), "moved")
    split = lambda df, start: df.withColumn("split", start) if moved is None else df.join(F.broadcast(moved), "cluster", "left").withColumn("split", F.coalesce("split", start))
    return split(rows, _start(shares)).select("id", "cluster", "label", "split"), split(sizes, F.col("start")).select("cluster", "n", "n0", "n1", "split")


def assign_splits(flows: DataFrame, shares: list[tuple[str, float]]) -> tuple[DataFrame, DataFrame]:
    """(source_row_id, split) of every row, and the report (split, n, n0, n1) of rows, label 0 and label 1 reached.

    shares: names and positive parts (scaled to sum to 1). Each cluster stands in one split; a cluster that is larger than every share makes
    the proportions unreachable, which the report then shows. Rows without host, group or label are placed too; labels
    other than 0 and 1 weigh in size only. Empty input gives no rows. The result is the same on every run and partitioning.
    """
    placed, clusters = place_clusters(flows, shares)
    report = clusters.groupBy("split").agg(F.sum("n").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return placed.select(F.col("id").alias("source_row_id"), "split"), report


def wholeness(flows: DataFrame, shares: list[tuple[str, float]]) -> DataFrame:
    """One row (rows, clusters, torn): rows placed, their clusters, and those of them whose rows stand in more than one split, counted over the rows."""
    placed, _ = place_clusters(flows, shares)
    by = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), (F.min("split") != F.max("split")).alias("torn"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("clusters"), F.count_if("torn").alias("torn"))
