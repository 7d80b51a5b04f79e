"""Problem 3: a sample whose category shares are the wanted ones.

Weights of the cells (one value of every category field) are raked to the target margins, capped at what a cell holds. Every row gets a
weighted exponential key, and the rows with the smallest keys of a plan are drawn by a histogram of the keys. How many rows each cell then has is
counted; what the draw left between the margins and their goals is moved between cells, minimums of small categories are repaired, a cell giving up its largest
keys or taking its next ones, and what remains is reported. Counting and drawing run over all rows, raking and repair on the cells,
of which there are at most the product of (named categories + 1) over the fields.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.hashing import hash60
from flowloom.session import materialize

OTHER, SEED, ROUNDS = "", 20260921, 200
REPORT = T.StructType(
    [T.StructField(c, t) for c, t in (("plan_id", T.StringType()), ("split", T.StringType()), ("sample_pct", T.LongType()), ("category_field", T.StringType()), ("category", T.StringType()), ("target_pct", T.LongType()), ("min_rows", T.LongType()), ("split_rows", T.LongType()), ("size", T.LongType()), ("available", T.LongType()), ("drawn", T.LongType()), ("short", T.BooleanType()), ("wanted", T.DoubleType()), ("gap", T.DoubleType()), ("sample_rows", T.LongType()))]
)
QUOTAS = "plan_id string, cell string, quota bigint, weight double"


@dataclass(frozen=True)
class Target:
    """A row of the target table, and the key by which its category is compared."""

    plan_id: str
    split: str
    sample_pct: int
    category_field: str
    category: str
    target_pct: int
    min_rows: int
    key: str


def rake(counts: dict[tuple, int], margins: list[dict[str, float]], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Wanted rows of each cell: counts scaled in turn to each field's margins, never above what a cell holds.

    Iterative proportional fitting; a capped cell keeps all its rows and the rest of its category takes the difference.
    Stops when no cell moves by more than a millionth.
    """
    q = {c: float(n) for c, n in counts.items()}
    for _ in range(rounds):
        moved = 0.0
        for i, wanted in enumerate(margins):
            by = defaultdict(list)
            for c in q:
                by[c[i]].append(c)
            for k, cells in by.items():
                goal = wanted.get(k, 0.0)
                for _ in range(len(cells) + 1):
                    free = [c for c in cells if q[c] < counts[c]]
                    full = sum(counts[c] for c in cells if q[c] >= counts[c])
                    now = sum(q[c] for c in free)
                    have = full + now
                    if have <= goal and (not free or now == 0):
                        break
                    scale = (goal / have if have > goal else (goal - full) / now) if have else 0.0
                    over = False
                    for c in cells if have > goal else free:
                        x = min(q[c] * scale, float(counts[c]))
                        over |= x >= counts[c] > q[c]
                        moved = max(moved, abs(x - q[c]))
                        q[c] = x
                    if not over:
                        break
        if moved < 1e-6:
            break
    return q


def whole(q: dict[tuple, float], counts: dict[tuple, int], total: int) -> dict[tuple, int]:
    """q rounded to integers of that sum, the largest remainders up first; cells in sorted order break ties."""
    out = {c: min(int(math.floor(x + 1e-9)), counts[c]) for c, x in q.items()}
    left = total - sum(out.values())
    for c in sorted(q, key=lambda c: (-(q[c] - out[c]), c)):
        if left > 0 and out[c] < counts[c] and q[c] > out[c] + 1e-9:
            out[c] += 1
            left -= 1
    return out


def settle(drawn: dict[tuple, int], counts: dict[tuple, int], goals: list[dict[str, int]]) -> dict[tuple, int]:
    """Moves rows between cells until each field's categories have their goals, as far as cells hold rows.

    Cells that agree in all other fields exchange first, which leaves the other margins as they are; what is left then moves between any cells.
    """
    out = dict(drawn)
    for loose in (False, True):
        for i, goal in enumerate(goals):
            if loose and len(goals) > 1:
                continue
            held: dict[str, int] = defaultdict(int)
            for c, n in out.items():
                held[c[i]] += n
            rest = lambda c, i=i: c[:i] + c[i + 1 :]
            over = {k: held[k] - goal.get(k, 0) for k in held if held[k] > goal.get(k, 0)}
            givers: dict[tuple, list[tuple]] = defaultdict(list)
            for c in sorted(c for c in out if c[i] in over):
                givers[() if loose else rest(c)].append(c)
            for c in sorted(c for c in counts if held[c[i]] < goal.get(c[i], 0)):
                for d in givers[() if loose else rest(c)]:
                    n = min(goal[c[i]] - held[c[i]], counts[c] - out.get(c, 0), out[d], over[d[i]])
                    if n > 0:
                        out[c] = out.get(c, 0) + n
                        out[d] -= n
                        over[d[i]] -= n
                        held[c[i]] += n
    return out


def repair(quota: dict[tuple, int], counts: dict[tuple, int], minimums: list[dict[str, int]], size: int | None = None) -> dict[tuple, int]:
    """Raises categories below their minimum as far as they have rows; what goes beyond size (else the quotas' sum) is taken from cells that can spare it.

    Cells give in proportion to what they have, none below a minimum; if they cannot give enough the sample is larger than size, which the report shows.
    """
    quota = dict(quota)
    size = sum(quota.values()) if size is None else size
    held = [defaultdict(int) for _ in minimums]
    for c, n in quota.items():
        for i, h in enumerate(held):
            h[c[i]] += n
    raised: set[tuple[int, str]] = set()
    for i, m in enumerate(minimums):
        for k, least in sorted(m.items()):
            own = sorted((c for c in counts if c[i] == k), key=lambda c: (quota.get(c, 0) - counts[c], c))
            need = min(least, sum(counts[c] for c in own)) - held[i][k]
            if need > 0:
                raised.add((i, k))
            for c in own:
                add = max(0, min(need, counts[c] - quota.get(c, 0)))
                quota[c] = quota.get(c, 0) + add
                need -= add
                for j, h in enumerate(held):
                    h[c[j]] += add
    excess = sum(quota.values()) - size
    donors = sorted((c for c in quota if not any((i, k) in raised for i, k in enumerate(c))), key=lambda c: (-quota[c], c))
    total = sum(quota[c] for c in donors)
    wanted = excess
    for last in (False, True):  # in proportion first, then whatever the largest can spare
        for c in donors:
            spare = min([quota[c], *(held[j][c[j]] - m.get(c[j], 0) for j, m in enumerate(minimums))])
            give = max(0, min(excess, spare, excess if last else wanted * quota[c] // max(total, 1)))
            quota[c] -= give
            excess -= give
            for j, h in enumerate(held):
                h[c[j]] -= give
    return quota


@dataclass
class Plan:
    """The targets of one plan and split, its cells, and what the draw is to reach."""

    plan: str
    split: str
    targets: list[Target]
    used: list[str]
    counts: dict[tuple, int]
    rows: int
    size: int
    expected: dict[tuple, float]

    def cell(self, c: tuple) -> str:
        return "|".join([self.split, *c])

    def weight(self, c: tuple) -> float:
        """The rate of a row's exponential key: 1 - exp(-weight) of the cell's rows, the raked number, fall below 1."""
        return -math.log1p(-min(self.expected[c] / self.counts[c], 1 - 1e-12)) if self.expected[c] > 0 else 0.0

    @property
    def drawn_size(self) -> int:
        return min(self.size, round(sum(self.expected.values())))

    def goals(self, drawn: dict[tuple, int]) -> list[dict[str, int]]:
        """Each field's categories as whole numbers that sum to what is drawn: the raked margins, largest remainders up."""
        out = []
        for i in range(len(self.used)):
            q, have = defaultdict(float), defaultdict(int)
            for c, x in self.expected.items():
                q[c[i],] += x
                have[c[i],] += self.counts[c]
            out.append({k: n for (k,), n in whole(q, have, sum(drawn.values())).items()})
        return out

    def final(self, drawn: dict[tuple, int]) -> dict[tuple, int]:
        """Rows of each cell after the residual gaps have been settled and the minimums repaired."""
        least = [{t.key: t.min_rows for t in self.targets if t.category_field == f} for f in self.used]
        return repair(settle(drawn, self.counts, self.goals(drawn)), self.counts, least, max(self.size, 0))

    def report(self, final: dict[tuple, int]) -> list[tuple]:
        """A case that falls short is a target whose rows, drawn and left over, are fewer than target_pct % of the sample's size, or than min_rows."""
        out, sample = [], sum(final.values())
        for t in self.targets:
            i = self.used.index(t.category_field)
            got = sum(n for c, n in final.items() if c[i] == t.key)
            left = sum(n - final.get(c, 0) for c, n in self.counts.items() if c[i] == t.key)
            lacks = (got + left) * 100 < t.target_pct * self.size or got + left < t.min_rows
            wanted = self.size * t.target_pct / 100
            out.append((t.plan_id, t.split, t.sample_pct, t.category_field, t.category, t.target_pct, t.min_rows, self.rows, self.size, got + left, got, lacks, wanted, got - wanted, sample))
        return out


def raked_plans(targets: list[Target], cells: dict[str, dict[tuple, int]], fields: list[str]) -> list[Plan]:
    """Every plan and split with its cells, categories that it does not name taken together, and the raked numbers."""
    plans = []
    for plan, split in sorted({(t.plan_id, t.split) for t in targets}):
        own = [t for t in targets if (t.plan_id, t.split) == (plan, split)]
        here = cells.get(split, {})
        total = sum(here.values())
        size = total * own[0].sample_pct // 100
        used = [f for f in fields if any(t.category_field == f for t in own)]
        named = {f: {t.key for t in own if t.category_field == f} for f in used}
        counts: dict[tuple, int] = defaultdict(int)
        for c, n in here.items():
            counts[tuple(c[fields.index(f)] if c[fields.index(f)] in named[f] else OTHER for f in used)] += n
        margins = []
        for f in used:
            goal = {t.key: size * t.target_pct / 100 for t in own if t.category_field == f}
            margins.append(goal | {OTHER: max(0.0, size - sum(goal.values()))})
        plans.append(Plan(plan, split, own, used, dict(counts), total, size, rake(counts, margins)))
    return plans


def prepared(flows: DataFrame, ident: Column, split: Column, fields: dict[str, Column], targets: list[Target]) -> DataFrame:
    """(id, split, f0...): rows that have a split, with each field's key, or OTHER where no plan names it."""
    named = {f: sorted({t.key for t in targets if t.category_field == f}) for f in fields}
    cols = [F.when(v.isin(named[f]), v).otherwise(OTHER).alias(f"f{i}") if named[f] else F.lit(OTHER).alias(f"f{i}") for i, (f, v) in enumerate(fields.items())]
    return flows.select(ident.alias("id"), split.alias("split"), *cols).where("split IS NOT NULL")


def placed_rows(rows: DataFrame, fields: list[str], targets: list[Target]) -> DataFrame:
    """(id, h, plan_id, cell): each row once for every plan of its split, with a hash of its id in [0, 2**60)."""
    per_plan = []
    for plan, split in sorted({(t.plan_id, t.split) for t in targets}):
        part = [F.lit(split)]
        for i, f in enumerate(fields):
            keys = sorted({t.key for t in targets if (t.plan_id, t.split, t.category_field) == (plan, split, f)})
            if keys:
                part.append(F.when(F.col(f"f{i}").isin(keys), F.col(f"f{i}")).otherwise(OTHER))
        per_plan.append(F.when(F.col("split") == split, F.struct(F.lit(plan).alias("plan_id"), F.concat_ws("|", *part).alias("cell"))))
    if not per_plan:
        return rows.sparkSession.createDataFrame([], "id bigint, h bigint, plan_id string, cell string")
    h = hash60(F.coalesce(F.col("id").cast("string"), F.lit("?")), SEED)
    placed = rows.select("id", h.alias("h"), F.explode(F.array_compact(F.array(*per_plan))).alias("p"))
    return materialize(placed.select("id", "h", "p.plan_id", "p.cell"), "placed")


def exponential_key() -> Column:
    """-ln(1 - u) / weight of a row with hash h and its cell's weight."""
    return -F.log1p(-(F.col("h") + 0.5) / float(1 << 60)) / F.col("weight")


def _bins(placed: DataFrame) -> int:
    """Bits of a histogram whose bins hold some hundred rows each."""
    return max(12, min(24, (max(1, placed.count()) // 1_000_000).bit_length() + 12))


def drawn_by_key(placed: DataFrame, plans: list[Plan]) -> dict[tuple[str, str], dict[tuple, int]]:
    """Rows of each cell among the rows of a plan and split that have the smallest exponential keys.

    A histogram of the keys gives each plan's threshold; rows below it are counted where they stand, and only the bin that
    holds the threshold is sorted. Equal keys stand in the order of the row id.
    """
    spark = placed.sparkSession
    weights = [(p.plan, p.cell(c), p.split, p.drawn_size, p.weight(c)) for p in plans for c in p.counts]
    at = {(p.plan, p.cell(c)): (p, c) for p in plans for c in p.counts}
    out = {(p.plan, p.split): dict.fromkeys(p.counts, 0) for p in plans}
    if not weights:
        return out
    small = F.broadcast(spark.createDataFrame(weights, "plan_id string, cell string, split string, take bigint, weight double"))  # one row per plan and cell
    scale = 1 << _bins(placed)
    keyed = placed.join(small, ["plan_id", "cell"]).where("weight > 0").withColumn("key", exponential_key())
    keyed = keyed.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * scale))
    histogram = keyed.groupBy("plan_id", "split", "bin", "take").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("plan_id", "split").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    edge = histogram.withColumn("upto", F.sum("n").over(up)).where(F.col("upto") - F.col("n") < F.col("take"))
    edge = edge.groupBy("plan_id", "split").agg(F.max("bin").alias("edge"), F.max_by(F.col("take") - F.col("upto") + F.col("n"), "bin").alias("need"))
    cut = keyed.join(F.broadcast(edge), ["plan_id", "split"])  # one row per plan and split
    order = Window.partitionBy("plan_id", "split").orderBy("key", "id")
    last = cut.where("bin = edge").withColumn("rank", F.row_number().over(order)).where("rank <= need")
    taken = cut.where("bin < edge").select("plan_id", "cell").unionByName(last.select("plan_id", "cell"))
    for r in taken.groupBy("plan_id", "cell").count().collect():
        p, c = at[r["plan_id"], r["cell"]]
        out[p.plan, p.split][c] = r["count"]
    return out


def plan_sample(rows: DataFrame, fields: list[str], targets: list[Target], placed: DataFrame | None = None):
    """Quotas (plan, cell, rows, weight) and report rows of every plan, from the cells of `prepared` rows, few by construction, and the draw by exponential keys."""
    names = [f"f{i}" for i in range(len(fields))]
    cells: dict[str, dict[tuple, int]] = defaultdict(dict)
    for r in rows.groupBy("split", *names).count().collect():
        cells[r["split"]][tuple(r[n] for n in names)] = r["count"]
    plans = raked_plans(targets, cells, fields)
    drawn = drawn_by_key(placed_rows(rows, fields, targets) if placed is None else placed, plans)
    quotas, report = [], []
    for p in plans:
        final = p.final(drawn[p.plan, p.split])
        quotas += [(p.plan, p.cell(c), n, p.weight(c)) for c, n in final.items()]
        report += p.report(final)
    return quotas, report


def draw(rows: DataFrame, fields: list[str], targets: list[Target], quotas: list[tuple], placed: DataFrame | None = None) -> DataFrame:
    """(plan_id, source_row_id, sample_key): of each plan the rows with the smallest exponential keys in each cell, as many as the quotas say.

    Within a cell keys grow with the rows' hashes, so a histogram of the hashes gives each cell's threshold, rows below it are
    taken where they stand, and only the bin that holds the threshold is sorted. Ties are broken by row id; a repeated
    row id is drawn as a row of its own. Cells that have rows only by repair have no key. Same on every run and partitioning.
    """
    spark = rows.sparkSession
    placed = placed_rows(rows, fields, targets) if placed is None else placed
    if not quotas:
        return spark.createDataFrame([], "plan_id string, source_row_id bigint, sample_key double")
    cells = F.broadcast(spark.createDataFrame(quotas, QUOTAS))  # at most one row per plan and cell
    bins = _bins(placed)
    placed = placed.join(cells, ["plan_id", "cell"]).where("quota > 0")
    bin_of = F.shiftright("h", 60 - bins)
    histogram = placed.groupBy("plan_id", "cell", bin_of.alias("bin"), "quota").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("plan_id", "cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    edge = histogram.withColumn("upto", F.sum("n").over(up)).where(F.col("upto") - F.col("n") < F.col("quota"))
    edge = edge.groupBy("plan_id", "cell").agg(F.max("bin").alias("edge"), F.max_by(F.col("quota") - F.col("upto") + F.col("n"), "bin").alias("need"))
    cut = placed.join(F.broadcast(edge), ["plan_id", "cell"]).withColumn("bin", bin_of)  # one row per plan and cell
    order = Window.partitionBy("plan_id", "cell").orderBy("h", "id")
    last = cut.where("bin = edge").withColumn("rank", F.row_number().over(order)).where("rank <= need").drop("rank")
    key = F.when(F.col("weight") > 0, exponential_key())
    return cut.where("bin < edge").unionByName(last).select("plan_id", F.col("id").alias("source_row_id"), key.alias("sample_key"))
