"""Problem 5: rows of the evaluation splits that also occur, exactly or almost, in the training split.

Records are canonicalised and hashed field by field. Two records that differ in at most three fields agree in at least
one of four blocks of fields, so the hashes of the blocks are joined, evaluation against training; a sketch of four bits a
field, which never overstates the difference, drops nearly all chance partners, and the rest are compared exactly.
Exact copies are one class with one representative, and only representatives are paired. A block value that too many records share
is split by blocks of the remaining fields, again losing no pair, until at most three fields are left: records that still share
a value then are near by construction.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import canon
from flowloom.schema import FEATURES
from flowloom.session import materialize

MAX_DIFFERENT, BLOCKS = 3, 4
HOT_PAIRS = 250_000  # pairs of one block value above which it is split further
BROADCAST_IDS = 500_000  # at most 4 MB of row ids; above, the same join shuffles
TRAIN, EVAL = 1, 2

# Fields of one flow in the order of their blocks: field i belongs to block i % 4. Fields that vary much are dealt first, so that
# every block has some; the order affects speed only.
COMPARED = (
    "SRC_TO_DST_SECOND_BYTES", "SRC_TO_DST_AVG_THROUGHPUT", "DURATION_IN", "FLOW_DURATION_MILLISECONDS", "IN_BYTES",
    "L4_SRC_PORT", "IPV4_SRC_ADDR", "MAX_IP_PKT_LEN", "DST_TO_SRC_SECOND_BYTES", "OUT_BYTES", "DURATION_OUT", "IPV4_DST_ADDR",
    "DST_TO_SRC_AVG_THROUGHPUT", "TCP_WIN_MAX_IN", "LONGEST_FLOW_PKT", "TCP_WIN_MAX_OUT", "L4_DST_PORT",
)
FIELDS = (*COMPARED, *(f for f in FEATURES if f not in COMPARED))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def records(flows: DataFrame) -> DataFrame:
    """(id, side, g, f0..f42): row id, 1 for train and 2 for val and test, 16-byte flow group, and the compared fields; rows without a split are left out.

    Addresses are compared as numbers, those that name no host included; unreadable ones are missing. -0.0 is 0.0.
    """
    name = canon.split_name("split")
    side = F.when(name == "train", TRAIN).when(name.isNotNull(), EVAL)

    def value(f: str) -> Column:
        if f.startswith("IPV4_"):
            return canon.host_number(f)
        kind = dict(flows.dtypes)[f]
        return F.col(f) + F.lit(0.0) if kind in ("double", "float") else F.col(f).cast("bigint")

    fields = [value(f).alias(f"f{i}") for i, f in enumerate(FIELDS)]
    return flows.select(F.col("source_row_id").alias("id"), side.alias("side"), F.unhex(canon.group_key("flow_group_id")).alias("g"), *fields).where("side IS NOT NULL")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _field_hashes(batch: pa.RecordBatch, first: int) -> list[np.ndarray]:
    """A 64-bit hash of each field's value from column `first` on; missing has a hash of its own."""
    out = []
    for i in range(len(FIELDS)):
        a = batch.column(first + i)
        x = np.ascontiguousarray(pc.fill_null(a, 0).to_numpy(zero_copy_only=False)).view(np.uint64)
        h = _mixed(x ^ (np.uint64(i + 1) * _MIX[2]))
        if a.null_count:
            h = np.where(a.is_null().to_numpy(zero_copy_only=False), _mixed(np.full(1, 7919 * (i + 1), np.uint64))[0], h)
        out.append(h)
    return out


def _joined(hashes: list[np.ndarray], fields: list[int], seed: int) -> np.ndarray:
    return _mixed(reduce(np.add, (hashes[i] for i in fields), np.uint64(seed)))


_KEYS = [f"k{i}" for i in range(BLOCKS)]
_WORDS = ["v0", "v1", "v2"]


def fingerprints(flows: DataFrame) -> DataFrame:
    """(id, side, g, k0..k3, c, v0..v2): block hashes, a hash of all four, and the sketch of every row that has a split, computed in the JVM.

    The hash of a block takes in which of its fields are missing, so that a missing value equals nothing but a missing one.
    """
    field = [F.col(f"f{i}") for i in range(len(FIELDS))]
    keys = []
    for k in range(BLOCKS):
        own = range(k, len(FIELDS), BLOCKS)
        missing = reduce(lambda a, b: a.bitwiseOR(b), [F.when(field[i].isNull(), 1 << n).otherwise(0) for n, i in enumerate(own)])
        keys.append(F.xxhash64(F.lit(k), missing, *[field[i] for i in own]).alias(f"k{k}"))
    words = []
    for w in range(3):
        four_bits = [F.shiftleft(F.xxhash64(F.lit(i), field[i]).bitwiseAND(F.lit(15)), 4 * j) for j, i in enumerate(range(16 * w, min(16 * w + 16, len(FIELDS))))]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), four_bits).alias(f"v{w}"))
    return records(flows).select("id", "side", "g", *keys, *words).withColumn("c", F.xxhash64(*_KEYS))


def _split_fields(path: int, level: int) -> list[list[int]]:
    """The four blocks of the fields that are left after the choices in `path` (two bits a level)."""
    left = list(range(len(FIELDS)))
    for i in range(level):
        choice = path >> (2 * i) & 3
        left = [f for j, f in enumerate(left) if j % BLOCKS != choice]
    return [left[k::BLOCKS] for k in range(BLOCKS)]


# The last block is the smallest, so choosing it every time leaves the most fields: after so many levels at most three, and records that share a value are near.
LEVELS = next(n for n in range(1, 32) if sum(map(len, _split_fields((1 << 2 * n) - 1, n))) <= MAX_DIFFERENT)


def _finer(level: int):
    def run(batches):
        for b in batches:
            with np.errstate(over="ignore"):
                h = _field_hashes(b, 7)
                path = b.column(1).to_numpy(zero_copy_only=False)
                key = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
                for p in np.unique(path):
                    at = np.flatnonzero(path == p)
                    rows = pa.array(at)
                    blocks = _split_fields(int(p), level)
                    if sum(map(len, blocks)) <= MAX_DIFFERENT:
                        yield pa.RecordBatch.from_arrays([b.column(j).take(rows) for j in range(7)], names=["k", "path", "rep", "sides", *_WORDS])
                        continue
                    for k, fields in enumerate(blocks):
                        new = _mixed(key[at] ^ _joined([x[at] for x in h], fields, 1000 * level + k)).view(np.int64)
                        kept = [b.column(j).take(rows) for j in range(2, 7)]
                        yield pa.RecordBatch.from_arrays([pa.array(new), pa.array(path[at] + (k << (2 * level))), *kept], names=["k", "path", "rep", "sides", *_WORDS])

    return run


def _differ(a: str, b: str) -> Column:
    """Number of four-bit pieces in which two sketches differ."""
    ones = F.lit(0x1111111111111111)
    total = F.lit(0)
    for w in _WORDS:
        x = F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(ones))
    return total


def _pairs(blocks: DataFrame) -> DataFrame:
    """Representatives of the two sides that share a block value and whose sketches are near."""
    a = blocks.where(F.col("sides").bitwiseAND(F.lit(TRAIN)) > 0).alias("a")
    b = blocks.where(F.col("sides").bitwiseAND(F.lit(EVAL)) > 0).alias("b")
    return a.join(b, F.col("a.k") == F.col("b.k")).where((F.col("a.rep") != F.col("b.rep")) & (_differ("a", "b") <= MAX_DIFFERENT)).select(F.col("a.rep").alias("t"), F.col("b.rep").alias("e"))


def _candidates(classes: DataFrame, flows: DataFrame) -> DataFrame:
    """Distinct (t, e) of representatives that may be near, block values that are too common split further level by level."""
    each = [F.struct(F.col(k).alias("k"), F.lit(i).alias("path")) for i, k in enumerate(_KEYS)]
    blocks = classes.select(F.explode(F.array(*each)).alias("b"), "rep", "sides", *_WORDS).select("b.k", "b.path", "rep", "sides", *_WORDS)
    found = []
    for level in range(1, LEVELS + 1):
        sided = [F.count_if(F.col("sides").bitwiseAND(F.lit(s)) > 0) for s in (TRAIN, EVAL)]
        common = blocks.groupBy("k").agg(*[c.alias(f"n{i}") for i, c in enumerate(sided)]).where(F.col("n0") * F.col("n1") > HOT_PAIRS).select("k")
        common = materialize(common, "common")
        if level == LEVELS or common.isEmpty():
            found.append(_pairs(blocks))
            break
        found.append(_pairs(blocks.join(common, "k", "left_anti")))
        hot = materialize(blocks.join(common, "k").withColumnRenamed("rep", "id"), "hot")
        fields = _records_of(flows, hot.select("id"))
        wide = hot.join(fields, "id").select("k", "path", "id", "sides", *_WORDS, *[f"f{i}" for i in range(len(FIELDS))])
        blocks = materialize(wide.mapInArrow(_finer(level), "k bigint, path int, rep bigint, sides int, v0 bigint, v1 bigint, v2 bigint"), "finer")
    return reduce(DataFrame.unionByName, found).distinct()


def _records_of(flows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, f0..f42) of some row ids, chosen before anything is computed of the rows."""
    ids = materialize(ids.distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    chosen = flows.select("source_row_id", "split", "flow_group_id", *FIELDS).join(ids.withColumnRenamed("id", "source_row_id"), "source_row_id")
    return records(chosen).drop("side", "g")


def _verified(candidates: DataFrame, flows: DataFrame) -> DataFrame:
    """The candidates that differ in at most three fields."""
    kept = materialize(candidates, "candidates")
    fields = materialize(_records_of(flows, kept.select(F.explode(F.array("t", "e")).alias("id"))), "fields")
    a, b = fields.alias("a"), fields.alias("b")
    apart = sum((F.when(F.col(f"a.f{i}").eqNullSafe(F.col(f"b.f{i}")), 0).otherwise(1) for i in range(len(FIELDS))), F.lit(0))
    return kept.join(a, F.col("t") == F.col("a.id")).join(b, F.col("e") == F.col("b.id")).where(apart <= MAX_DIFFERENT).select("t", "e")


@dataclass(frozen=True)
class Overlap:
    """What two sides share, without any pairs of rows.

    prints: id, side and flow group of every row. members: (rep, id, side) of the classes of more than one row; any other class is its
    representative alone. near: (t, e), representatives of a class with train rows and of another with evaluation rows.
    """

    prints: DataFrame
    members: DataFrame
    near: DataFrame


def overlap_classes(flows: DataFrame) -> Overlap:
    """Exact copies as classes, and the near pairs of their representatives."""
    prints = materialize(fingerprints(flows), "prints")
    classes = prints.groupBy("c", "k0").agg(F.min("id").alias("rep"), F.bit_or("side").alias("sides"), F.count(F.lit(1)).alias("n"), *[F.first(w).alias(w) for w in (*_KEYS[1:], *_WORDS)])
    classes = materialize(classes, "classes")
    copies = classes.where("n > 1").select("rep", "c", "k0")
    members = materialize(prints.select("id", "side", "c", "k0").join(copies, ["c", "k0"]).select("rep", "id", "side"), "members")
    return Overlap(prints.select("id", "side", "g"), members, materialize(_verified(_candidates(classes, flows), flows), "near"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("row_id_a"), F.greatest(a, b).alias("row_id_b")]


def overlap_pairs(flows: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), the smaller first: a train row and a val or test row of the same flow group, or that differ in at most three fields.

    Missing equals missing only; a missing group is no group. Rows without a split take no part; a repeated row id stands for each
    of its rows. Empty input gives no rows, extra columns are ignored. Lost is nothing: hot block values are split, never capped.
    All pairs are spelled out here, as the definition of the cases wants it; `overlap_report` and `overlapping_rows` do without.
    """
    got = overlap_classes(flows)
    trains = got.members.where(F.col("side") == TRAIN).select(F.col("rep").alias("t"), F.col("id").alias("ti"))
    evals = got.members.where(F.col("side") == EVAL).select(F.col("rep").alias("e"), F.col("id").alias("ei"))
    # A class of one has no row in members; its representative stands for itself.
    spread = got.near.join(trains, "t", "left").join(evals, "e", "left").select(F.coalesce("ti", "t").alias("x"), F.coalesce("ei", "e").alias("y"))
    exact = trains.join(evals, F.col("t") == F.col("e")).select(F.col("ti").alias("x"), F.col("ei").alias("y"))
    grouped = got.prints.where("g IS NOT NULL")
    a = grouped.where(F.col("side") == TRAIN).select("g", F.col("id").alias("x"))
    b = grouped.where(F.col("side") == EVAL).select("g", F.col("id").alias("y"))
    same = a.join(b, "g").select("x", "y")
    return spread.unionByName(exact).unionByName(same).select(*_ordered("x", "y")).distinct()


def overlapping_rows(flows: DataFrame) -> DataFrame:
    """(id) of the evaluation rows that occur in train: of a class or a flow group that train has rows of, or near a class that it has rows of.

    The result and all that leads to it are linear in the rows: no pairs of rows are made. Each id once.
    """
    got = overlap_classes(flows)
    near = got.near.select(F.col("e").alias("rep")).distinct()
    evals = got.members.where(F.col("side") == EVAL)
    both = got.members.groupBy("rep").agg(F.bit_or("side").alias("sides")).where(F.col("sides") == TRAIN + EVAL).select("rep")
    hit = evals.join(both.unionByName(near).distinct(), "rep").select("id")
    # A representative may itself be a train row of a class that has evaluation rows too, so only evaluation rows are kept.
    alone = got.prints.where(F.col("side") == EVAL).join(near.withColumnRenamed("rep", "id"), "id", "left_semi").select("id")
    grouped = got.prints.where("g IS NOT NULL")
    mixed = grouped.groupBy("g").agg(F.bit_or("side").alias("sides")).where(F.col("sides") == TRAIN + EVAL).select("g")
    same = grouped.where(F.col("side") == EVAL).join(mixed, "g").select("id")
    return hit.unionByName(alone).unionByName(same).distinct()


def overlap_report(flows: DataFrame) -> DataFrame:
    """(split, dataset, attack, rows, in_train): evaluation rows by split, Dataset and class key, and how many occur in train.

    A missing Dataset or class is a group of its own.
    """
    hit = overlapping_rows(flows).withColumn("hit", F.lit(1))
    rows = flows.select(F.col("source_row_id").alias("id"), canon.split_name("split").alias("split"), canon.word_key("Dataset").alias("dataset"), canon.word_key("Attack").alias("attack"))
    rows = rows.where("split IN ('val', 'test')").join(hit, "id", "left")
    return rows.groupBy("split", "dataset", "attack").agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("in_train"))


def overlap_pairs_sql(table: str) -> str:
    """`overlap_pairs` in SQL for DuckDB: every train row against every evaluation row, field by field."""
    value = lambda f: canon.host_number_sql(f) if f.startswith("IPV4_") else f
    cols = ", ".join(f"{value(f)} AS f{i}" for i, f in enumerate(FIELDS))
    apart = " + ".join(f"(a.f{i} IS DISTINCT FROM b.f{i})::INT" for i in range(len(FIELDS)))
    return f"""
WITH flow AS MATERIALIZED (SELECT source_row_id AS id, {canon.split_name_sql("split")} AS split, {canon.group_key_sql("flow_group_id")} AS g, {cols} FROM {table}),
a AS MATERIALIZED (SELECT * FROM flow WHERE split = 'train'), b AS MATERIALIZED (SELECT * FROM flow WHERE split IN ('val', 'test'))
SELECT DISTINCT least(a.id, b.id) AS row_id_a, greatest(a.id, b.id) AS row_id_b FROM a JOIN b ON a.g = b.g OR {apart} <= {MAX_DIFFERENT}"""


def overlap_report_sql(table: str) -> str:
    """`overlap_report` in SQL for DuckDB."""
    return f"""
WITH pairs AS ({overlap_pairs_sql(table)}), hit AS (SELECT DISTINCT unnest([row_id_a, row_id_b]) AS id FROM pairs)
SELECT {canon.split_name_sql("split")} AS split, {canon.word_key_sql("Dataset")} AS dataset, {canon.word_key_sql("Attack")} AS attack, count(*) AS rows, count(hit.id) AS in_train
FROM (SELECT * FROM {table} WHERE {canon.split_name_sql("split")} IN ('val', 'test')) f LEFT JOIN hit ON hit.id = f.source_row_id GROUP BY ALL"""
