"""Per-key results when a few keys hold most rows.

Rows are range-partitioned on (key, secondary order). Spark samples the quantiles of that composite, so a
key with a third of all rows is spread over a third of the partitions, in order. Each partition reduces its rows to one
partial state per key, and the partial states of a key (at most one per partition) are stitched in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id puts the partition above this many bits


def ranged(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """df range-partitioned on keys and order by sampled quantiles, and sorted so within partitions.

    `order` must be unique within a key, or a heavy key's ties stay in one partition.
    """
    by = [*keys, *order]
    df = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return df.sortWithinPartitions(*by)


def unpivot_keys(df: DataFrame, keys: dict, *carried) -> DataFrame:
    """One row (key_field, key_value, *carried) per row and key field, whose values are cast to strings."""
    each = [F.struct(F.lit(k).alias("key_field"), v.cast("string").alias("key_value")) for k, v in keys.items()]
    kept = [c.alias(f"c{i}") for i, c in enumerate(carried)]
    return df.select(F.explode(F.array(*each)).alias("k"), *kept).select("k.key_field", "k.key_value", *[f"c{i}" for i in range(len(kept))])


_STATE = ["key_field", "key_value", "n", "size", "first_id", "last_id", "first_label", "last_label", "flips"]


def _states(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Partial states of the runs of equal keys in a sorted batch of (field, value, order, label, size)."""
    n = batch.num_rows
    field, value, order, label, size = (batch.column(i) for i in range(5))
    new = np.ones(n, bool)
    if n > 1:
        text = pc.fill_null(value, "")
        null = pc.is_null(value)
        same = pc.and_(pc.equal(field[1:], field[:-1]), pc.and_(pc.equal(text[1:], text[:-1]), pc.equal(null[1:], null[:-1])))
        new[1:] = ~same.to_numpy(zero_copy_only=False)
    start = np.flatnonzero(new)
    last = np.append(start[1:], n) - 1
    mark = pc.fill_null(label, -1).to_numpy(zero_copy_only=False)
    flips = np.zeros(n, np.int64)
    flips[1:] = (mark[1:] != mark[:-1]) & ~new[1:]
    sizes = pc.fill_null(size, 0.0).to_numpy(zero_copy_only=False)
    ids = order.to_numpy(zero_copy_only=False)
    return pa.RecordBatch.from_arrays(
        [field.take(pa.array(start)), value.take(pa.array(start)), pa.array(last - start + 1), pa.array(np.add.reduceat(sizes, start)), pa.array(ids[start]), pa.array(ids[last]), pa.array(mark[start]), pa.array(mark[last]), pa.array(np.add.reduceat(flips, start))],
        names=_STATE,
    )


def _joined(a: dict, b: dict) -> dict:
    """The state of two neighbouring runs of one key."""
    return a | {"n": a["n"] + b["n"], "size": a["size"] + b["size"], "last_id": b["last_id"], "last_label": b["last_label"], "flips": a["flips"] + b["flips"] + (a["last_label"] != b["first_label"])}


def _segments(batches):
    """One partial state for each key of a sorted partition: the last run of an Arrow batch is carried over to the next."""
    carried = None
    for b in batches:
        if not b.num_rows:
            continue
        states = _states(b)
        schema, first = states.schema, states.slice(0, 1).to_pylist()[0]
        if carried and (carried["key_field"], carried["key_value"]) == (first["key_field"], first["key_value"]):
            first, carried = _joined(carried, first), None
        if carried:
            yield pa.RecordBatch.from_pylist([carried], schema)
        if states.num_rows > 1:
            yield pa.RecordBatch.from_pylist([first], schema)
            yield states.slice(1, states.num_rows - 2)
            first = states.slice(states.num_rows - 1).to_pylist()[0]
        carried = first
    if carried:
        yield pa.RecordBatch.from_pylist([carried], schema)


def key_profile(df: DataFrame, keys: dict, order, label, size, partitions: int | None = None) -> DataFrame:
    """Per value of each key field: rows, summed size, first and last row id, and how often the label changes in id order.

    df: any flow-like table; keys: {field name: canonical column}; order: a bigint column; label: bigint or null;
    size: number or null (counts as 0). Null key values form a key of their own; null labels form a label of their own.
    Rows with a null or repeated order id still count; the order among them is undefined, so `label_changes` may then vary.
    Empty input gives no rows. Extra columns of df are ignored.
    """
    rows = unpivot_keys(df, keys, order.cast("bigint"), label.cast("bigint"), size.cast("double"))
    rows = rows.withColumn("c0", F.coalesce("c0", F.lit(-1)))
    states = ranged(rows, ["key_field", "key_value"], ["c0"], partitions).mapInArrow(
        _segments,
        "key_field string, key_value string, n bigint, size double, first_id bigint, last_id bigint, first_label bigint, last_label bigint, flips bigint",
    )
    # Stitch: a key has one state in each partition that it spans; its neighbours meet here in order.
    w = Window.partitionBy("key_field", "key_value").orderBy("first_id", "last_id")
    seam = (F.lag("last_label").over(w) != F.col("first_label")).cast("bigint")
    return (
        states.withColumn("seam", F.coalesce(seam, F.lit(0)))
        .groupBy("key_field", "key_value")
        .agg(
            F.sum("n").alias("n"),
            F.sum("size").alias("size"),
            F.min("first_id").alias("first_id"),
            F.max("last_id").alias("last_id"),
            F.sum(F.col("flips") + F.col("seam")).alias("label_changes"),
        )
    )


def heavy_keys(profile: DataFrame, total: int, percent: int) -> DataFrame:
    """The keys of a `key_profile` that hold at least `percent` % of `total` rows; null is no key."""
    return profile.where(F.col("key_value").isNotNull() & (F.col("n") * 100 >= F.lit(percent) * F.lit(total)))


def ordinals(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """df with `name`, the 0-based position of each row among the rows of its keys in the given order.

    No key is gathered in one task: rows are range-partitioned on (keys, order) and written once, positions within a
    partition come from the written order, and each partition adds the count of its key in the partitions before.
    `order` must be unique within a key. Null keys form a key. Empty input gives no rows.
    """
    kept = materialize(ranged(df, keys, order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", _ROW_BITS).alias("_part")
    starts = kept.groupBy(part, *keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    on = F.shiftright(kept["_at"], _ROW_BITS) == starts["_part"]
    for i, k in enumerate(keys):
        on = on & kept[k].eqNullSafe(starts[f"_k{i}"])
    return kept.join(starts, on).withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)
