import random
from collections import defaultdict

from pyspark.sql import functions as F

from flowloom.operators.skew import heavy_keys, key_profile, ordinals


def profile(df, **kw):
    keys = {"a": F.col("a"), "b": F.col("b")}
    got = key_profile(df, keys, F.col("id"), F.col("label"), F.col("size"), **kw)
    return {(r["key_field"], r["key_value"]): (r["n"], round(r["size"], 6), r["first_id"], r["last_id"], r["label_changes"]) for r in got.collect()}


def brute(rows):
    by = defaultdict(list)
    for i, a, b, label, size in rows:
        by["a", None if a is None else str(a)].append((i, label, size or 0))
        by["b", b].append((i, label, size or 0))
    out = {}
    for k, xs in by.items():
        xs.sort(key=lambda x: x[0])
        out[k] = (len(xs), round(sum(x[2] for x in xs), 6), xs[0][0], xs[-1][0], sum(p[1] != q[1] for p, q in zip(xs, xs[1:])))
    return out


def test_profile_of_a_hot_key(spark):
    r = random.Random(3)
    rows = [(i, 1 if r.random() < 0.6 else r.choice([None, *range(50)]), r.choice(["x", "x", None, "", f"k{i % 9}"]), r.choice([0, 1, None]), r.choice([None, 1.25, 3.0])) for i in range(4000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, a int, b string, label int, size double").repartition(7)
    for partitions in (None, 1, 13):
        assert profile(df, partitions=partitions) == brute(rows)


def test_profile_of_nothing_and_clashes(spark):
    none = spark.createDataFrame([], "id bigint, a int, b string, label int, size double, key_field string, n int")
    assert profile(none) == {}
    one = spark.createDataFrame([(1, None, None, None, None, "z", 5)], none.schema)
    assert profile(one) == {("a", None): (1, 0.0, 1, 1, 0), ("b", None): (1, 0.0, 1, 1, 0)}


def test_heavy_keys(spark):
    df = spark.createDataFrame([("f", "x", 2), ("f", "y", 1), ("f", None, 97)], "key_field string, key_value string, n bigint")
    assert [r["key_value"] for r in heavy_keys(df, 100, 2).collect()] == ["x"]


def test_heavy_key_is_spread(spark):
    df = spark.range(20000).select(F.lit("hot").alias("k"), "id")
    from flowloom.operators.skew import ranged

    sizes = [r["count"] for r in ranged(df, ["k"], ["id"], 8).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20000 / 8


def test_ordinals(spark):
    rows = [(i, "hot" if i % 3 else None if i % 5 else f"k{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, k string").repartition(5)
    got = {r["id"]: r["place"] for r in ordinals(df, ["k"], ["id"], "place").collect()}
    seen, want = defaultdict(int), {}
    for i, k in rows:
        want[i] = seen[k]
        seen[k] += 1
    assert got == want
    assert ordinals(df.limit(0), ["k"], ["id"], "place").count() == 0
    assert sorted(r["place"] for r in ordinals(df, [], ["id"], "place").collect()) == list(range(3000))


def test_a_hot_key_has_one_state_a_partition(spark):
    """Ten million rows of one key in 8 partitions: 8 states meet in the stitch, however many batches they came in."""
    from flowloom.operators.skew import _segments, ranged

    rows = spark.range(10_000_000).select(F.lit("f").alias("key_field"), F.lit("hot").alias("key_value"), F.col("id").alias("c0"), (F.col("id") % 3).alias("c1"), F.lit(1.0).alias("c2"))
    kind = "key_field string, key_value string, n bigint, size double, first_id bigint, last_id bigint, first_label bigint, last_label bigint, flips bigint"
    states = ranged(rows, ["key_field", "key_value"], ["c0"], 8).mapInArrow(_segments, kind).collect()
    assert len(states) <= 8 and sum(r["n"] for r in states) == 10_000_000 and all(r["flips"] == r["n"] - 1 for r in states)


def test_states_over_batches(spark):
    """Runs that end with a batch, go on in the next or span many, with null keys and labels."""
    r = random.Random(8)
    rows = [(i, r.choice([None, "", "x", "y"]), "b", r.choice([0, 1, None]), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, label int, size double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert profile(df, partitions=3) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
