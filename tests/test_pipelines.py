import pytest

from flowloom import schema
from flowloom.plans import pipelines as P
from flowloom.sources import readers, sinks
from flowloom.streaming.ingest import validated_stream, write_batch


def many(n=400):
    return [{"IPV4_SRC_ADDR": f"10.0.{i // 200}.{i % 200}", "IPV4_DST_ADDR": f"10.9.{i % 7}.1", "Attack": "DDoS" if i % 2 else "Benign", "Label": i % 2, "flow_group_id": f"{i // 2:032x}" if i % 2 == 0 else f"{10_000 + i:032x}", "IN_BYTES": i} for i in range(n)]


def test_ingest(spark, flows, tmp_path):
    rows = [{"Dataset": d, "IN_BYTES": 2**53 + 1} for d in schema.DATASETS] + [{"IPV4_SRC_ADDR": "bad"}]
    flows(rows).select(*schema.RAW_COLUMNS).coalesce(1).write.option("header", True).csv(f"{tmp_path}/csv")
    report = P.ingest(spark, f"{tmp_path}/csv", f"{tmp_path}/out")
    assert (report["rows"], report["rejected"], report["reasons"]["ip_invalid"]) == (5, 1, 1)
    clean = spark.read.parquet(f"{tmp_path}/out/clean")
    assert clean.count() == 4 and {r["IN_BYTES"] for r in clean.collect()} == {2**53 + 1}
    assert spark.read.parquet(f"{tmp_path}/out/rejected").first()["source_row_id"] == 5
    with pytest.raises(FileExistsError):
        P.ingest(spark, f"{tmp_path}/csv", f"{tmp_path}/out")


def test_prepare(spark, flows, tmp_path):
    flows(many()).drop("split").write.parquet(f"{tmp_path}/in")
    report = P.prepare(spark, f"{tmp_path}/in", f"{tmp_path}/out", {"train": 20, "val": 5, "test": 10})
    assert sum(r["n"] for r in report["counts"]) == 400
    assert all(r["n"] <= {"train": 20, "val": 5, "test": 10}[r["split"]] for r in report["pilot"])
    assert set(report["overlap"]) == {"val", "test"}
    assert sinks.read_manifest(spark, f"{tmp_path}/out/manifest.json")["counts"] == report["counts"]


def test_holdout_and_rewire(spark, flows, tmp_path):
    flows(many()).write.parquet(f"{tmp_path}/in")
    held = P.endpoint_holdout(spark, f"{tmp_path}/in", f"{tmp_path}/held", least=1)
    assert 0 < held["kept"] < held["rows"] == 400
    gates = P.rewire(spark, f"{tmp_path}/in", f"{tmp_path}/rewired")
    assert gates["changed"] > 0 and gates["marginal_difference"] == 0


def test_split_gates_raise(flows):
    with pytest.raises(ValueError, match="splits"):
        P.check_split(flows([{}]), 1)
    torn = flows([{"split": s, "flow_group_id": "f" * 32} for s in schema.SPLITS])
    with pytest.raises(ValueError, match="two splits"):
        P.check_split(torn, 3)
    with pytest.raises(ValueError, match="rows"):
        P.check_split(torn, 4)


def test_stages():
    done = []
    stage = lambda n, ok=True: P.Stage(n, lambda: done.append(n) if ok else None, lambda: n in done)
    assert P.run_stages([stage("a"), stage("b")]) == ["a", "b"]
    assert P.run_stages([stage("a"), stage("c")]) == ["c"]
    with pytest.raises(RuntimeError, match="incomplete"):
        P.run_stages([stage("d", ok=False)])
    with pytest.raises(RuntimeError, match="memory"):
        P.run_stages([stage("e")], gate=lambda _: ["memory"])


def test_run_table_and_files(spark, tmp_path):
    runs = spark.createDataFrame([("d", "t", "m", 1), ("d", "t", "m", 1)], "dataset string, task string, model string, seed int")
    sinks.csv_table(runs, f"{tmp_path}/twice")
    with pytest.raises(ValueError, match="repeated"):
        readers.run_table(spark, f"{tmp_path}/twice")
    (tmp_path / "x.parquet").write_bytes(b"nothing")
    assert readers.parquet_ready(spark, str(tmp_path / "x.parquet"), 1) == (False, "not a Parquet file")
    with pytest.raises(ValueError):
        sinks.manifest(spark, {"x": float("nan")}, f"{tmp_path}/m.json")


def test_stream(spark, flows, tmp_path):
    flows([{}, {"L4_DST_PORT": 70000}]).select(*schema.RAW_COLUMNS).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = validated_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
        q.awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out/clean").count() == 1
        assert spark.read.parquet(f"{tmp_path}/out/rejected").count() == 1


def test_ingest_numbers_follow_the_files(spark, flows, tmp_path):
    """Three files of unequal size: Spark reads the largest first, yet rows are numbered in the order of the files, and of their lines."""
    folder = tmp_path / "csv"
    folder.mkdir()
    at = 0
    for name, n in (("a", 5), ("b", 500), ("c", 50)):
        flows([{"IN_BYTES": at + i} for i in range(n)]).select(*schema.RAW_COLUMNS).coalesce(1).write.option("header", True).csv(f"{tmp_path}/{name}")
        next((tmp_path / name).glob("part-*.csv")).rename(folder / f"{name}.csv")
        at += n
    P.ingest(spark, str(folder), f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out/clean").select("source_row_id", "IN_BYTES").collect()
    assert len(got) == 555 and all(r["source_row_id"] == r["IN_BYTES"] + 1 for r in got)


def test_a_batch_that_is_run_again_adds_nothing(spark, flows, tmp_path):
    """A crash between the outputs and the commit of a batch: the second attempt replaces what the first one wrote."""
    batch = flows([{}, {"L4_DST_PORT": 70000}]).select(*schema.RAW_COLUMNS)
    for number in (0, 1, 1, 0):
        write_batch(batch, number, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/clean").count() == 2
    assert spark.read.parquet(f"{tmp_path}/out/rejected").count() == 2


def test_scope_drops_what_was_materialized(spark, tmp_path):
    """Nested scopes drop their own tables, also when an error ends them; outside of scopes tables stay."""
    from pathlib import Path

    from flowloom.session import discard, materialize, scope

    df = spark.range(5)
    kept = materialize(df)
    with scope(spark):
        outer = materialize(df)
        with pytest.raises(ValueError), scope(spark):
            inner = materialize(df)
            assert inner.count() == 5
            raise ValueError
        assert not Path(inner._flowloom_path).exists() and outer.count() == 5
    assert not Path(outer._flowloom_path).exists() and kept.count() == 5
    discard(kept)
    assert not Path(kept._flowloom_path).exists()
