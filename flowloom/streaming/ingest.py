"""Flow files that keep arriving, validated with the same conditions as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from flowloom.operators import validation as V
from flowloom.schema import raw_schema


def write_batch(batch: DataFrame, number: int, out: str) -> None:
    """Validates one batch and writes its two outputs under its number, in place of what an earlier attempt left."""
    tags = V.tagged(batch).persist()
    try:
        tags.where("rejection_reasons = ''").drop("rejection_reasons").write.mode("overwrite").parquet(f"{out}/clean/batch={number}")
        tags.where("rejection_reasons <> ''").write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
    finally:
        tags.unpersist()


def validated_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads new Parquet files of raw flows in a folder, and adds clean rows to out/clean and rejected ones to out/rejected.

    Each batch is written to folders of its own, batch=<id>, which a batch that is run again after a crash replaces. So a file counts once, also
    after a restart, by the checkpoint; with `once` the query ends when it has read what is there.
    """
    raw = spark.readStream.schema(raw_schema()).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, out)

    w = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
