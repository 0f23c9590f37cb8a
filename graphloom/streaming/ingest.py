"""Incremental ingest (an extension: the model has no streaming): facts arrive, tables follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changed(base: DataFrame, head: DataFrame) -> DataFrame:
    """(path, change): added, modified and removed sources of two (path, digest) inventories."""
    b, h = base.select("path", F.col("digest").alias("b")), head.select("path", F.col("digest").alias("h"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("b") != F.col("h"), "modified")
    return b.join(h, "path", "full").select("path", change.alias("change")).where(F.col("change").isNotNull())


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append new files' rows to ``target``, once each: a batch owns a folder, which a rerun overwrites."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and key; on a stream, rows later than ``late`` are dropped."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    w = events.groupBy(F.window(F.col(time).cast("timestamp"), width), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), key, "n")
