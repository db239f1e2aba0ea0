"""Streams of cursors: the last position a reader saved, and debounced saves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_positions(log: DataFrame) -> DataFrame:
    """Per reader and book the last cursor so far; for update or complete output."""
    last = F.max(F.struct("ts", "event_id", "chapter", "chunk")).alias("__last")
    return log.groupBy("user_id", "book").agg(last).select("user_id", "book", "__last.chapter", "__last.chunk")


def quiet_saves(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """One row per run of a reader's events with less than `gap` between them: its end and the last cursor in it."""
    stamped = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    last = F.max(F.struct("ts", "event_id", "chapter", "chunk")).alias("__last")
    runs = stamped.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(last)
    return runs.select("user_id", F.col("__last.ts").alias("ts"), "__last.event_id", "__last.chapter", "__last.chunk")


def run_once(stream: DataFrame, to: str, mode: str = "append") -> None:
    """All that is there now, into the parquet folder `to`. In the update mode each batch has a folder of its own, so a batch that is run again replaces what it left."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{to}/_checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{to}/data").start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{to}/data/batch={n}")).start()
    query.awaitTermination()


def newest(spark: SparkSession, to: str, keys: list[str]) -> DataFrame:
    """Of what update batches left in `to` the last row of each key: one grouped maximum."""
    rows = spark.read.parquet(f"{to}/data")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__last")).select(*keys, *[F.col("__last")[c].alias(c) for c in values])
