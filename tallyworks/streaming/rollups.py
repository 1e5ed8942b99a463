"""Structured Streaming: the sixty-second rollup with late data, and an upsert sink over Parquet versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and tumbling window; state is dropped ``late`` behind the newest event."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def refresh(df: DataFrame, out: str, checkpoint: str, seconds: int = 60, once: bool = False) -> StreamingQuery:
    """Append each batch's changed windows as versions (batch id last); a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id:08d}")

    w = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{seconds} seconds")).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of each window."""
    v = spark.read.parquet(f"{out}/*")
    return v.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r")).select("start", "event_type", "r.*")
