"""Structured Streaming forms of the gap sessions and of the incremental fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ladderwork.operators import fold
from ladderwork.schema import RatingParams


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events per user and session; rows later than the watermark are dropped, state is bounded by it."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap).alias("session")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("event_type", F.window("at", "1 day").alias("day")).agg(F.count("*").alias("events"))


def fold_batch(spark: SparkSession, rows: DataFrame, p: RatingParams, state_path: str, log_path: str, batch: int) -> None:
    """Fold one batch of new games on top of the last state; a repeated batch gives the same files.

    State and log are written per batch number, so a batch that runs again
    overwrites its own output only.
    """
    before = spark.read.parquet(f"{state_path}/batch={batch - 1}") if batch else None
    updates = fold.rating_updates(rows, [p], before)
    updates.write.mode("overwrite").parquet(f"{log_path}/batch={batch}")
    now = fold.checkpoint(spark.read.parquet(f"{log_path}/batch={batch}")).drop("variant")
    if before is not None:
        now = now.unionByName(before.join(now, "player_id", "left_anti"))
    now.write.mode("overwrite").parquet(f"{state_path}/batch={batch}")


def follow(rows: DataFrame, p: RatingParams, state_path: str, log_path: str, checkpoint: str) -> StreamingQuery:
    """Append new games to the event log as they arrive in order, resuming from the last state."""
    spark = rows.sparkSession
    return (
        rows.writeStream.foreachBatch(lambda df, batch: fold_batch(spark, df, p, state_path, log_path, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
