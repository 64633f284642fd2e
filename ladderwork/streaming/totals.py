"""Season totals that follow a stream of games: repeats, late and out-of-order games.

* A repeat that arrives soon is dropped by the stream itself
  (dropDuplicatesWithinWatermark by arrival, so a game of any date gets in);
  its state holds the games of the watermark only.
* What the stream lets through is compared with the season's own log, so a
  repeat of any age counts once.
* A late game reopens its season: the totals of the seasons in a batch are
  merged with the batch and written again; other seasons are not read.

Both tables have a folder for each batch and season.  A batch that runs again
overwrites its own folders and reads earlier batches only, so it leaves the
same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ladderwork.plans.reconciliation import season_totals

KEYS = ["game_id", "player_id"]


TOTALS = "player_id long, games long, minutes double, points double, wins double, last_day date, batch long, season long"


def _earlier(spark: SparkSession, path: str, schema, seasons: list[int], batch: int) -> DataFrame | None:
    """Rows of the seasons from batches before this one; only their folders are read."""
    return spark.read.schema(schema).parquet(path).where(F.col("season").isin(seasons) & (F.col("batch") < batch)) if batch else None


def latest_totals(table: DataFrame) -> DataFrame:
    """The last state of each season of a totals table."""
    last = table.groupBy("season").agg(F.max("batch").alias("batch"))  # partition columns: no data is read for them
    return table.join(F.broadcast(last), ["season", "batch"]).drop("batch")


def merge_batch(spark: SparkSession, rows: DataFrame, log_path: str, totals_path: str, batch: int) -> None:
    """Add a batch of games: new ones go to the log, and the totals of their seasons are written again."""
    rows = rows.dropDuplicates(KEYS)
    seasons = [r.season for r in rows.select("season").distinct().collect()]  # one number a season
    known = _earlier(spark, log_path, StructType([*rows.schema.fields, StructField("batch", LongType())]), seasons, batch)
    fresh = rows.join(known.select(*KEYS), KEYS, "left_anti") if known is not None else rows
    fresh.write.mode("overwrite").partitionBy("season").parquet(f"{log_path}/batch={batch}")
    new = season_totals(spark.read.schema(rows.schema).option("basePath", log_path).parquet(f"{log_path}/batch={batch}"))
    before = _earlier(spark, totals_path, TOTALS, seasons, batch)
    if before is not None:
        new = latest_totals(before).select(*new.columns).unionByName(new)
    merged = new.groupBy("season", "player_id").agg(*[F.sum(c).alias(c) for c in ("games", "minutes", "points", "wins")], F.max("last_day").alias("last_day"))
    merged.write.mode("overwrite").partitionBy("season").parquet(f"{totals_path}/batch={batch}")


def follow_games(games: DataFrame, log_path: str, totals_path: str, checkpoint: str, repeats: str = "7 days") -> StreamingQuery:
    """Keep the log and the totals up to date with a stream of rows (box rows of games, with the time that they `arrived`)."""
    spark = games.sparkSession
    once = games.withWatermark("arrived", repeats).dropDuplicatesWithinWatermark(KEYS)
    return (
        once.writeStream.foreachBatch(lambda df, batch: merge_batch(spark, df, log_path, totals_path, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def totals(spark: SparkSession, totals_path: str) -> DataFrame:
    """season, player_id and totals as of the last batch of each season."""
    return latest_totals(spark.read.schema(TOTALS).parquet(totals_path))


def touched(spark: SparkSession, totals_path: str) -> DataFrame:
    """batch and season: which seasons each batch has opened."""
    return spark.read.schema(TOTALS).parquet(totals_path).select("batch", "season").distinct()
