"""Writers: partitioned Parquet, CSV, nested JSON frames, views and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_events(updates: DataFrame, path: str) -> None:
    """The event log by variant and season, so that readers prune both; a season's games are dealt over all tasks."""
    tasks = int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    updates.repartition("variant", "season", F.pmod(F.xxhash64("game_id"), F.lit(tasks))).sortWithinPartitions("game_date", "game_id", "player_id").write.mode(
        "overwrite"
    ).partitionBy("variant", "season").parquet(path)


def write_csv(df: DataFrame, path: str, compressed: bool = False, append: bool = False) -> None:
    writer = df.write.mode("append" if append else "overwrite").option("header", True)
    (writer.option("compression", "gzip") if compressed else writer).csv(path)


def nested_frames(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One JSON text per key with its rows in order (a bounded top list per frame)."""
    entry = F.struct(F.col(order), *[F.col(c) for c in fields if c != order])
    return rows.groupBy(key).agg(F.to_json(F.struct(F.sort_array(F.collect_list(entry)).alias("top"))).alias("frame"))


def write_frames(rows: DataFrame, path: str, key: str, order: str, fields: list[str]) -> None:
    nested_frames(rows, key, order, fields).write.mode("overwrite").json(path)


def content_hash(df: DataFrame, by: list[Column | str] | None = None) -> DataFrame:
    """Rows and an order-free hash of the content; equal tables agree however they are dealt."""
    row = F.xxhash64(*(by or df.columns)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(row).cast("string").alias("content_hash"))


def params_hash(df: DataFrame) -> DataFrame:
    return df.select("*", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("params_hash"))


def publish(name: str, df: DataFrame) -> None:
    df.createOrReplaceTempView(name)
