"""Data-quality expectations over tables and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The log's columns that log_checks reads.
CHECKED = ["variant", "game_id", "game_date", "player_id", "games_before", "rating_before", "rating_after", "delta", "e_team"]


def failures(checks: dict[str, DataFrame]) -> DataFrame:
    """check_name and the number of rows that break it."""
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check_name"), "failures")
        out = row if out is None else out.unionByName(row)
    return out


def log_checks(updates: DataFrame) -> DataFrame:
    """Invariants of the event log: zero-sum games, unbroken chains, no gaps, ratings in range."""
    from pyspark.sql import Window

    games = updates.groupBy("variant", "game_id").agg(F.abs(F.sum("delta")).alias("residual"))
    w = Window.partitionBy("variant", "player_id").orderBy("game_date", "game_id")
    chain = updates.withColumn("before", F.lag("rating_after").over(w)).withColumn("games", F.lag("games_before").over(w))
    broken = {
        "chain": "before is not null and abs(before - rating_before) > 1e-9",
        "games_in_steps": "games is not null and games_before <> games + 1",
        "no_nulls": "rating_after is null or delta is null or e_team is null",
        "range": "rating_after not between -5000 and 8000 or e_team not between 0 and 1",
    }
    counts = chain.agg(*[F.count_if(F.expr(e)).alias(name) for name, e in broken.items()])  # all in one pass over the log
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("check_name"), F.col(name).alias("failures")) for name in broken])).alias("r")
    return failures({"zero_sum": games.where("residual > 1e-6")}).unionByName(counts.select(rows).select("r.*"))
