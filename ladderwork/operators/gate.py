"""The availability gate: which games have usable rows, and why not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Precedence of the reasons of a game, first to last.
REASONS = ["missing_boxscore", "missing_team_rows", "team_no_played_rows", "missing_minutes", "minutes_out_of_tolerance"]


def availability(games: DataFrame, team_rows: DataFrame, expected: float, tolerance: float) -> DataFrame:
    """game_id, is_usable (0 or 1), reason, teams, least and largest distance, reasons by team.

    team_rows: game_id, team_id, played (rows with minutes), minutes (sum,
    NULL if unknown).  A game needs two teams with played rows whose minutes
    are within `tolerance` of `expected`.
    """
    distance = F.abs(F.col("minutes") - expected)
    reason = (
        F.when(F.col("played") == 0, "team_no_played_rows").when(F.col("minutes").isNull(), "missing_minutes")
        .when(distance > tolerance, "minutes_out_of_tolerance")
    )
    per_game = team_rows.withColumn("distance", distance).withColumn("why", reason).groupBy("game_id").agg(
        F.count("*").alias("teams"), F.min("distance").alias("min_diff"), F.max("distance").alias("max_diff"),
        F.array_sort(F.collect_set("why")).alias("whys"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "team_id", "why"))), "|").alias("team_reasons"),
    )
    joined = games.select("game_id").join(per_game, "game_id", "left")
    why = F.when(F.col("teams").isNull(), REASONS[0]).when(F.col("teams") != 2, REASONS[1])
    for name in REASONS[2:]:
        why = why.when(F.array_contains("whys", name), name)
    return joined.withColumn("reason", why).select(
        "game_id", F.col("reason").isNull().cast("int").alias("is_usable"), "reason", F.coalesce("teams", F.lit(0)).cast("long").alias("teams"),
        F.round("min_diff", 6).alias("min_diff"), F.round("max_diff", 6).alias("max_diff"), F.coalesce("team_reasons", F.lit("")).alias("team_reasons"),
    )
