"""Two logs against each other, and totals of seasons that a stream keeps too."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.operators import reconcile
from ladderwork.plans.performance import performed
from ladderwork.plans.registry import query
from ladderwork.plans.timeline import EVENTS_SQL, _TIMELINE, events, variant_timeline
from ladderwork.sources import arena
from ladderwork.sources.arena import CLEAN_SQL


def counted(rows: DataFrame) -> DataFrame:
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("only_left", "only_right", "changed")]
    return rows.groupBy("season").agg(*kinds)


def tracked(spark, sf) -> DataFrame:
    """The surrogate log without games that count for neither track."""
    running = Window.partitionBy("player_id").orderBy("game_date", "game_id")
    rows = performed(spark, sf).where("track <> 'excluded'")
    return rows.select("season", "player_id", "game_id", F.round(F.lit(1500.0) + F.sum("perf").over(running), 5).alias("rating"))


@query(f"""
WITH {EVENTS_SQL},
l AS (SELECT season, player_id, game_id, round(rating_after, 5) AS rating FROM ev),
r AS (SELECT season, player_id, game_id, round(1500 + sum(perf) OVER (PARTITION BY player_id ORDER BY game_date, game_id), 5) AS rating FROM perf WHERE track <> 'excluded')
SELECT l.season, l.player_id, l.game_id, CASE WHEN r.rating IS NULL THEN 'only_left' ELSE 'changed' END AS kind, CASE WHEN r.rating IS NOT NULL THEN 'rating' END AS columns FROM l LEFT JOIN r USING (season, player_id, game_id) WHERE r.rating IS DISTINCT FROM l.rating
""")
def log_differences(spark, sf):
    """Rows that differ between the log and the log without excluded games."""
    whole = events(spark, sf).select("season", "player_id", "game_id", F.round("rating_after", 5).alias("rating"))
    return reconcile.differences(whole, tracked(spark, sf), "season", ["player_id", "game_id"], ["rating"])


@query(f"""
WITH {_TIMELINE},
a AS (SELECT season, player_id, game_id FROM tl WHERE tl_variant = 'regular'), b AS (SELECT season, player_id, game_id FROM tl WHERE tl_variant = 'playoffs'),
d AS (SELECT coalesce(a.season, b.season) AS season, CASE WHEN b.game_id IS NULL THEN 1 ELSE 0 END AS l, CASE WHEN a.game_id IS NULL THEN 1 ELSE 0 END AS r FROM a FULL JOIN b ON a.season = b.season AND a.player_id = b.player_id AND a.game_id = b.game_id)
SELECT season, CAST(sum(l) AS BIGINT) AS only_left, CAST(sum(r) AS BIGINT) AS only_right, CAST(0 AS BIGINT) AS changed FROM d GROUP BY season HAVING sum(l) + sum(r) > 0
""")
def timeline_differences(spark, sf):
    """Seasons in which the two tracks' timelines part, with the rows of each; shared seasons are never opened."""
    log = variant_timeline(events(spark, sf), 1996).select("variant", "season", "player_id", "game_id", F.round("rating_after", 5).alias("rating"))
    side = lambda v: log.where(F.col("variant") == v).drop("variant")
    return counted(reconcile.differences(side("regular"), side("playoffs"), "season", ["player_id", "game_id"], ["rating"]))


def season_totals(rows: DataFrame) -> DataFrame:
    """Games, minutes, points, wins and the last day of each player's season."""
    return rows.groupBy("season", "player_id").agg(
        F.count("*").alias("games"), F.sum("minutes").alias("minutes"), F.sum("points").alias("points"), F.sum("s_team").alias("wins"), F.max(F.to_date("game_date")).alias("last_day")
    )


@query(f"WITH {CLEAN_SQL} SELECT season, player_id, count(*) AS games, round(sum(minutes), 6) AS minutes, round(sum(points), 6) AS points, sum(s_team) AS wins, max(CAST(game_date AS DATE)) AS last_day FROM clean GROUP BY ALL", name="season_totals")
def season_totals_query(spark, sf):
    """What streaming.totals keeps up to date, over all games at once."""
    return season_totals(arena.clean(spark, sf)).withColumn("minutes", F.round("minutes", 6)).withColumn("points", F.round("points", 6))
