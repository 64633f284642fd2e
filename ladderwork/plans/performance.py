"""Stateless performance of every clean row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderwork.functions import scalar
from ladderwork.operators.performance import draft_start as start_ratings
from ladderwork.operators.performance import with_performance, with_steps
from ladderwork.plans.registry import query
from ladderwork.schema import PerformanceParams, RatingParams
from ladderwork.sources import arena
from ladderwork.sources.arena import CLEAN_SQL, read

SCORE_SQL = (
    "coalesce(points, 0) + 0.4e0 * coalesce(shots_made, 0) - 0.7e0 * coalesce(shots_tried, 0) + 0.5e0 * coalesce(rebounds, 0) + "
    "0.7e0 * coalesce(assists, 0) + coalesce(steals, 0) + 0.7e0 * coalesce(blocks, 0) - 0.4e0 * coalesce(fouls, 0)"
)

PERF_SQL = f"""{CLEAN_SQL},
rated AS (
  SELECT *, {SCORE_SQL} AS game_score, CASE WHEN plus_minus IS NOT NULL AND minutes > 0 THEN plus_minus / minutes * minutes / (minutes + 5) END AS on_court FROM clean),
zed AS (
  SELECT *, (game_score - avg(game_score) OVER g) / greatest(stddev_pop(game_score) OVER g, 1e0) AS z_score,
    (coalesce(on_court, 0) - avg(coalesce(on_court, 0)) OVER g) / greatest(stddev_pop(coalesce(on_court, 0)) OVER g, 1e0) AS z_on_court,
    count(on_court) OVER g AS seen FROM rated WINDOW g AS (PARTITION BY game_id)),
perf AS (SELECT *, CASE WHEN seen > 0 THEN 0.7e0 * z_score + 0.3e0 * z_on_court ELSE z_score END AS perf FROM zed)"""


def performed(spark, sf, p=PerformanceParams()):
    return with_performance(arena.clean(spark, sf), p)


@query(f"WITH {PERF_SQL} SELECT game_id, player_id, round(game_score, 6) AS game_score FROM rated")
def game_score(spark, sf):
    return performed(spark, sf).select("game_id", "player_id", F.round("game_score", 6).alias("game_score"))


@query(f"WITH {PERF_SQL} SELECT game_id, player_id, round(z_score, 6) AS z_score FROM zed")
def game_zscore(spark, sf):
    return performed(spark, sf).select("game_id", "player_id", F.round("z_score", 6).alias("z_score"))


# Plus-minus has few decimals, so many rates are exact halves of the sixth digit; the factor moves them off it.
def _on_court(expression: str) -> str:
    return f"""
WITH {CLEAN_SQL}
SELECT game_id, player_id, round(CASE WHEN plus_minus IS NOT NULL AND minutes > 0 THEN ({expression}) * minutes / (minutes + 5) END * 1.0001e0, 6) AS on_court
FROM (SELECT *, sum(plus_minus) OVER t AS tp, sum(minutes) OVER t AS tm FROM clean WINDOW t AS (PARTITION BY game_id, team_id))
"""


def _mode(mode):
    def run(spark, sf):
        return performed(spark, sf, PerformanceParams(mode=mode)).select("game_id", "player_id", F.round(F.col("on_court") * 1.0001, 6).alias("on_court"))

    return run


query(_on_court("plus_minus / minutes"), "on_court_raw")(_mode("raw"))
query(_on_court("plus_minus / minutes - tp / tm"), "on_court_team_relative")(_mode("team_relative"))
query(_on_court("CASE WHEN tm - minutes > 0 THEN plus_minus / minutes - (tp - plus_minus) / (tm - minutes) ELSE 0 END"), "on_court_on_off")(_mode("on_off"))


@query(f"WITH {PERF_SQL} SELECT game_id, player_id, round(z_on_court, 6) AS z_on_court, round(perf, 6) AS perf FROM perf")
def perf_blend(spark, sf):
    return performed(spark, sf).select("game_id", "player_id", F.round("z_on_court", 6).alias("z_on_court"), F.round("perf", 6).alias("perf"))


@query(f"""
WITH {PERF_SQL}
SELECT season, track, round(avg(CASE WHEN seen = 0 THEN z_score WHEN season >= 1996 THEN 0.5e0 * z_score + 0.5e0 * z_on_court ELSE z_score END), 6) + 0e0 AS mean_perf,
  round(max(CASE WHEN seen = 0 THEN z_score WHEN season >= 1996 THEN 0.5e0 * z_score + 0.5e0 * z_on_court ELSE z_score END), 6) AS top_perf FROM zed GROUP BY ALL
""")
def perf_alpha_switch(spark, sf):
    rows = performed(spark, sf, PerformanceParams(alpha=1.0, alpha_modern=0.5))
    return rows.groupBy("season", "track").agg((F.round(F.avg("perf"), 6) + F.lit(0.0)).alias("mean_perf"), F.round(F.max("perf"), 6).alias("top_perf"))


@query(f"""
WITH {CLEAN_SQL}
SELECT player_id, game_id, CAST(games AS BIGINT) AS games_before, round(45e0 * (1 + 5 * exp(-games / 60e0)) * CASE WHEN track = 'playoffs' THEN 0.5e0 ELSE 1e0 END, 6) AS k_eff
FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_date, game_id) - 1 AS games FROM clean)
""")
def k_schedule(spark, sf):
    rows = with_steps(arena.clean(spark, sf), RatingParams(playoff_multiplier=0.5))
    return rows.select("player_id", "game_id", "games_before", F.round("k_eff", 6).alias("k_eff"))


@query("""
SELECT d AS difference, round(1 / (1 + power(10e0, -(d + 0e0) / 400)), 9) AS neutral, round(1 / (1 + power(10e0, -(d + 65e0) / 400)), 9) AS at_home
FROM (SELECT DISTINCT CAST(p_size * 20 - 500 AS DOUBLE) AS d FROM part)
""")
def win_probability(spark, sf):
    d = read(spark, sf, "part").select((F.col("p_size") * 20 - 500).cast("double").alias("difference")).distinct()
    p = lambda h: F.round(scalar.win_probability(F.col("difference"), h), 9)
    return d.select("difference", p(0.0).alias("neutral"), p(65.0).alias("at_home"))


@query("""
SELECT player_id, pick, CASE WHEN pick IS NULL THEN 1350e0 ELSE greatest(1580e0 - (pick - 1) * 5, 1350e0) END AS start_rating
FROM (SELECT s_suppkey AS player_id, CAST(CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 60 + 1 END AS BIGINT) AS pick FROM supplier)
""")
def draft_start(spark, sf):
    return start_ratings(picks(spark, sf))


def picks(spark, sf):
    key = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(key.alias("player_id"), F.when(key % 4 != 0, key % 60 + 1).alias("pick"))
