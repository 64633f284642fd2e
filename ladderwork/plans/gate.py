"""The clean layer: availability, scaling, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderwork.operators import gate, quality
from ladderwork.plans.registry import query
from ladderwork.sources import arena
from ladderwork.sources.arena import BOX_SQL, CLEAN_SQL, GAMES_SQL, read

EXPECTED, TOLERANCE = 60.0, 50.0


def team_rows(spark, sf):
    """Minutes per game and team; zero-quantity teams and one key in 97 stand for faulty rows."""
    rows = arena.box(spark, sf).groupBy("game_id", "team_id").agg(F.count("*").alias("played"), F.sum("minutes").alias("minutes"))
    key = F.col("game_id")
    played = F.when(key % 97 == 0, 0).otherwise(F.col("played"))
    minutes = F.when((key % 89 == 0) & (F.col("team_id") == "F"), F.lit(None)).otherwise(F.col("minutes"))
    return rows.select("game_id", "team_id", played.cast("long").alias("played"), minutes.alias("minutes"))


TEAM_SQL = f"""{BOX_SQL},
team_rows AS (
  SELECT game_id, team_id, CASE WHEN game_id % 97 = 0 THEN 0 ELSE count(*) END AS played,
    CASE WHEN game_id % 89 = 0 AND team_id = 'F' THEN NULL ELSE sum(minutes) END AS minutes FROM box GROUP BY game_id, team_id)"""

GATE_SQL = f"""{TEAM_SQL},
reasons AS (
  SELECT *, abs(minutes - 60e0) AS d, CASE WHEN played = 0 THEN 'team_no_played_rows' WHEN minutes IS NULL THEN 'missing_minutes'
    WHEN abs(minutes - 60e0) > 50 THEN 'minutes_out_of_tolerance' END AS why FROM team_rows),
per_game AS (
  SELECT game_id, count(*) AS teams, min(d) AS min_diff, max(d) AS max_diff,
    max(CASE WHEN why = 'team_no_played_rows' THEN 1 ELSE 0 END) AS a, max(CASE WHEN why = 'missing_minutes' THEN 1 ELSE 0 END) AS b,
    max(CASE WHEN why = 'minutes_out_of_tolerance' THEN 1 ELSE 0 END) AS c,
    string_agg(team_id || coalesce(':' || why, ''), '|' ORDER BY team_id || coalesce(':' || why, '')) AS team_reasons FROM reasons GROUP BY game_id),
gated AS (
  SELECT o_orderkey AS game_id, CASE WHEN p.game_id IS NULL THEN 'missing_boxscore' WHEN teams <> 2 THEN 'missing_team_rows' WHEN a = 1 THEN 'team_no_played_rows'
    WHEN b = 1 THEN 'missing_minutes' WHEN c = 1 THEN 'minutes_out_of_tolerance' END AS reason, coalesce(teams, 0) AS teams,
    round(min_diff, 6) AS min_diff, round(max_diff, 6) AS max_diff, coalesce(team_reasons, '') AS team_reasons
  FROM orders LEFT JOIN per_game p ON o_orderkey = p.game_id)"""


def gated(spark, sf):
    return gate.availability(arena.games(spark, sf), team_rows(spark, sf), EXPECTED, TOLERANCE)


@query(f"WITH {TEAM_SQL} SELECT game_id, team_id, played, round(minutes, 6) AS minutes FROM team_rows")
def team_minutes(spark, sf):
    return team_rows(spark, sf).withColumn("minutes", F.round("minutes", 6))


@query(f"WITH {GATE_SQL} SELECT game_id, CAST(CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS INT) AS is_usable, reason, teams, min_diff, max_diff, team_reasons FROM gated")
def availability_reasons(spark, sf):
    return gated(spark, sf)


@query(f"""
WITH {GATE_SQL}, {GAMES_SQL.strip()}
SELECT season, reason, count(*) AS games, round(avg(max_diff), 6) AS mean_diff FROM gated JOIN games USING (game_id) WHERE reason IS NOT NULL GROUP BY ALL
""")
def exemptions(spark, sf):
    rows = gated(spark, sf).where("is_usable = 0").join(arena.games(spark, sf), "game_id")
    return rows.groupBy("season", "reason").agg(F.count("*").alias("games"), F.round(F.avg("max_diff"), 6).alias("mean_diff"))


@query(f"""
WITH {CLEAN_SQL}
SELECT game_id, player_id, team_id, season, track, round(minutes * 240 / team_minutes, 6) AS scaled_minutes, round(share, 9) AS share FROM clean
""")
def clean_boxscores(spark, sf):
    rows = arena.clean(spark, sf)
    scaled = F.col("minutes") * 240 / F.col("team_minutes")
    return rows.select("game_id", "player_id", "team_id", "season", "track", F.round(scaled, 6).alias("scaled_minutes"), F.round("share", 9).alias("share"))


@query(f"""
WITH {CLEAN_SQL}
SELECT 'orders_without_lines' AS check_name, count(*) AS failures FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'lines_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lines_without_supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'orders_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'games_not_two_teams', count(*) FROM (SELECT game_id FROM clean GROUP BY game_id HAVING count(DISTINCT team_id) <> 2)
UNION ALL SELECT 'shares_not_one', count(*) FROM (SELECT game_id, team_id FROM clean GROUP BY ALL HAVING abs(sum(share) - 1) > 1e-9)
UNION ALL SELECT 'scores_not_mirrored', count(*) FROM (SELECT DISTINCT a.game_id FROM clean a JOIN clean b ON a.game_id = b.game_id AND a.team_id <> b.team_id AND abs(a.team_score - b.other_score) > 1e-6)
""")
def reference_checks(spark, sf):
    orders, lines = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    clean = arena.clean(spark, sf)
    per_team = clean.groupBy("game_id", "team_id").agg(F.sum("share").alias("share"), F.max("team_score").alias("own"), F.max("other_score").alias("other"))
    per_game = per_team.groupBy("game_id").agg(
        F.count("*").alias("teams"), (F.max("own") - F.max("other")).alias("top"), (F.min("own") - F.min("other")).alias("low")
    )
    return quality.failures(
        {
            "orders_without_lines": orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"),
            "lines_without_order": lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
            "lines_without_supplier": lines.join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti"),
            "orders_without_customer": orders.join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
            "games_not_two_teams": per_game.where("teams <> 2"),
            "shares_not_one": per_team.where("abs(share - 1) > 1e-9"),
            "scores_not_mirrored": per_game.where("abs(top) > 1e-6 or abs(low) > 1e-6"),
        }
    )


@query(f"""
WITH {CLEAN_SQL}
SELECT season, count(*) FILTER (track = 'regular') AS regular, count(plus_minus) FILTER (track = 'regular') AS regular_seen,
  count(*) FILTER (track = 'playoffs') AS playoffs, count(plus_minus) FILTER (track = 'playoffs') AS playoffs_seen FROM clean GROUP BY season
""")
def pm_coverage_pivot(spark, sf):
    wide = arena.clean(spark, sf).groupBy("season").pivot("track", ["regular", "playoffs"]).agg(F.count(F.lit(1)).alias("rows"), F.count("plus_minus").alias("seen"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return wide.select(
        "season", zero("regular_rows").alias("regular"), zero("regular_seen").alias("regular_seen"), zero("playoffs_rows").alias("playoffs"), zero("playoffs_seen").alias("playoffs_seen")
    )
