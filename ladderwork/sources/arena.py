"""The rating domain on the star-schema tables: games, box rows and clean rows.

An order is a game, a (order, supplier) pair is a player's row in it, the line
status is the team.  Column pruning and filters reach the Parquet scans; lines
are counted, all else is lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ladderwork.functions.scalar import season_start

#: Lines of a task on average.
TASK_LINES = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    track = F.when(priority == "1-URGENT", "playoffs").when(priority == "5-LOW", "excluded").otherwise("regular")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").alias("game_date"), track.alias("track"),
        season_start(F.col("o_orderdate")).alias("season"), F.col("o_custkey").alias("venue_id"),
    )


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game and player with the sums of its lines.

    Lines move once, by game: sums, join and windows all use that exchange and
    its order; hardly any lines share game and player, so combining them before would only sort.
    A large table asks for more tasks than the session's number, so that a task's lines stay bounded.
    """
    lines = read(spark, sf_dir, "lineitem")
    tasks = lines.count() // TASK_LINES + 1  # from the files' footers
    dealt = lines.repartition(tasks, "l_orderkey") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else lines.repartition("l_orderkey")
    flag, missing = F.col("l_returnflag"), F.min("l_returnflag") == "N"
    plus_minus = F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05)) / 1000
    return dealt.groupBy(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("player_id")).agg(
        F.min("l_linestatus").alias("team_id"),
        F.sum("l_quantity").alias("minutes"),
        (F.sum("l_extendedprice") / 1000).alias("points"),
        F.sum(F.col("l_quantity") * F.col("l_discount")).alias("assists"),
        F.count("*").cast("double").alias("rebounds"),
        F.sum(F.when(flag == "R", 1.0).otherwise(0.0)).alias("steals"),
        F.sum(F.when(flag == "A", 1.0).otherwise(0.0)).alias("blocks"),
        (F.sum("l_tax") * 10).alias("fouls"),
        (F.sum("l_quantity") / 4).alias("shots_tried"),
        (F.sum("l_quantity") / 10).alias("shots_made"),
        F.when(~missing, plus_minus).alias("plus_minus"),
    )


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box rows of usable games (two teams) with season, share of minutes, home and win.

    The per-game windows share one exchange on game_id with the join.
    """
    by_game, by_team = Window.partitionBy("game_id"), Window.partitionBy("game_id", "team_id")
    rows = box(spark, sf_dir).join(games(spark, sf_dir), "game_id")
    rows = rows.withColumn("teams_lo", F.min("team_id").over(by_game)).withColumn("teams_hi", F.max("team_id").over(by_game))
    rows = rows.where("teams_lo <> teams_hi")
    score = F.sum("points").over(by_team)
    rows = rows.withColumn("team_score", score).withColumn("team_minutes", F.sum("minutes").over(by_team))
    rows = rows.withColumn("other_score", F.sum("points").over(by_game) - F.col("team_score"))
    home = F.col("team_id") == "F"
    gap = F.round(F.col("team_score") - F.col("other_score"), 6)
    return rows.select(
        "game_id", "game_date", "season", "track", "venue_id", "player_id", "team_id", home.alias("home"),
        F.when((gap > 0) | ((gap == 0) & home), 1.0).otherwise(0.0).alias("s_team"),
        "minutes", (F.col("minutes") / F.col("team_minutes")).alias("share"), "team_minutes", "team_score", "other_score",
        "points", "assists", "rebounds", "steals", "blocks", "fouls", "shots_tried", "shots_made", "plus_minus",
    )


#: The same tables as text of common table expressions, for the SQL twins.
GAMES_SQL = """
games AS (
  SELECT o_orderkey AS game_id, o_orderdate AS game_date, o_custkey AS venue_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'playoffs' WHEN o_orderpriority = '5-LOW' THEN 'excluded' ELSE 'regular' END AS track,
    CAST(CASE WHEN year(o_orderdate) = 2020 AND month(o_orderdate) BETWEEN 7 AND 9 THEN 2019
              WHEN month(o_orderdate) < 7 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END AS BIGINT) AS season
  FROM orders)"""

BOX_SQL = """
box AS (
  SELECT l_orderkey AS game_id, l_suppkey AS player_id, min(l_linestatus) AS team_id, sum(l_quantity) AS minutes,
    sum(l_extendedprice) / 1000 AS points, sum(l_quantity * l_discount) AS assists, CAST(count(*) AS DOUBLE) AS rebounds,
    sum(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END) AS steals, sum(CASE WHEN l_returnflag = 'A' THEN 1e0 ELSE 0e0 END) AS blocks,
    sum(l_tax) * 10 AS fouls, sum(l_quantity) / 4 AS shots_tried, sum(l_quantity) / 10 AS shots_made,
    CASE WHEN min(l_returnflag) <> 'N' THEN sum(l_extendedprice * (l_discount - 0.05e0)) / 1000 END AS plus_minus
  FROM lineitem GROUP BY 1, 2)"""

CLEAN_SQL = f"""{GAMES_SQL},{BOX_SQL},
paired AS (
  SELECT b.*, g.game_date, g.season, g.track, g.venue_id, min(team_id) OVER w AS lo, max(team_id) OVER w AS hi
  FROM box b JOIN games g USING (game_id) WINDOW w AS (PARTITION BY game_id)),
scored AS (
  SELECT *, sum(points) OVER (PARTITION BY game_id, team_id) AS team_score, sum(minutes) OVER (PARTITION BY game_id, team_id) AS team_minutes,
    sum(points) OVER (PARTITION BY game_id) AS all_score FROM paired WHERE lo <> hi),
clean AS (
  SELECT game_id, game_date, season, track, venue_id, player_id, team_id, team_id = 'F' AS home,
    CASE WHEN round(2 * team_score - all_score, 6) > 0 OR (round(2 * team_score - all_score, 6) = 0 AND team_id = 'F') THEN 1e0 ELSE 0e0 END AS s_team,
    minutes, minutes / team_minutes AS share, team_minutes, team_score, all_score - team_score AS other_score,
    points, assists, rebounds, steals, blocks, fouls, shots_tried, shots_made, plus_minus FROM scored)"""
