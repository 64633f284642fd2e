"""Evaluation at several points of a season in one pass, and pairs by team."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.functions import ranks
from ladderwork.plans.evaluation import LEAST, TARGET_SQL, WINDOW, pairs, targets
from ladderwork.plans.performance import performed
from ladderwork.plans.registry import query
from ladderwork.plans.timeline import EVENTS_SQL, events
from ladderwork.sources.warehouse import maybe_broadcast, written

#: Team games after which a season is sampled.
POINTS = (21, 41, 61)


def team_games(log: DataFrame) -> DataFrame:
    """Events of the regular season with j, the number of the game in its team's season (of any length)."""
    regular = log.where("track = 'regular'")
    games = regular.select("season", "team_id", "game_date", "game_id").distinct()
    numbers = ranks.numbered(games, ["season", "team_id"], ["game_date", "game_id"], "j").select("season", "team_id", "game_id", "j")
    return regular.join(maybe_broadcast(numbers), ["season", "team_id", "game_id"])


def sampled(log: DataFrame, points: Sequence[int] = POINTS, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """point, season, player_id, rating, games and target for every sampling point.

    The rating after a player's last event up to the team's n-th game (any
    team of the season; a shorter season counts whole), and the mean
    performance of the player's next events strictly after it (null if they
    are under `least`).  A player's events of a season are numbered once; each
    point is a number in them, so no event is laid out by point.
    """
    w = Window.partitionBy("season", "player_id")
    rows = team_games(log).withColumn("i", F.row_number().over(w.orderBy("game_date", "game_id")))
    for n in points:
        rows = rows.withColumn(f"b{n}", F.max(F.when(F.col("j") <= n, F.col("i"))).over(w))
    cells = []
    for n in points:
        after = (F.col("i") > F.col(f"b{n}")) & (F.col("i") <= F.col(f"b{n}") + window)
        cells.append(
            F.struct(
                F.lit(n).cast("long").alias("point"), F.max(F.when(F.col("i") == F.col(f"b{n}"), F.col("rating_after"))).alias("rating"),
                F.count(F.when(after, F.col("perf"))).alias("games"), F.avg(F.when(after, F.col("perf"))).alias("target"),
            )
        )
    out = rows.groupBy("season", "player_id").agg(F.array(*cells).alias("cells")).select("season", "player_id", F.explode("cells").alias("c"))
    out = out.select("c.point", "season", "player_id", "c.rating", "c.games", F.when(F.col("c.games") >= least, F.col("c.target")).alias("target"))
    return out.where("rating is not null")


def sampled_pairs(log: DataFrame, points: Sequence[int] = POINTS, scale: float = 100.0, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """Prediction (distance from the mean of the point's ratings) and target of each player with both."""
    rows = written(sampled(log, points, window, least), "sampled")
    means = rows.groupBy("point", "season").agg(F.avg("rating").alias("mean"))
    rows = rows.where("target is not null").join(maybe_broadcast(means), ["point", "season"])
    return rows.select("point", "season", "player_id", ((F.col("rating") - F.col("mean")) / scale).alias("pred"), "target")


def metrics(rows: DataFrame, key: str) -> DataFrame:
    """MSE, the MSE of predicting 0, r, spreads and sizes of each key."""
    p, t = F.col("pred"), F.col("target")
    return rows.groupBy(key).agg(
        F.count("*").alias("n"), F.countDistinct("season").alias("boundaries"), F.avg((t - p) * (t - p)).alias("mse"), F.avg(t * t).alias("baseline_mse"),
        F.when(F.stddev_pop("pred") * F.stddev_pop("target") > 0, F.corr("pred", "target")).alias("r"),
        F.stddev_pop("pred").alias("pred_sd"), F.stddev_pop("target").alias("target_sd"),
    ).withColumn("discrimination", F.col("pred_sd") / F.nullif("target_sd", F.lit(0.0)))


_SAMPLED_SQL = f"""{TARGET_SQL},
reg AS (SELECT * FROM ev WHERE track = 'regular'),
tg AS (SELECT season, team_id, game_id, row_number() OVER (PARTITION BY season, team_id ORDER BY game_date, game_id) AS j FROM (SELECT DISTINCT season, team_id, game_id, game_date FROM reg)),
seq AS (SELECT r.*, tg.j, row_number() OVER (PARTITION BY r.season, r.player_id ORDER BY r.game_date, r.game_id) AS i FROM reg r JOIN tg USING (season, team_id, game_id)),
b AS (SELECT point, season, player_id, max(i) AS b FROM seq, (SELECT unnest({list(POINTS)})::BIGINT AS point) WHERE j <= point GROUP BY ALL),
picked AS (SELECT point, season, player_id, rating_after AS rating, b, avg(rating_after) OVER (PARTITION BY point, season) AS mean FROM b JOIN seq USING (season, player_id) WHERE i = b),
aimed AS (SELECT point, season, player_id, any_value(rating) AS rating, any_value(mean) AS mean, count(perf) AS games, avg(perf) AS target FROM picked LEFT JOIN seq s USING (season, player_id) WHERE s.i > b AND s.i <= b + {WINDOW} GROUP BY ALL)"""


@query(f"WITH {_SAMPLED_SQL} SELECT r.point, r.season, r.player_id, round(r.rating, 4) AS rating, coalesce(a.games, 0) AS games, CASE WHEN a.games >= {LEAST} THEN round(a.target, 6) + 0e0 END AS target FROM picked r LEFT JOIN aimed a USING (point, season, player_id)")
def mid_season_samples(spark, sf):
    """Ratings after 21, 41 and 61 team games with what the next games brought, in one pass."""
    rows = sampled(events(spark, sf))
    return rows.select("point", "season", "player_id", F.round("rating", 4).alias("rating"), "games", (F.round("target", 6) + F.lit(0.0)).alias("target"))


_METRICS = "count(*) AS n, count(DISTINCT season) AS boundaries, round(avg(power(target - pred, 2)), 6) AS mse, round(avg(target * target), 6) AS baseline_mse, CASE WHEN stddev_pop(pred) * stddev_pop(target) > 0 THEN round(corr(pred, target), 6) END AS r, round(stddev_pop(pred), 6) AS pred_sd, round(stddev_pop(target), 6) AS target_sd, round(stddev_pop(pred) / nullif(stddev_pop(target), 0), 6) AS discrimination"


@query(f"""
WITH {_SAMPLED_SQL},
everything AS (
  SELECT 'game' || point AS sampling, season, (rating - mean) / 100e0 AS pred, target FROM aimed WHERE games >= {LEAST}
  UNION ALL SELECT 'season_end', boundary, pred, target FROM pairs)
SELECT sampling, {_METRICS} FROM everything GROUP BY sampling
""")
def cv_sampling_points(spark, sf):
    """The evaluation at all sampling points: mid-season against the next games of the season, its end against the next season's start."""
    log = events(spark, sf)
    mid = sampled_pairs(log).select(F.concat(F.lit("game"), F.col("point").cast("string")).alias("sampling"), "season", "pred", "target")
    end = pairs(log).select(F.lit("season_end").alias("sampling"), F.col("boundary").alias("season"), "pred", "target")
    out = metrics(mid.unionByName(end), "sampling")
    return out.select("sampling", "n", "boundaries", *[F.round(c, 6).alias(c) for c in ("mse", "baseline_mse", "r", "pred_sd", "target_sd", "discrimination")])


def team_ratings(team_games_: DataFrame, k: float = 20.0) -> DataFrame:
    """A team's rating at each season's end with the season's mean: 1500 plus k times its results above one half so far."""
    sums = team_games_.groupBy("season", "club").agg(F.sum(F.col("s_team") - 0.5).alias("gain"))
    so_far = F.sum("gain").over(Window.partitionBy("club").orderBy("season"))
    rows = sums.select("season", "club", (F.lit(1500.0) + k * so_far).alias("team_rating"))
    return rows.withColumn("league_mean", F.avg("team_rating").over(Window.partitionBy("season")))


def team_pairs(rows: DataFrame, ratings: DataFrame, log: DataFrame, scale: float = 100.0) -> DataFrame:
    """Each player inherits the season-end rating of the last club; the target is the next season's start."""
    last = rows.groupBy("season", "player_id").agg(F.max_by("club", F.struct("game_date", "game_id")).alias("club"))
    known = last.join(ratings, ["season", "club"]).select("season", "player_id", ((F.col("team_rating") - F.col("league_mean")) / scale).alias("pred"))
    next_ = targets(log).select((F.col("season") - 1).alias("season"), "player_id", "target")
    return known.join(next_, ["season", "player_id"])


@query(f"""
WITH {TARGET_SQL},
home AS (SELECT game_id, game_date, season, player_id, venue_id % 25 AS club, s_team FROM clean WHERE home),
gain AS (SELECT season, club, sum(s_team - 0.5e0) AS gain FROM (SELECT DISTINCT game_id, season, club, s_team FROM home) GROUP BY ALL),
rating AS (SELECT season, club, 1500 + 20 * sum(gain) OVER (PARTITION BY club ORDER BY season) AS team_rating FROM gain),
mean AS (SELECT *, avg(team_rating) OVER (PARTITION BY season) AS league_mean FROM rating),
last AS (SELECT season, player_id, arg_max(club, struct_pack(d := game_date, g := game_id)) AS club FROM home GROUP BY ALL),
tp AS (SELECT l.season, l.player_id, (m.team_rating - m.league_mean) / 100e0 AS pred, t.target FROM last l JOIN mean m USING (season, club) JOIN target t ON t.player_id = l.player_id AND t.season = l.season + 1)
SELECT season AS boundary, {_METRICS.replace("count(DISTINCT season) AS boundaries, ", "")} FROM tp GROUP BY season
""")
def team_pair_metrics(spark, sf):
    """How far a club's rating alone predicts its players' next season (home games name the club)."""
    home = performed(spark, sf).where("home").select("game_id", "game_date", "season", "player_id", (F.col("venue_id") % 25).alias("club"), "s_team")
    games = home.select("game_id", "season", "club", "s_team").distinct()
    rows = metrics(team_pairs(home, team_ratings(games), events(spark, sf)).withColumn("boundary", F.col("season")), "boundary").drop("boundaries")
    return rows.select("boundary", "n", *[F.round(c, 6).alias(c) for c in ("mse", "baseline_mse", "r", "pred_sd", "target_sd", "discrimination")])
