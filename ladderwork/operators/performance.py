"""Stateless per-game performance: everything of the rating that needs no rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.functions.scalar import k_effective
from ladderwork.functions.windows import zscore
from ladderwork.schema import PerformanceParams, RatingParams

#: Weights of the single-game score.
SCORE_WEIGHTS = {
    "points": 1.0, "shots_made": 0.4, "shots_tried": -0.7, "rebounds": 0.5, "assists": 0.7, "steals": 1.0, "blocks": 0.7, "fouls": -0.4,
}


def game_score() -> Column:
    """Weighted sum of the stats; a missing stat counts as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in SCORE_WEIGHTS.items()), F.lit(0.0))


def on_court_rate(p: PerformanceParams) -> Column:
    """Plus-minus per minute, shrunk by minutes; NULL without plus-minus or minutes.

    team_relative takes the team's rate off, on_off the rate of the team
    without the player.
    """
    team = Window.partitionBy("game_id", "team_id")
    pm, minutes = F.col("plus_minus"), F.col("minutes")
    rate = pm / F.nullif(minutes, F.lit(0.0))
    total_pm, total_min = F.sum(pm).over(team), F.sum(minutes).over(team)
    if p.mode == "team_relative":
        rate = rate - total_pm / F.nullif(total_min, F.lit(0.0))
    elif p.mode == "on_off":
        off = total_min - minutes
        rate = F.when(off > 0, rate - (total_pm - pm) / F.nullif(off, F.lit(0.0))).otherwise(0.0)
    return F.when(pm.isNotNull() & (minutes > 0), rate * minutes / (minutes + p.shrink_minutes))


def with_performance(rows: DataFrame, p: PerformanceParams = PerformanceParams()) -> DataFrame:
    """game_score, on_court, their z-scores in the game, and perf, the blend of both.

    In a game without any on-court value perf is the score's z alone; in
    others a missing value counts as 0 before it is standardised.
    """
    game = Window.partitionBy("game_id")
    out = rows.withColumn("game_score", game_score()).withColumn("on_court", on_court_rate(p))
    filled = F.coalesce(F.col("on_court"), F.lit(0.0))
    scores = {"z_score": F.col("game_score"), "z_on_court": filled}
    # Together, so that one window over the game gives all of them.
    out = out.withColumns({n: zscore(x, ["game_id"], p.sigma_floor) for n, x in scores.items()} | {"seen_": F.count("on_court").over(game) > 0})
    alpha = F.lit(p.alpha)
    if p.alpha_modern is not None:
        alpha = F.when(F.col("season") >= p.modern_from, p.alpha_modern).otherwise(p.alpha)
    blend = alpha * F.col("z_score") + (1 - alpha) * F.col("z_on_court")
    return out.withColumn("perf", F.when(F.col("seen_"), blend).otherwise(F.col("z_score"))).drop("seen_")


def checked(rows: DataFrame) -> DataFrame:
    """rows; a game whose shares of minutes do not sum to more than 0 is an error."""
    total = F.sum("share").over(Window.partitionBy("game_id"))
    fault = F.raise_error(F.concat(F.lit("game without a positive share of minutes: "), F.col("game_id").cast("string"))).cast("double")
    return rows.withColumn("total_share", total).withColumn("share", F.when(F.col("total_share") > 0, F.col("share")).otherwise(fault)).drop("total_share")


def with_games_before(rows: DataFrame, seed_games: Column | int = 0, reverse: bool = False) -> DataFrame:
    """games_before: games played need no fold, they are a row number."""
    order = ["game_date", "game_id"]
    order = [F.desc(c) for c in order] if reverse else order
    before = F.row_number().over(Window.partitionBy("player_id").orderBy(*order)) - 1
    seed = F.lit(seed_games) if isinstance(seed_games, int) else seed_games
    return rows.withColumn("games_before", (before + seed).cast("long"))


def step_size(p: RatingParams) -> Column:
    """k_eff of a row with games_before and track."""
    k = k_effective(p.k, F.col("games_before"), p.rookie_boost, p.rookie_tau)
    if p.rookie_ids is not None:
        k = F.when(F.col("player_id").isin(*p.rookie_ids), k).otherwise(F.lit(float(p.k)))
    return F.when(F.col("track") == "playoffs", k * p.playoff_multiplier).otherwise(k)


def with_steps(rows: DataFrame, p: RatingParams, seed_games: Column | int = 0, reverse: bool = False) -> DataFrame:
    """games_before and k_eff."""
    return with_games_before(rows, seed_games, reverse).withColumn("k_eff", step_size(p))


def draft_start(picks: DataFrame, first: float = 1580.0, slope: float = 5.0, floor: float = 1350.0) -> DataFrame:
    """Start rating by best draft pick; undrafted players get the floor."""
    best = picks.groupBy("player_id").agg(F.min("pick").alias("pick"))
    start = F.when(F.col("pick").isNull(), floor).otherwise(F.greatest(F.lit(first) - (F.col("pick") - 1) * slope, F.lit(floor)))
    return best.select("player_id", "pick", start.alias("start_rating"))
