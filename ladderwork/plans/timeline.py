"""Warehouse layer: season ratings, snapshots, timelines.

The queries run on a stateless surrogate rating, 1500 plus the running sum of
performance, so that their twins stay plain SQL; the operators take any event
log with the same columns, the fold's too (rating_season_table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.functions.scalar import all_star_cutoff
from ladderwork.functions.windows import global_rank, latest
from ladderwork.operators import fold
from ladderwork.plans.folds import BASE
from ladderwork.plans.performance import PERF_SQL, performed
from ladderwork.plans.registry import query
from ladderwork.sources.warehouse import maybe_broadcast, written

EVENTS_SQL = f"""{PERF_SQL},
ev AS (
  SELECT 'all' AS variant, game_id, game_date, season, track, player_id, team_id,
    1500 + sum(perf) OVER (PARTITION BY player_id ORDER BY game_date, game_id) AS rating_after, perf FROM perf),
ending AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, player_id ORDER BY game_date DESC, game_id DESC) AS k FROM ev) WHERE k = 1)"""


def events(spark, sf, *carried: str) -> DataFrame:
    """The surrogate log; further columns of the rows may be carried along."""
    running = Window.partitionBy("player_id").orderBy("game_date", "game_id")
    rows = performed(spark, sf)
    return rows.select(
        F.lit("all").alias("variant"), "game_id", "game_date", "season", "track", "player_id", "team_id",
        (F.lit(1500.0) + F.sum("perf").over(running)).alias("rating_after"), "perf", *carried,
    )


def season_ratings(log: DataFrame) -> DataFrame:
    """Last rating per variant, season and player with its rank (ties share one) and the season's mean."""
    last = latest(log.select("variant", "season", "player_id", "game_date", "game_id", "rating_after"), ["variant", "season", "player_id"], ["game_date", "game_id"])
    group = Window.partitionBy("variant", "season")
    return last.withColumn("place", F.rank().over(group.orderBy(F.round("rating_after", 6).desc())).cast("long")).withColumn("league_mean", F.avg("rating_after").over(group))


def as_of(log: DataFrame, cutoff) -> DataFrame:
    """State after the last event up to the cutoff date; players not yet seen do not appear."""
    return latest(log.where(F.to_date("game_date") <= cutoff), ["variant", "player_id"], ["game_date", "game_id"])


@query(f"WITH {EVENTS_SQL} SELECT season, player_id, round(rating_after, 4) AS rating FROM ending")
def end_of_season(spark, sf):
    return season_ratings(events(spark, sf)).select("season", "player_id", F.round("rating_after", 4).alias("rating"))


@query(f"""
WITH {EVENTS_SQL}
SELECT season, season + 1 AS display_season, player_id, rank() OVER (PARTITION BY season ORDER BY round(rating_after, 6) DESC) AS place,
  dense_rank() OVER (PARTITION BY season ORDER BY round(rating_after, 6) DESC) AS dense_place, round(avg(rating_after) OVER (PARTITION BY season), 4) AS league_mean FROM ending
""")
def season_ratings_rank(spark, sf):
    dense = F.dense_rank().over(Window.partitionBy("season").orderBy(F.round("rating_after", 6).desc())).cast("long")
    return season_ratings(events(spark, sf)).withColumn("dense_place", dense).select(
        "season", (F.col("season") + 1).alias("display_season"), "player_id", "place", "dense_place", F.round("league_mean", 4).alias("league_mean")
    )


def _snapshot(cut: str, condition: str = "true") -> str:
    return f"""
WITH {EVENTS_SQL},
cuts AS (SELECT DISTINCT season AS cut_season, {cut} AS cut_date FROM perf WHERE {condition}),
seen AS (SELECT c.cut_season, e.*, row_number() OVER (PARTITION BY c.cut_season, e.player_id ORDER BY game_date DESC, game_id DESC) AS k
  FROM ev e JOIN cuts c ON CAST(e.game_date AS DATE) <= c.cut_date)
SELECT cut_season, player_id, round(rating_after, 4) AS rating FROM seen WHERE k = 1
"""


def snapshots(log: DataFrame, cuts: DataFrame) -> DataFrame:
    """as_of() for many cutoffs at once: each event counts from the first cutoff that is not before it.

    That cutoff is looked up by day, over the few days; a player's last state
    before a cutoff holds until the cutoff before the player's next one, and
    is laid out over these numbers only.
    """
    order = Window.orderBy("cut_date")  # a row a season
    dates = cuts.select("cut_season", "cut_date", F.row_number().over(order).alias("i"), F.count("*").over(Window.partitionBy()).alias("of"))
    dates = written(dates, "cutoffs")
    days = log.select(F.to_date("game_date").alias("day"), F.lit(None).cast("int").alias("i")).distinct()
    marks = days.unionByName(dates.select(F.col("cut_date").alias("day"), "i"))
    following = F.first("i", True).over(Window.orderBy("day", F.col("i").isNotNull()).rowsBetween(0, Window.unboundedFollowing))  # a row a day
    first_cut = marks.withColumn("first", following).where("i is null and first is not null").select("day", F.col("first").alias("i"))
    rows = log.select("player_id", "game_date", "game_id", "rating_after", F.to_date("game_date").alias("day")).join(maybe_broadcast(first_cut), "day")
    last = latest(rows.select("i", "player_id", "game_date", "game_id", "rating_after"), ["i", "player_id"], ["game_date", "game_id"])
    last = last.join(F.broadcast(dates.select(F.max("of").alias("of"))))  # one row
    until = F.coalesce(F.lead("i").over(Window.partitionBy("player_id").orderBy("i")) - 1, F.col("of").cast("int"))
    held = last.withColumn("until", until).withColumn("i", F.explode(F.sequence("i", "until")))
    return held.join(F.broadcast(dates.select("cut_season", "i")), "i").select("cut_season", "player_id", F.col("rating_after").alias("rating"))


def seasonal_snapshots(spark, sf, column):
    """Snapshots at a date of each season; the log is written once, for its seasons, days and rows."""
    log = written(events(spark, sf).select("season", "player_id", "game_date", "game_id", "rating_after"), "snapshot-log")
    cuts = log.select(F.col("season").alias("cut_season")).distinct().withColumn("cut_date", column)
    return _rounded(snapshots(log, cuts))


def _rounded(df):
    return df.select("cut_season", "player_id", F.round("rating", 4).alias("rating"))


@query(_snapshot("make_date(season + 1, 2, 1)"))
def snapshot_feb1(spark, sf):
    return seasonal_snapshots(spark, sf, F.make_date(F.col("cut_season").cast("int") + 1, F.lit(2), F.lit(1)))


@query(_snapshot("CASE WHEN season = 1998 THEN DATE '1999-02-14' WHEN season = 2020 THEN DATE '2021-03-01' ELSE make_date(season + 1, 2, 1) END"))
def snapshot_special_cutoff(spark, sf):
    return seasonal_snapshots(spark, sf, all_star_cutoff(F.col("cut_season")))


@query(f"""
WITH {EVENTS_SQL}
SELECT player_id, round(rating_after, 4) AS rating, n AS games_played FROM (
  SELECT player_id, rating_after, count(*) OVER (PARTITION BY player_id) AS n, row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) AS k
  FROM ev WHERE season <= 1997) WHERE k = 1
""")
def checkpoint_state(spark, sf):
    rows = events(spark, sf).where("season <= 1997")
    return rows.groupBy("player_id").agg(F.round(F.max_by("rating_after", F.struct("game_date", "game_id")), 4).alias("rating"), F.count("*").alias("games_played"))


def variant_timeline(log: DataFrame, split: int) -> DataFrame:
    """Shared events up to the split belong to both tracks, later ones to their own: a union of two scans."""
    shared = log.where(F.col("season") <= split)
    both = shared.withColumn("variant", F.explode(F.array(F.lit("regular"), F.lit("playoffs"))))
    own = log.where((F.col("season") > split) & F.col("track").isin("regular", "playoffs")).withColumn("variant", F.col("track"))
    return both.unionByName(own)


_TIMELINE = f"""{EVENTS_SQL},
tl AS (
  SELECT v AS tl_variant, e.* FROM ev e JOIN (SELECT unnest(['regular', 'playoffs']) AS v) ON season <= 1996 OR track = v)"""


@query(f"WITH {_TIMELINE} SELECT tl_variant AS variant, season, count(*) AS updates, count(DISTINCT player_id) AS players FROM tl GROUP BY ALL", name="variant_timeline")
def variant_timeline_counts(spark, sf):
    return variant_timeline(events(spark, sf), 1996).groupBy("variant", "season").agg(F.count("*").alias("updates"), F.countDistinct("player_id").alias("players"))


@query(f"""
WITH {_TIMELINE},
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tl_variant, season, player_id ORDER BY game_date DESC, game_id DESC) AS k FROM tl) WHERE k = 1)
SELECT season, player_id, round(a.rating_after, 4) AS regular, round(b.rating_after, 4) AS playoffs, round(b.rating_after - a.rating_after, 4) + 0e0 AS gap
FROM last a JOIN last b USING (season, player_id) WHERE a.tl_variant = 'regular' AND b.tl_variant = 'playoffs'
""")
def dual_track(spark, sf):
    """Both tracks of a player's season side by side: a pivot, not a self-join."""
    table = season_ratings(variant_timeline(events(spark, sf), 1996))
    wide = table.groupBy("season", "player_id").pivot("variant", ["regular", "playoffs"]).agg(F.max("rating_after"))
    both = wide.where("regular is not null and playoffs is not null")
    return both.select("season", "player_id", F.round("regular", 4).alias("regular"), F.round("playoffs", 4).alias("playoffs"), (F.round(F.col("playoffs") - F.col("regular"), 4) + F.lit(0.0)).alias("gap"))


@query(f"""
WITH {EVENTS_SQL}
SELECT player_id, rank() OVER (ORDER BY round(rating_after, 6) DESC) AS place, round(rating_after, 4) AS rating FROM (
  SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) AS k2 FROM ev WHERE CAST(game_date AS DATE) <= DATE '1997-03-15') WHERE k2 = 1
""")
def rank_as_of(spark, sf):
    state = as_of(events(spark, sf), F.lit("1997-03-15").cast("date"))
    ranked = global_rank(state.withColumn("shown", F.round("rating_after", 6)), "shown", "place", 5.0)
    return ranked.select("player_id", "place", F.round("rating_after", 4).alias("rating"))


@query(f"""
WITH {EVENTS_SQL}
SELECT player_id, game_id, row_number() OVER w AS nth, round(rating_after, 4) AS rating, round(rating_after - lag(rating_after) OVER w, 4) + 0e0 AS change FROM ev WINDOW w AS (PARTITION BY player_id ORDER BY game_date, game_id)
""")
def player_timeline(spark, sf):
    w = Window.partitionBy("player_id").orderBy("game_date", "game_id")
    change = F.round(F.col("rating_after") - F.lag("rating_after").over(w), 4) + F.lit(0.0)
    return events(spark, sf).select("player_id", "game_id", F.row_number().over(w).cast("long").alias("nth"), F.round("rating_after", 4).alias("rating"), change.alias("change"))


@query(f"""
WITH {PERF_SQL}
SELECT season, player_id, round(sum(CASE WHEN seen > 0 THEN 0.7e0 * z_score ELSE z_score END), 4) + 0e0 AS from_score,
  round(sum(CASE WHEN seen > 0 THEN 0.3e0 * z_on_court ELSE 0 END), 4) + 0e0 AS from_on_court, round(sum(perf), 4) + 0e0 AS total FROM perf GROUP BY ALL
""")
def explain_change(spark, sf):
    """A season's change of the surrogate, by source."""
    rows = performed(spark, sf)
    court = 0.3 * F.col("z_on_court")
    seen = F.count("on_court").over(Window.partitionBy("game_id")) > 0
    rows = rows.withColumn("court", F.when(seen, court).otherwise(0.0)).withColumn("score", F.col("perf") - F.col("court"))
    out = lambda c, name: (F.round(F.sum(c), 4) + F.lit(0.0)).alias(name)
    return rows.groupBy("season", "player_id").agg(out("score", "from_score"), out("court", "from_on_court"), out("perf", "total"))


@query()
def rating_season_table(spark, sf):
    """Season table of the fold's own log; its log and checkpoint have recursive twins."""
    return season_ratings(fold.rating_updates(performed(spark, sf), [BASE], columns=["season", "game_date", "game_id", *fold.STATE])).select("season", "player_id", "place", F.round("rating_after", 4).alias("rating"))
