"""Analytical reports: eras, teams, stages, pools, peaks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ladderwork.functions import scalar, selection, stats
from ladderwork.functions.windows import centred_mean
from ladderwork.plans.performance import PERF_SQL, performed
from ladderwork.plans.registry import query
from ladderwork.plans.timeline import EVENTS_SQL, events, season_ratings
from ladderwork.sources import arena
from ladderwork.sources.arena import CLEAN_SQL, read


def zero(column):
    """No negative zero in a published number."""
    return column + F.lit(0.0)


def table(spark, sf):
    minutes = performed(spark, sf).groupBy("season", "player_id").agg(F.sum("minutes").alias("minutes"), F.count("*").alias("games"))
    return season_ratings(events(spark, sf)).join(minutes, ["season", "player_id"])


TABLE_SQL = f"""{EVENTS_SQL},
table_ AS (SELECT e.season, e.player_id, e.rating_after, m.minutes, m.games, rank() OVER (PARTITION BY e.season ORDER BY round(e.rating_after, 6) DESC) AS place
  FROM ending e JOIN (SELECT season, player_id, sum(minutes) AS minutes, count(*) AS games FROM clean GROUP BY ALL) m USING (season, player_id))"""


@query(f"""
WITH {TABLE_SQL},
r AS (SELECT *, sum(minutes) OVER (PARTITION BY season ORDER BY rating_after RANGE UNBOUNDED PRECEDING) AS running, sum(minutes) OVER (PARTITION BY season) AS total FROM table_ WHERE minutes > 0)
SELECT season, round(min(rating_after) FILTER (running >= 0.1e0 * total), 4) AS q10, round(min(rating_after) FILTER (running >= 0.5e0 * total), 4) AS q50, round(min(rating_after) FILTER (running >= 0.9e0 * total), 4) AS q90 FROM r GROUP BY season
""")
def era_weighted_quantiles(spark, sf):
    out = stats.weighted_quantiles(table(spark, sf), ["season"], "rating_after", "minutes", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return out.select("season", *[F.round(c, 4).alias(c) for c in ("q10", "q50", "q90")])


@query(f"WITH {TABLE_SQL} SELECT season, count(*) AS n, round(stddev_pop(rating_after), 4) AS spread, round(avg(power((rating_after - m) / sd, 3)), 4) + 0e0 AS skew, round(avg(CASE WHEN rating_after > 1500 THEN 1e0 ELSE 0e0 END), 6) AS above FROM (SELECT *, avg(rating_after) OVER w AS m, stddev_pop(rating_after) OVER w AS sd FROM table_ WINDOW w AS (PARTITION BY season)) GROUP BY season")
def tail_widths(spark, sf):
    return table(spark, sf).groupBy("season").agg(
        F.count("*").alias("n"), F.round(F.stddev_pop("rating_after"), 4).alias("spread"), zero(F.round(F.skewness("rating_after"), 4)).alias("skew"),
        F.round(F.avg((F.col("rating_after") > 1500).cast("double")), 6).alias("above"),
    )


@query(f"""
WITH {EVENTS_SQL}, r AS (SELECT e.game_id, e.team_id, e.season, e.player_id, e.rating_after, c.share, row_number() OVER (PARTITION BY e.game_id, e.team_id ORDER BY c.share DESC, e.player_id) AS k FROM ev e JOIN clean c USING (game_id, player_id))
SELECT game_id, team_id, round(sum(rating_after * share) / sum(share), 4) AS strength, round(sum(rating_after * share) FILTER (k <= 2) / sum(share) FILTER (k <= 2), 4) AS top2, round(avg(rating_after) FILTER (k <= 3), 4) AS top3 FROM r GROUP BY ALL
""")
def team_game_strength(spark, sf):
    rows = events(spark, sf, "share")
    k = F.row_number().over(Window.partitionBy("game_id", "team_id").orderBy(F.desc("share"), "player_id"))
    rows = rows.withColumn("k", k)
    two = F.when(F.col("k") <= 2, F.col("share"))
    return rows.groupBy("game_id", "team_id").agg(
        F.round(stats.weighted_mean(F.col("rating_after"), F.col("share")), 4).alias("strength"),
        F.round(F.sum(F.col("rating_after") * two) / F.sum(two), 4).alias("top2"), F.round(F.avg(F.when(F.col("k") <= 3, F.col("rating_after"))), 4).alias("top3"),
    )


_CORE = f"""{CLEAN_SQL},
m AS (SELECT season, venue_id % 25 AS club, player_id, sum(minutes) AS minutes FROM clean WHERE home GROUP BY ALL),
core AS (SELECT *, row_number() OVER (PARTITION BY season, club ORDER BY minutes DESC, player_id) AS k FROM m)"""


def cores(spark, sf, size):
    m = arena.clean(spark, sf).where("home").groupBy("season", (F.col("venue_id") % 25).alias("club"), "player_id").agg(F.sum("minutes").alias("minutes"))
    k = F.row_number().over(Window.partitionBy("season", "club").orderBy(F.desc("minutes"), "player_id"))
    return m.withColumn("k", k).where(F.col("k") <= size)


@query(f"WITH {_CORE} SELECT season, club, string_agg(CAST(player_id AS VARCHAR), ' / ' ORDER BY k) AS core, round(sum(minutes), 4) AS minutes FROM core WHERE k <= 5 GROUP BY ALL")
def top_n_cores(spark, sf):
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "player_id"))), lambda x: x["player_id"].cast("string")), " / ")
    return cores(spark, sf, 5).groupBy("season", "club").agg(names.alias("core"), F.round(F.sum("minutes"), 4).alias("minutes"))


@query(f"WITH {_CORE} SELECT player_id, count(*) AS times FROM core WHERE k <= 5 GROUP BY player_id ORDER BY times DESC, player_id LIMIT 12")
def core_frequency(spark, sf):
    """A top-12 report."""
    return cores(spark, sf, 5).groupBy("player_id").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "player_id").limit(12)


@query(f"""
WITH {PERF_SQL}, s AS (SELECT season, player_id, avg(perf) FILTER (track = 'regular') AS a, avg(perf) FILTER (track = 'playoffs') AS b FROM perf GROUP BY ALL)
SELECT season, player_id, round(a, 6) + 0e0 AS regular, round(b, 6) + 0e0 AS playoffs, CASE WHEN a >= 0 AND b >= 0 THEN 'Q1' WHEN a < 0 AND b >= 0 THEN 'Q2' WHEN a < 0 AND b < 0 THEN 'Q3' WHEN a >= 0 AND b < 0 THEN 'Q4' END AS quadrant FROM s
""")
def stage_change_pivot(spark, sf):
    wide = performed(spark, sf).groupBy("season", "player_id").pivot("track", ["regular", "playoffs"]).agg(F.avg("perf"))
    q = scalar.quadrant(F.col("regular"), F.col("playoffs"))
    return wide.select("season", "player_id", zero(F.round("regular", 6)).alias("regular"), zero(F.round("playoffs", 6)).alias("playoffs"), q.alias("quadrant"))


@query(f"""
WITH {PERF_SQL}, s AS (SELECT season, player_id, avg(perf) FILTER (track = 'regular') AS a, avg(perf) FILTER (track = 'playoffs') AS b FROM perf GROUP BY ALL),
q AS (SELECT season, CASE WHEN a >= 0 AND b >= 0 THEN 'Q1' WHEN a < 0 AND b >= 0 THEN 'Q2' WHEN a < 0 AND b < 0 THEN 'Q3' WHEN a >= 0 AND b < 0 THEN 'Q4' END AS quadrant FROM s)
SELECT season, quadrant, count(*) AS n, round(count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY season), 6) AS part FROM q WHERE quadrant IS NOT NULL GROUP BY season, quadrant
""")
def quadrants(spark, sf):
    """Crosstab with shares by row."""
    rows = stage_change_pivot(spark, sf).where("quadrant is not null").groupBy("season", "quadrant").agg(F.count("*").alias("n"))
    return rows.withColumn("part", F.round(F.col("n") * 1.0 / F.sum("n").over(Window.partitionBy("season")), 6))


@query(f"""
WITH {PERF_SQL}, v AS (SELECT player_id, max(perf) FILTER (track = 'regular') AS base, max(perf) FILTER (track <> 'excluded') AS other FROM perf GROUP BY player_id)
SELECT player_id, round(base, 6) AS base, round(other, 6) AS other, CASE WHEN base IS NULL AND other IS NULL THEN 'absent' WHEN base IS NULL THEN 'new' WHEN other IS NULL THEN 'gone' WHEN (other - base) / nullif(base, 0) > 0.01 THEN 'up' WHEN (other - base) / nullif(base, 0) < -0.01 THEN 'down' ELSE 'same' END AS lift FROM v
""")
def pk_lift(spark, sf):
    v = performed(spark, sf).groupBy("player_id").agg(F.max(F.when(F.col("track") == "regular", F.col("perf"))).alias("base"), F.max(F.when(F.col("track") != "excluded", F.col("perf"))).alias("other"))
    return v.select("player_id", F.round("base", 6).alias("base"), F.round("other", 6).alias("other"), scalar.lift_class(F.col("base"), F.col("other")).alias("lift"))


@query(f"""
WITH {EVENTS_SQL}, n AS (SELECT player_id, rating_after, row_number() OVER (PARTITION BY player_id ORDER BY rating_after DESC, game_date, game_id) AS k, count(*) OVER (PARTITION BY player_id) AS n, game_id, season FROM ev)
SELECT player_id, round(max(rating_after), 4) AS peak, max(game_id) FILTER (k = 1) AS peak_game, round(avg(rating_after) FILTER (k <= ceil(n * 0.05)), 4) AS top_mean FROM n GROUP BY player_id
""")
def career_peaks(spark, sf):
    w = Window.partitionBy("player_id")
    rows = events(spark, sf).withColumn("k", F.row_number().over(w.orderBy(F.desc("rating_after"), "game_date", "game_id"))).withColumn("n", F.count("*").over(w))
    return rows.groupBy("player_id").agg(
        F.round(F.max("rating_after"), 4).alias("peak"), F.max(F.when(F.col("k") == 1, F.col("game_id"))).alias("peak_game"),
        F.round(F.avg(F.when(F.col("k") <= F.ceil(F.col("n") * 0.05), F.col("rating_after"))), 4).alias("top_mean"),
    )


@query(f"""
WITH {TABLE_SQL},
p AS (SELECT season, player_id, (rank() OVER (PARTITION BY season ORDER BY rating_after) + (count(*) OVER (PARTITION BY season, rating_after) - 1) / 2e0) / count(*) OVER (PARTITION BY season) AS pct FROM table_),
t AS (SELECT season, player_id, CASE WHEN pct >= 0.9 THEN 'elite' WHEN pct >= 0.5 THEN 'upper' ELSE 'lower' END AS tier FROM p)
SELECT a.season, a.tier, b.tier AS next_tier, count(*) AS n FROM t a LEFT JOIN t b ON a.player_id = b.player_id AND b.season = a.season + 1 GROUP BY ALL
""")
def tier_movement(spark, sf):
    from ladderwork.functions.windows import average_rank

    pct = average_rank(F.col("rating_after"), ["season"]) / F.count("*").over(Window.partitionBy("season"))
    tier = F.when(pct >= 0.9, "elite").when(pct >= 0.5, "upper").otherwise("lower")
    rows = table(spark, sf).select("season", "player_id", tier.alias("tier"))
    later = rows.select((F.col("season") - 1).alias("season"), "player_id", F.col("tier").alias("next_tier"))
    return rows.join(later, ["season", "player_id"], "left").groupBy("season", "tier", "next_tier").agg(F.count("*").alias("n"))


@query(f"WITH {CLEAN_SQL} SELECT season, count(DISTINCT player_id) AS players, count(DISTINCT (game_id, team_id)) AS team_games, count(*) AS appearances, round(sum(least(coalesce(plus_minus, 0), 0)), 4) + 0e0 AS negative_sum FROM clean GROUP BY season")
def participants_effect(spark, sf):
    return arena.clean(spark, sf).groupBy("season").agg(
        F.countDistinct("player_id").alias("players"), F.countDistinct("game_id", "team_id").alias("team_games"), F.count("*").alias("appearances"),
        zero(F.round(F.sum(F.least(F.coalesce("plus_minus", F.lit(0.0)), F.lit(0.0))), 4)).alias("negative_sum"),
    )


@query(f"""
WITH {TABLE_SQL}, pk AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY round(rating_after, 6) DESC, season) AS k FROM table_)
SELECT CASE WHEN season < 1996 THEN 'early' WHEN season < 1999 THEN 'middle' ELSE 'late' END AS era, CASE WHEN place < 2 THEN '1' WHEN place < 11 THEN '2-10' WHEN place < 51 THEN '11-50' ELSE 'below' END AS band, count(*) AS n FROM pk WHERE k = 1 GROUP BY ALL
""")
def contemporaneous_rank(spark, sf):
    """Place of players in the season of their own peak, in bands."""
    best = table(spark, sf).groupBy("player_id").agg(F.max_by(F.struct("season", "place"), F.struct(F.round("rating_after", 6), -F.col("season"))).alias("p"))
    era = scalar.cut(F.col("p.season"), [0, 1996, 1999, 9999], ["early", "middle", "late"])
    band = scalar.cut(F.col("p.place"), [0, 2, 11, 51, 10**9], ["1", "2-10", "11-50", "below"])
    return best.groupBy(era.alias("era"), band.alias("band")).agg(F.count("*").alias("n"))


@query(f"""
WITH {TABLE_SQL}, q AS (SELECT player_id, count(*) FILTER (games >= 60) AS loose, count(*) FILTER (games >= 75) AS strict, string_agg(CAST(season AS VARCHAR), '; ' ORDER BY season) FILTER (games >= 60 AND games < 75) AS between_ FROM table_ GROUP BY player_id)
SELECT *, loose >= 5 AS loose_ok, strict >= 5 AS strict_ok FROM q
""")
def qualifying_seasons(spark, sf):
    games = F.col("games")
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.when((games >= 60) & (games < 75), F.col("season")))), lambda x: x.cast("string")), "; ")
    q = table(spark, sf).groupBy("player_id").agg(F.count_if(games >= 60).alias("loose"), F.count_if(games >= 75).alias("strict"), F.nullif(ordered, F.lit("")).alias("between_"))
    return q.withColumn("loose_ok", F.col("loose") >= 5).withColumn("strict_ok", F.col("strict") >= 5)


@query("""
WITH f AS (SELECT o_custkey AS player_id, min(year(o_orderdate)) AS first_season, max(o_orderdate) AS last_game, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(y AS BIGINT) AS centre, count(*) AS players, round(avg(CASE WHEN n >= 12 THEN 1e0 ELSE 0e0 END), 6) AS busy_share FROM f JOIN (SELECT DISTINCT year(o_orderdate) AS y FROM orders) ON first_season BETWEEN y - 2 AND y + 2 GROUP BY y
""")
def cohort_share_5y(spark, sf):
    """Centred five-year cohorts: each first season belongs to five centres, an equi-join instead of a range join."""
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("y"))
    firsts = orders.groupBy("player_id").agg(F.min("y").alias("first_season"), F.count("*").alias("n"))
    spread = firsts.withColumn("y", F.explode(F.sequence(F.col("first_season") - 2, F.col("first_season") + 2)))
    rows = spread.join(F.broadcast(orders.select("y").distinct()), "y", "left_semi")
    return rows.groupBy(F.col("y").cast("long").alias("centre")).agg(F.count("*").alias("players"), F.round(F.avg((F.col("n") >= 12).cast("double")), 6).alias("busy_share"))


@query(f"""
WITH {TABLE_SQL}, pk AS (SELECT player_id, max(rating_after) AS peak, count(*) AS seasons, sum(games) AS games FROM table_ GROUP BY player_id)
SELECT CASE WHEN peak < 1500 THEN 'under' WHEN peak < 1520 THEN 'mid' ELSE 'high' END AS level, CAST(games % 3 AS BIGINT) AS kind, count(*) AS n, round(count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY CASE WHEN peak < 1500 THEN 'under' WHEN peak < 1520 THEN 'mid' ELSE 'high' END), 6) AS part
FROM pk GROUP BY 1, 2
""".replace("count(*)) OVER (PARTITION BY CASE WHEN peak < 1500 THEN 'under' WHEN peak < 1520 THEN 'mid' ELSE 'high' END)", "count(*)) OVER (PARTITION BY level)"))
def mix_by_peak(spark, sf):
    pk = table(spark, sf).groupBy("player_id").agg(F.max("rating_after").alias("peak"), F.sum("games").alias("games"))
    level = F.when(F.col("peak") < 1500, "under").when(F.col("peak") < 1520, "mid").otherwise("high")
    rows = pk.groupBy(level.alias("level"), (F.col("games") % 3).alias("kind")).agg(F.count("*").alias("n"))
    return rows.withColumn("part", F.round(F.col("n") * 1.0 / F.sum("n").over(Window.partitionBy("level")), 6))


@query(f"WITH {TABLE_SQL} SELECT season, round(min(rating_after), 4) AS low, round(quantile_cont(rating_after, 0.25), 4) AS q25, round(median(rating_after), 4) AS mid, round(quantile_cont(rating_after, 0.75), 4) AS q75, round(max(rating_after), 4) AS high FROM table_ GROUP BY season")
def box_quantiles(spark, sf):
    out = selection.described(table(spark, sf), ["season"], "rating_after", {"q25": 0.25, "mid": 0.5, "q75": 0.75})
    return out.select("season", *[F.round(c, 4).alias(n) for c, n in (("least", "low"), ("q25", "q25"), ("mid", "mid"), ("q75", "q75"), ("greatest", "high"))])


_ERA = "CASE WHEN season < 1994 THEN '1991-93' WHEN season < 1997 THEN '1994-96' ELSE '1997-' END"
_SHARES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def _distribution_sql(key: str) -> str:
    weighted = ", ".join(f"min(rating_after) FILTER (running >= {q}e0 * total) AS {n}" for n, q in _SHARES.items())
    return f"""
WITH {TABLE_SQL},
k AS (SELECT {key} AS period, rating_after, minutes FROM table_),
r AS (SELECT *, sum(minutes) OVER (PARTITION BY period ORDER BY rating_after RANGE UNBOUNDED PRECEDING) AS running, sum(minutes) OVER (PARTITION BY period) AS total FROM k WHERE minutes > 0),
q AS (SELECT period, {weighted} FROM r GROUP BY period),
s AS (SELECT period, count(*) AS n, sum(rating_after * minutes) / sum(minutes) AS weighted_mean, avg(rating_after) AS mean, median(rating_after) AS median, stddev_pop(rating_after) AS sd, max(rating_after) AS top FROM k GROUP BY period)
SELECT period, n, {", ".join(f"round({c}, 4) AS {c}" for c in ("weighted_mean", *_SHARES, "mean", "median", "sd", "top"))}, round(p90 - p10, 4) AS width, round(top - p50, 4) AS lead FROM s JOIN q USING (period)
"""


def distribution(rows, key):
    """Moments, quantiles by minutes, the middle by heads and the top of each period."""
    rows = rows.select(key.alias("period"), "rating_after", "minutes")
    moments = rows.groupBy("period").agg(
        F.count("*").alias("n"), stats.weighted_mean(F.col("rating_after"), F.col("minutes")).alias("weighted_mean"), F.avg("rating_after").alias("mean"),
        F.stddev_pop("rating_after").alias("sd"), F.max("rating_after").alias("top"),
    )
    shares = stats.weighted_quantiles(rows, ["period"], "rating_after", "minutes", _SHARES)
    middle = selection.quantiles(rows, ["period"], "rating_after", {"median": 0.5})
    out = moments.join(shares, "period").join(middle, "period").withColumn("width", F.col("p90") - F.col("p10")).withColumn("lead", F.col("top") - F.col("p50"))
    return out.select("period", "n", *[F.round(c, 4).alias(c) for c in ("weighted_mean", *_SHARES, "mean", "median", "sd", "top", "width", "lead")])


@query(_distribution_sql("season"))
def season_distribution(spark, sf):
    return distribution(table(spark, sf), F.col("season"))


@query(_distribution_sql(_ERA))
def era_distribution(spark, sf):
    return distribution(table(spark, sf), scalar.cut(F.col("season"), [0, 1994, 1997, 9999], ["1991-93", "1994-96", "1997-"]))


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, min(value) AS least, round(quantile_cont(value, 0.05), 4) AS p05,
  round(median(value), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, max(value) AS greatest FROM events GROUP BY event_type HAVING count(value) > 0
""")
def describe_values(spark, sf):
    """Description of a column by type: few large groups, found by selection."""
    out = selection.described(read(spark, sf, "events"), ["event_type"], "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return out.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd")], "least", *[F.round(c, 4).alias(c) for c in ("p05", "p50", "p95")], "greatest")


@query("""
WITH r AS (SELECT l_returnflag, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice RANGE UNBOUNDED PRECEDING) AS running, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS total FROM lineitem WHERE l_quantity > 0)
SELECT l_returnflag, min(l_extendedprice) FILTER (running >= 0.1e0 * total) AS p10, min(l_extendedprice) FILTER (running >= 0.5e0 * total) AS p50, min(l_extendedprice) FILTER (running >= 0.99e0 * total) AS p99 FROM r GROUP BY l_returnflag
""")
def price_quantiles(spark, sf):
    """Quantiles of prices by quantity over all lines, three groups of any size."""
    return stats.weighted_quantiles(read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", {"p10": 0.1, "p50": 0.5, "p99": 0.99})


@query(f"""
WITH {CLEAN_SQL}, c AS (SELECT player_id, count(*) AS games FROM clean GROUP BY 1), s AS (SELECT t, count(*) AS players FROM range(450, 560, 10) r(t) JOIN c ON games >= t GROUP BY t)
SELECT CAST(t AS BIGINT) AS threshold, players, players - lead(players) OVER (ORDER BY t) AS lost_next FROM s
""")
def survival_table(spark, sf):
    """Players at or above each threshold: every player counts once, at the highest; the rest is a short running sum."""
    c = arena.clean(spark, sf).groupBy("player_id").agg(F.count("*").alias("games"))
    top = c.where("games >= 450").select((F.least(F.lit(550), F.floor(F.col("games") / 10) * 10)).cast("long").alias("threshold"))
    spine = spark.range(450, 560, 10).select(F.col("id").alias("threshold"))
    n = spine.join(top.groupBy("threshold").agg(F.count("*").alias("n")), "threshold", "left")
    up = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    rows = n.withColumn("players", F.coalesce(F.sum("n").over(up), F.lit(0))).where("players > 0")
    return rows.select("threshold", "players", (F.col("players") - F.lead("players").over(Window.orderBy("threshold"))).alias("lost_next"))


@query(f"""
WITH {CLEAN_SQL}, s AS (SELECT season, count(DISTINCT game_id) AS games, count(DISTINCT player_id) AS players FROM clean GROUP BY season)
SELECT season, games, round(avg(games) OVER w, 4) AS games_mean, CASE WHEN count(games) OVER w >= 3 THEN round(avg(players) OVER w, 4) END AS players_mean FROM s WINDOW w AS (ORDER BY season ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
""")
def season_rolling_mean(spark, sf):
    s = arena.clean(spark, sf).groupBy("season").agg(F.countDistinct("game_id").alias("games"), F.countDistinct("player_id").alias("players"))
    return s.select("season", "games", F.round(centred_mean(F.col("games"), [], ["season"], 2), 4).alias("games_mean"), F.round(centred_mean(F.col("players"), [], ["season"], 2, 3), 4).alias("players_mean"))


@query(f"""
WITH {CLEAN_SQL}, t AS (SELECT season, track, team_id, count(DISTINCT game_id) AS games, round(avg(team_score), 4) AS score FROM clean GROUP BY GROUPING SETS ((season, track, team_id), (season, team_id), (season)))
SELECT season, coalesce(track, 'all') AS track, coalesce(team_id, 'all') AS team, games, score FROM t
""")
def team_splits(spark, sf):
    """Season, track and team splits in one pass over grouping sets."""
    rows = arena.clean(spark, sf)
    sets = rows.groupingSets([["season", "track", "team_id"], ["season", "team_id"], ["season"]], "season", "track", "team_id")
    out = sets.agg(F.countDistinct("game_id").alias("games"), F.round(F.avg("team_score"), 4).alias("score"))
    return out.select("season", F.coalesce("track", F.lit("all")).alias("track"), F.coalesce("team_id", F.lit("all")).alias("team"), "games", "score")
