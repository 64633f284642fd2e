"""Careers: slices, eligibility, peak ranks, and how far a career's class can be told early."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.functions import scalar, selection, stats
from ladderwork.functions.windows import centred_mean
from ladderwork.operators import curves, dominance
from ladderwork.plans.curves import ASSIGN_SQL, CENTRES, CURVE_SQL, all_curves
from ladderwork.plans.registry import query
from ladderwork.plans.timeline import EVENTS_SQL, events
from ladderwork.sources.warehouse import written

ORDER = ["game_date", "game_id"]
#: Games after which a career is looked at, and shares of it.
CUTOFFS = (60, 100, 150, 200)
LEAST_GAMES = (42, 60, 80, 100, 150, 200, 400)


def placed(log: DataFrame) -> DataFrame:
    """Each event's number in its player's career (from 0) and the career's length."""
    w = Window.partitionBy("player_id")
    return log.withColumn("j", F.row_number().over(w.orderBy(*ORDER)) - 1).withColumn("n", F.count("*").over(w))


@query(f"""
WITH {EVENTS_SQL},
o AS (SELECT player_id, rating_after AS v, row_number() OVER (PARTITION BY player_id ORDER BY game_date, game_id) - 1 AS j, count(*) OVER (PARTITION BY player_id) AS n FROM ev)
SELECT player_id, max(n) AS games, round(avg(v) FILTER (j < greatest(1, n // 5)), 4) AS first_fifth, round(avg(v) FILTER (j >= n // 5 AND j < 4 * n // 5), 4) AS middle, round(avg(v) FILTER (j >= 4 * n // 5), 4) AS last_fifth FROM o GROUP BY player_id
""")
def career_slices(spark, sf):
    j, n, v = F.col("j"), F.col("n"), F.col("rating_after")
    fifth, rest = F.floor(n / 5), F.floor(4 * n / 5)
    mean = lambda inside: F.round(F.avg(F.when(inside, v)), 4)
    return placed(events(spark, sf)).groupBy("player_id").agg(
        F.max("n").alias("games"), mean(j < F.greatest(F.lit(1), fifth)).alias("first_fifth"),
        mean((j >= fifth) & (j < rest)).alias("middle"), mean(j >= rest).alias("last_fifth"),
    )


@query(f"""
WITH {EVENTS_SQL},
m AS (SELECT player_id, count(*) AS games, count(DISTINCT season) AS seasons, min(season) AS first_season, max(season) AS last_season, max(CAST(game_date AS DATE)) AS last_day FROM ev GROUP BY player_id),
a AS (SELECT *, date_diff('day', DATE '1955-01-01' + CAST(player_id % 9000 AS INTEGER), last_day) / 365.2425e0 AS age, 1990 + player_id % 4 AS from_year, 1996 + player_id % 6 AS to_year FROM m),
r AS (SELECT *, last_season <= 2000 AND last_season >= to_year - 1 AS completed, last_season >= 2000 AND age >= 34 AS late_active FROM a)
SELECT player_id, games, seasons, round(age, 4) AS age, completed, late_active, games >= 40 AND seasons >= 3 AND first_season >= from_year - 1 AND (completed OR late_active) AS eligible FROM r
""")
def career_eligibility(spark, sf):
    """Careers seen from their start that have ended, or go on late in life."""
    meta = events(spark, sf).groupBy("player_id").agg(
        F.count("*").alias("games"), F.countDistinct("season").alias("seasons"), F.min("season").alias("first_season"),
        F.max("season").alias("last_season"), F.max(F.to_date("game_date")).alias("last_day"),
    )
    born = F.date_add(F.make_date(F.lit(1955), F.lit(1), F.lit(1)), (F.col("player_id") % 9000).cast("int"))
    meta = meta.withColumn("age", scalar.age_years(F.col("last_day"), born))
    from_year, to_year = 1990 + F.col("player_id") % 4, 1996 + F.col("player_id") % 6
    completed = (F.col("last_season") <= 2000) & (F.col("last_season") >= to_year - 1)
    late = (F.col("last_season") >= 2000) & (F.col("age") >= 34)
    eligible = (F.col("games") >= 40) & (F.col("seasons") >= 3) & (F.col("first_season") >= from_year - 1) & (completed | late)
    return meta.select("player_id", "games", "seasons", F.round("age", 4).alias("age"), completed.alias("completed"), late.alias("late_active"), eligible.alias("eligible"))


_PEAK_RANK = f"""
WITH {EVENTS_SQL},
d AS (SELECT season, player_id, CAST(game_date AS DATE) AS day, arg_max(rating_after, struct_pack(t := game_date, g := game_id)) AS rating FROM ev GROUP BY ALL),
v AS (SELECT *, lead(day) OVER (PARTITION BY season, player_id ORDER BY day) AS until FROM d),
peak AS (SELECT player_id, arg_max(season, struct_pack(r := round(rating, 6), d := -epoch(day))) AS season, arg_max(day, struct_pack(r := round(rating, 6), d := -epoch(day))) AS day, max(round(rating, 6)) AS top FROM d GROUP BY player_id)
SELECT p.player_id, p.season, p.day AS peak_day, count(*) AS active, 1 + count(*) FILTER (round(v.rating, 6) > p.top OR (round(v.rating, 6) = p.top AND v.player_id < p.player_id)) AS place
FROM peak p JOIN v ON v.season = p.season AND v.day <= p.day AND (v.until IS NULL OR v.until > p.day) GROUP BY ALL
"""


@query(_PEAK_RANK)
def peak_rank(spark, sf):
    """Place of each player among those seen in the season, on the day of the player's own peak (as of that day)."""
    out = dominance.places(peak_states(events(spark, sf)))
    return out.select(F.col("who").alias("player_id"), F.col("grp").alias("season"), F.col("t").alias("peak_day"), "active", "place")


def peak_states(log: DataFrame) -> DataFrame:
    """A player's daily states in each season; the one of the player's peak is asked for.

    The peak is the highest rating, the earliest day of it, the latest season
    of that day.
    """
    days = log.groupBy("season", "player_id", F.to_date("game_date").alias("day")).agg(F.round(F.max_by("rating_after", F.struct(*ORDER)), 6).alias("rating"))
    mark = F.struct("rating", (-F.unix_date("day")).alias("day"), "season")
    peak = F.max(mark).over(Window.partitionBy("player_id"))
    until = F.lead("day").over(Window.partitionBy("season", "player_id").orderBy("day"))
    return days.select(F.col("season").alias("grp"), F.col("player_id").alias("who"), "rating", F.col("day").alias("t"), until.alias("until"), (mark == peak).alias("asked"))


_LEVEL = "CASE WHEN peak < 1500 THEN 'below' WHEN peak < 1505 THEN 'low' WHEN peak < 1510 THEN 'middle' ELSE 'high' END"


@query(f"""
WITH r AS ({_PEAK_RANK}), top AS (WITH {EVENTS_SQL} SELECT player_id, round(max(rating_after), 6) AS peak FROM ev GROUP BY player_id)
SELECT {_LEVEL} AS level, count(*) AS players, round(quantile_cont(place, 0.25), 4) AS p25, round(median(place), 4) AS p50, round(quantile_cont(place, 0.75), 4) AS p75, CAST(min(place) AS DOUBLE) AS best, CAST(max(place) AS DOUBLE) AS worst
FROM r JOIN top USING (player_id) GROUP BY 1
""")
def peak_rank_levels(spark, sf):
    """Quartiles of the places at the own peak, by the level of the peak."""
    log = written(events(spark, sf).select("season", "player_id", *ORDER, "rating_after"), "peak-log")
    tops = log.groupBy("player_id").agg(F.round(F.max("rating_after"), 6).alias("peak"))
    level = scalar.cut(F.col("peak"), [-1e9, 1500, 1505, 1510, 1e9], ["below", "low", "middle", "high"])
    rows = dominance.places(peak_states(log)).join(tops.withColumnRenamed("player_id", "who"), "who").select(level.alias("level"), "place")
    out = selection.described(written(rows, "peak-places"), ["level"], "place", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return out.select("level", F.col("n").alias("players"), *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")], F.col("least").alias("best"), F.col("greatest").alias("worst"))


def _variant(source: str, rating: str = "rating_after", key: str = "player_id") -> str:
    """ASSIGN_SQL over other events than `ev`."""
    rows = ASSIGN_SQL.removeprefix(CURVE_SQL)
    curve = CURVE_SQL.removeprefix(EVENTS_SQL).replace("FROM ev ", "FROM other ")
    return f"WITH {EVENTS_SQL}, other AS (SELECT {key} AS player_id, game_date, game_id, {rating} AS rating_after FROM {source}){curve}{rows}"


_CUT = f"(SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_date, game_id) AS j, count(*) OVER (PARTITION BY player_id) AS n FROM ev) o, (SELECT unnest({list(CUTOFFS)}) AS cutoff) c WHERE j <= cutoff AND n >= cutoff"


@query(f"""
WITH guess AS ({_variant(_CUT, key="player_id * 1000 + cutoff")} SELECT player_id // 1000 AS player_id, player_id % 1000 AS cutoff_games, cluster FROM assigned),
truth AS (WITH {ASSIGN_SQL} SELECT player_id, cluster FROM assigned),
per AS (SELECT cutoff_games, t.cluster, count(*) AS n, sum(CASE WHEN g.cluster = t.cluster THEN 1e0 ELSE 0e0 END) AS hits FROM guess g JOIN truth t USING (player_id) GROUP BY ALL)
SELECT CAST(cutoff_games AS BIGINT) AS cutoff_games, CAST(sum(n) AS BIGINT) AS players, round(sum(hits) / sum(n), 6) AS accuracy, round(avg(hits / n), 6) AS balanced_accuracy FROM per GROUP BY cutoff_games
""")
def censoring_by_games(spark, sf):
    """Classes told from a career's first games against those of the whole career; all cutoffs in one pass."""
    log = events(spark, sf)
    cut = placed(log).withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in CUTOFFS]))).where("j < cutoff and n >= cutoff")
    partial = cut.withColumn("player_id", F.col("player_id") * 1000 + F.col("cutoff"))
    guess = curves.assigned(curves.career_curves(partial), CENTRES).select(
        F.floor(F.col("player_id") / 1000).alias("player_id"), (F.col("player_id") % 1000).alias("cutoff_games"), F.col("cluster").alias("guess")
    )
    truth = curves.assigned(curves.career_curves(log), CENTRES).select("player_id", F.col("cluster").alias("truth"))
    out = stats.balanced_accuracy(guess.join(truth, "player_id"), ["cutoff_games"], "truth", "guess")
    return out.select("cutoff_games", F.col("n").alias("players"), *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy")])


@query(f"""
WITH {ASSIGN_SQL}, g AS (SELECT player_id, count(*) AS games FROM ev GROUP BY 1), t AS (SELECT unnest({list(LEAST_GAMES)}) AS least),
c AS (SELECT CAST(least AS BIGINT) AS least_games, CAST(cluster AS BIGINT) AS cluster, count(*) AS players FROM assigned JOIN g USING (player_id), t WHERE games >= least GROUP BY ALL)
SELECT least_games, cluster, players, round(players / sum(players) OVER (PARTITION BY least_games), 6) AS share FROM c
""")
def sample_thresholds(spark, sf):
    """Shares of the classes as more games are asked for."""
    log = events(spark, sf)
    games = log.groupBy("player_id").agg(F.count("*").alias("games"))
    rows = curves.assigned(curves.career_curves(log), CENTRES).select("player_id", F.col("cluster").cast("long").alias("cluster")).join(games, "player_id")
    rows = rows.withColumn("least_games", F.explode(F.array(*[F.lit(c).cast("long") for c in LEAST_GAMES]))).where("games >= least_games")
    counts = rows.groupBy("least_games", "cluster").agg(F.count("*").alias("players"))
    return counts.withColumn("share", F.round(F.col("players") / F.sum("players").over(Window.partitionBy("least_games")), 6))


_RELATIVE = _variant("ev", "rating_after - avg(rating_after) OVER (PARTITION BY season)")


@query(f"""
SELECT CAST(r.cluster AS BIGINT) AS raw_cluster, CAST(l.cluster AS BIGINT) AS relative_cluster, count(*) AS players FROM (WITH {ASSIGN_SQL} SELECT * FROM assigned) r JOIN ({_RELATIVE} SELECT * FROM assigned) l USING (player_id) GROUP BY ALL
""")
def cluster_agreement(spark, sf):
    """Classes by raw ratings against those by ratings above the season's mean."""
    log = events(spark, sf)
    relative = log.withColumn("rating_after", F.col("rating_after") - F.avg("rating_after").over(Window.partitionBy("season")))
    raw, other = (curves.assigned(curves.career_curves(x), CENTRES).select("player_id", F.col("cluster").cast("long").alias(c)) for x, c in ((log, "raw_cluster"), (relative, "relative_cluster")))
    return raw.join(other, "player_id").groupBy("raw_cluster", "relative_cluster").agg(F.count("*").alias("players"))


_TRAITS = ("first_21", "last_21", "peak_21", "raw_peak", "gain", "decline")
_QUARTILES = ", ".join(f"round(quantile_cont({c}, {q}), 4) + 0e0 AS {c}_{n}" for c in _TRAITS for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75")))


@query(f"""
WITH {ASSIGN_SQL},
s AS (SELECT player_id, rating_after AS v, avg(rating_after) OVER (PARTITION BY player_id ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS smooth,
  row_number() OVER (PARTITION BY player_id ORDER BY game_date, game_id) AS j, count(*) OVER (PARTITION BY player_id) AS n FROM ev),
x AS (SELECT player_id, avg(v) FILTER (j <= 21) AS first_21, avg(v) FILTER (j > n - 21) AS last_21, max(smooth) AS peak_21, max(v) AS raw_peak FROM s GROUP BY player_id),
y AS (SELECT *, peak_21 - first_21 AS gain, peak_21 - last_21 AS decline FROM x)
SELECT CAST(cluster AS BIGINT) AS cluster, count(*) AS players, {_QUARTILES} FROM assigned JOIN y USING (player_id) GROUP BY cluster
""")
def cluster_characteristics(spark, sf):
    """Quartiles of start, end, peak, gain and decline in each class."""
    log = placed(events(spark, sf)).withColumn("smooth", centred_mean(F.col("rating_after"), ["player_id"], ORDER, 10))
    v, j, n = F.col("rating_after"), F.col("j"), F.col("n")
    traits = log.groupBy("player_id").agg(
        F.avg(F.when(j < 21, v)).alias("first_21"), F.avg(F.when(j >= n - 21, v)).alias("last_21"), F.max("smooth").alias("peak_21"), F.max(v).alias("raw_peak")
    )
    traits = traits.withColumn("gain", F.col("peak_21") - F.col("first_21")).withColumn("decline", F.col("peak_21") - F.col("last_21"))
    rows = curves.assigned(all_curves(spark, sf), CENTRES).select("player_id", F.col("cluster").cast("long").alias("cluster")).join(traits, "player_id")
    points = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    long = rows.select("cluster", F.explode(F.array(*[F.struct(F.lit(c).alias("trait"), F.col(c).alias("v")) for c in _TRAITS])).alias("x")).select("cluster", "x.*")
    found = selection.quantiles(long, ["cluster", "trait"], "v", points)
    wide = [(F.round(F.max(F.when(F.col("trait") == c, F.col(m))), 4) + F.lit(0.0)).alias(f"{c}_{m}") for c in _TRAITS for m in points]
    return rows.groupBy("cluster").agg(F.count("*").alias("players")).join(found.groupBy("cluster").agg(*wide), "cluster")
