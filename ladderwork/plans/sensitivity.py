"""Grids of thresholds, truncated careers and rankings, careers side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.functions import ranks, scalar, selection, stats
from ladderwork.functions.windows import centred_mean
from ladderwork.operators import curves, grids, paths
from ladderwork.plans.careers import CUTOFFS, LEAST_GAMES, ORDER, _variant, placed
from ladderwork.plans.curves import ASSIGN_SQL, CENTRES
from ladderwork.plans.performance import PERF_SQL, performed
from ladderwork.plans.registry import query
from ladderwork.plans.timeline import EVENTS_SQL, events
from ladderwork.sources.warehouse import written

LEAST_SEASONS = tuple(range(1, 9))
SEASON_GAMES = (10, 20, 40, 60, 80, 100)
AGES = (20, 25, 30, 35, 40)
_BORN = "DATE '1955-01-01' + CAST(player_id % 9000 AS INTEGER)"


def born():
    return F.date_add(F.make_date(F.lit(1955), F.lit(1), F.lit(1)), (F.col("player_id") % 9000).cast("int"))


def clusters(log: DataFrame, name: str = "cluster") -> DataFrame:
    return curves.assigned(curves.career_curves(log), CENTRES).select("player_id", F.col("cluster").cast("long").alias(name))


@query(f"""
WITH {ASSIGN_SQL},
m AS (SELECT player_id, count(*) AS games, count(DISTINCT season) AS seasons FROM ev GROUP BY 1),
r AS (SELECT cluster, games, seasons FROM assigned JOIN m USING (player_id) WHERE games >= {min(LEAST_GAMES)}),
t AS (SELECT * FROM (SELECT DISTINCT cluster FROM r), (SELECT unnest({list(LEAST_GAMES)}) AS g), (SELECT unnest({list(LEAST_SEASONS)}) AS s)),
c AS (SELECT t.cluster, g, s, count(r.games) AS players FROM t LEFT JOIN r ON r.cluster = t.cluster AND r.games >= g AND r.seasons >= s GROUP BY ALL)
SELECT CAST(g AS BIGINT) AS least_games, CAST(s AS BIGINT) AS least_seasons, CAST(cluster AS BIGINT) AS cluster, players, round(players / nullif(sum(players) OVER (PARTITION BY g, s), 0), 6) AS share FROM c
""")
def career_grid(spark, sf):
    """Sizes and shares of the classes as more games and more seasons are asked for, both at once."""
    log = events(spark, sf)
    careers = log.groupBy("player_id").agg(F.count("*").alias("least_games"), F.countDistinct("season").alias("least_seasons"))
    rows = clusters(log).join(careers, "player_id")
    out = grids.corners(rows, ["cluster"], {"least_games": LEAST_GAMES, "least_seasons": LEAST_SEASONS}, {"players": F.lit(1).cast("long")})
    total = F.nullif(F.sum("players").over(Window.partitionBy("least_games", "least_seasons")), F.lit(0))
    return out.select(F.col("least_games").cast("long").alias("least_games"), F.col("least_seasons").cast("long").alias("least_seasons"), "cluster", "players", F.round(F.col("players") / total, 6).alias("share"))


@query(f"""
WITH {EVENTS_SQL},
g AS (SELECT player_id, season, count(*) AS games FROM ev GROUP BY ALL),
q AS (SELECT player_id, least, count(*) FILTER (games >= least) AS seasons FROM g, (SELECT unnest({list(SEASON_GAMES)}) AS least) GROUP BY ALL)
SELECT CAST(least AS BIGINT) AS season_games, CAST(s AS BIGINT) AS seasons, count(*) FILTER (q.seasons >= s) AS players FROM q, (SELECT unnest({list(LEAST_SEASONS)}) AS s) GROUP BY ALL
""")
def qualifying_grid(spark, sf):
    """Players with at least so many seasons of at least so many games: a staircase a player, one aggregation."""
    per = events(spark, sf).groupBy("player_id", "season").agg(F.count("*").alias("games"))
    stairs = per.groupBy("player_id").agg(*[F.count_if(F.col("games") >= g).alias(f"q{g}") for g in SEASON_GAMES])
    cells = [(g, s) for g in SEASON_GAMES for s in LEAST_SEASONS]
    whole = stairs.agg(*[F.count_if(F.col(f"q{g}") >= s).alias(f"n_{g}_{s}") for g, s in cells])
    rows = F.explode(F.array(*[F.struct(F.lit(g).cast("long").alias("season_games"), F.lit(s).cast("long").alias("seasons"), F.col(f"n_{g}_{s}").alias("players")) for g, s in cells]))
    return whole.select(rows.alias("r")).select("r.*")


#: The two rules: so many seasons of so many games, or so many seasons of any.
RULE_SEASONS, RULE_GAMES, ANY_SEASONS = 5, 60, 7


@query(f"""
WITH {ASSIGN_SQL},
g AS (SELECT player_id, season, count(*) AS games FROM ev GROUP BY ALL),
m AS (SELECT player_id, count(*) AS seasons, count(*) FILTER (games >= {RULE_GAMES}) AS full_seasons, min(season) AS first_season FROM g GROUP BY 1),
r AS (SELECT 'full_seasons' AS rule, * FROM m WHERE full_seasons >= {RULE_SEASONS} UNION ALL SELECT 'full_or_many' AS rule, * FROM m WHERE full_seasons >= {RULE_SEASONS} OR seasons >= {ANY_SEASONS})
SELECT rule, first_season, CAST(cluster AS BIGINT) AS cluster, count(*) AS players, round(count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY rule, first_season), 6) AS share FROM r JOIN assigned USING (player_id) GROUP BY rule, first_season, cluster
""")
def rule_comparison(spark, sf):
    """Classes by first season under two rules of what a career is; both from one row a career."""
    log = events(spark, sf)
    per = log.groupBy("player_id", "season").agg(F.count("*").alias("games"))
    careers = per.groupBy("player_id").agg(F.count("*").alias("seasons"), F.count_if(F.col("games") >= RULE_GAMES).alias("full"), F.min("season").alias("first_season"))
    full = F.col("full") >= RULE_SEASONS
    rules = F.array_compact(F.array(F.when(full, "full_seasons"), F.when(full | (F.col("seasons") >= ANY_SEASONS), "full_or_many")))
    rows = careers.withColumn("rule", F.explode(rules)).join(clusters(log), "player_id").groupBy("rule", "first_season", "cluster").agg(F.count("*").alias("players"))
    return rows.withColumn("share", F.round(F.col("players") * 1.0 / F.sum("players").over(Window.partitionBy("rule", "first_season")), 6))


_CUT = f"(SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_date, game_id) AS j, count(*) OVER (PARTITION BY player_id) AS n FROM ev) o, (SELECT unnest({list(CUTOFFS)}) AS cutoff) c WHERE j <= cutoff AND n >= cutoff"


@query(f"""
WITH guess AS ({_variant(_CUT, key="player_id * 1000 + cutoff")} SELECT player_id // 1000 AS player_id, player_id % 1000 AS games, cluster FROM assigned),
truth AS (WITH {ASSIGN_SQL} SELECT player_id, cluster FROM assigned),
days AS (WITH {EVENTS_SQL} SELECT player_id, CAST(game_date AS DATE) AS day, row_number() OVER (PARTITION BY player_id ORDER BY game_date, game_id) AS games FROM ev),
r AS (SELECT t.cluster AS truth, g.games, date_diff('day', {_BORN}, day) / 365.2425e0 AS age, CASE WHEN g.cluster = t.cluster THEN 1 ELSE 0 END AS hit FROM guess g JOIN truth t USING (player_id) JOIN days d USING (player_id, games)),
per AS (SELECT a AS least_age, n AS least_games, truth, count(*) AS n_rows, sum(hit) AS hits FROM r, (SELECT unnest({list(AGES)}) AS a), (SELECT unnest({list(CUTOFFS)}) AS n) WHERE age >= a AND games >= n GROUP BY ALL)
SELECT CAST(least_age AS BIGINT) AS least_age, CAST(least_games AS BIGINT) AS least_games, CAST(sum(n_rows) AS BIGINT) AS careers, round(sum(hits) / sum(n_rows), 6) AS accuracy, round(avg(hits / n_rows), 6) AS balanced_accuracy FROM per GROUP BY ALL
""")
def censoring_by_age_games(spark, sf):
    """How well a class is told from a cut career, by age at the cut and games seen, both at least."""
    log = placed(events(spark, sf))
    cut = log.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in CUTOFFS]))).where("j < cutoff and n >= cutoff")
    partial = cut.withColumn("player_id", F.col("player_id") * 1000 + F.col("cutoff"))
    guess = clusters(partial, "guess").select(F.floor(F.col("player_id") / 1000).alias("player_id"), (F.col("player_id") % 1000).cast("int").alias("least_games"), "guess")
    days = log.where((F.col("j") + 1).isin(*CUTOFFS)).select("player_id", (F.col("j") + 1).alias("least_games"), scalar.age_years(F.to_date("game_date"), born()).alias("least_age"))
    rows = guess.join(days, ["player_id", "least_games"]).join(clusters(events(spark, sf), "truth"), "player_id")
    sums = {"n_rows": F.lit(1).cast("long"), "hits": (F.col("guess") == F.col("truth")).cast("long")}
    out = grids.corners(rows, ["truth"], {"least_age": AGES, "least_games": CUTOFFS}, sums).where("n_rows > 0")
    return out.groupBy(F.col("least_age").cast("long").alias("least_age"), F.col("least_games").cast("long").alias("least_games")).agg(
        F.sum("n_rows").alias("careers"), F.round(F.sum("hits") / F.sum("n_rows"), 6).alias("accuracy"), F.round(F.avg(F.col("hits") / F.col("n_rows")), 6).alias("balanced_accuracy")
    )


#: Parts of a career that are seen, in percent.
SHARES = (25, 50, 75, 90)
_SEEN = f"(SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_date, game_id) AS j, count(*) OVER (PARTITION BY player_id) AS n FROM ev) o, (SELECT unnest({list(SHARES)}) AS part) c WHERE j * 100 <= n * part"


@query(f"""
WITH guess AS ({_variant(_SEEN, key="player_id * 1000 + part")} SELECT player_id // 1000 AS player_id, player_id % 1000 AS part, cluster FROM assigned),
truth AS (WITH {ASSIGN_SQL} SELECT player_id, cluster FROM assigned),
per AS (SELECT part, t.cluster, count(*) AS n, sum(CASE WHEN g.cluster = t.cluster THEN 1e0 ELSE 0e0 END) AS hits FROM guess g JOIN truth t USING (player_id) GROUP BY ALL)
SELECT CAST(part AS BIGINT) AS seen_percent, CAST(sum(n) AS BIGINT) AS players, round(sum(hits) / sum(n), 6) AS accuracy, round(avg(hits / n), 6) AS balanced_accuracy FROM per GROUP BY part
""")
def censoring_by_share(spark, sf):
    """How well a class is told from the first part of a career."""
    log = events(spark, sf)
    seen = placed(log).withColumn("part", F.explode(F.array(*[F.lit(c) for c in SHARES]))).where("(j + 1) * 100 <= n * part")
    guess = clusters(seen.withColumn("player_id", F.col("player_id") * 1000 + F.col("part")), "guess")
    guess = guess.select(F.floor(F.col("player_id") / 1000).alias("player_id"), (F.col("player_id") % 1000).alias("seen_percent"), "guess")
    out = stats.balanced_accuracy(guess.join(clusters(log, "truth"), "player_id"), ["seen_percent"], "truth", "guess")
    return out.select("seen_percent", F.col("n").alias("players"), *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy")])


#: Seasons dropped from the start of a career.
DROPS = (0, 1, 2, 3, 4)
_DROPPED = f"(SELECT *, season - min(season) OVER (PARTITION BY player_id) AS nth FROM ev) o, (SELECT unnest({list(DROPS)}) AS lost) d WHERE nth >= lost"


@query(f"""
{_variant(_DROPPED, key="player_id * 10 + lost")},
used AS (SELECT player_id, count(*) AS games FROM other GROUP BY 1),
wide AS (SELECT player_id, {", ".join(f"round(sqrt(max(d) FILTER (k = {k})), 5) AS distance_{k}" for k in range(3))} FROM dist GROUP BY 1)
SELECT player_id // 10 AS player_id, player_id % 10 AS seasons_dropped, games, CAST(cluster AS BIGINT) AS cluster, distance_0, distance_1, distance_2 FROM assigned JOIN used USING (player_id) JOIN wide USING (player_id)
""")
def career_truncation(spark, sf):
    """The class of each career without its first seasons, with the distances to all centres."""
    log = events(spark, sf)
    nth = F.col("season") - F.min("season").over(Window.partitionBy("player_id"))
    cut = log.withColumn("nth", nth).withColumn("lost", F.explode(F.array(*map(F.lit, DROPS)))).where("nth >= lost").withColumn("player_id", F.col("player_id") * 10 + F.col("lost"))
    used = cut.groupBy("player_id").agg(F.count("*").alias("games"))
    rows = curves.assigned(curves.career_curves(cut), CENTRES).join(used, "player_id")
    far = [F.round(F.sqrt(curves.squared_distance(F.col("curve"), F.array(*[F.lit(float(v)) for v in c]))), 5).alias(f"distance_{k}") for k, c in enumerate(CENTRES)]
    return rows.select(F.floor(F.col("player_id") / 10).alias("player_id"), (F.col("player_id") % 10).alias("seasons_dropped"), "games", F.col("cluster").cast("long").alias("cluster"), *far)


CUTS = (1, 3, 5, 10)


@query(f"""
WITH {EVENTS_SQL},
r AS (SELECT season, rating_after AS v, row_number() OVER (PARTITION BY season ORDER BY round(rating_after, 6) DESC, player_id) AS k FROM ending),
c AS (SELECT season, cut, count(*) AS players, max(v) AS top, avg(v) FILTER (k <= cut) AS top_mean, stddev_pop(v) FILTER (k <= cut) AS top_sd, avg(v) FILTER (k > cut) AS rest_mean, stddev_pop(v) FILTER (k > cut) AS rest_sd FROM r, (SELECT unnest({list(CUTS)}) AS cut) GROUP BY ALL)
SELECT season, CAST(cut AS BIGINT) AS cut, players, round(top_mean, 4) AS top_mean, round(top_sd, 3) AS top_sd, round(rest_mean, 4) AS rest_mean, round(rest_sd, 3) AS rest_sd, round((top - rest_mean) / rest_sd, 3) AS top_z FROM c WHERE players >= cut + 3
""")
def truncated_moments(spark, sf):
    """Mean and spread of the best and of the rest, and the first's distance in the rest's spreads, after any cut: prefix sums over ranked values."""
    last = events(spark, sf).groupBy("season", "player_id").agg(F.max_by("rating_after", F.struct("game_date", "game_id")).alias("v"))
    # distances from 1500 keep the squares small
    rows = last.withColumn("d", F.col("v") - 1500.0).withColumn("shown", F.round("v", 6))
    sums = ranks.running_sums(rows, ["season"], [F.desc("shown"), F.asc("player_id")], {"k": F.lit(1).cast("long"), "s": "d", "s2": F.col("d") * F.col("d")})
    whole = rows.groupBy("season").agg(F.count("*").alias("n"), F.sum("d").alias("t"), F.sum(F.col("d") * F.col("d")).alias("t2"), F.max("d").alias("top"))
    at = sums.where(F.col("k").isin(*CUTS)).select("season", "k", "s", "s2").join(whole, "season").where("n >= k + 3")

    def moments(n, s, s2):
        return s / n, F.sqrt(F.greatest(s2 / n - (s / n) * (s / n), F.lit(0.0)))

    top_mean, top_sd = moments(F.col("k"), F.col("s"), F.col("s2"))
    rest_mean, rest_sd = moments(F.col("n") - F.col("k"), F.col("t") - F.col("s"), F.col("t2") - F.col("s2"))
    return at.select(
        "season", F.col("k").alias("cut"), F.col("n").alias("players"), F.round(top_mean + 1500.0, 4).alias("top_mean"), F.round(top_sd, 3).alias("top_sd"),
        F.round(rest_mean + 1500.0, 4).alias("rest_mean"), F.round(rest_sd, 3).alias("rest_sd"), F.round((F.col("top") - rest_mean) / rest_sd, 3).alias("top_z"),
    )


_ERA = "CASE WHEN season < 1994 THEN '1991-93' WHEN season < 1997 THEN '1994-96' ELSE '1997-' END"


def era():
    return scalar.cut(F.col("season"), [0, 1994, 1997, 9999], ["1991-93", "1994-96", "1997-"])


TOPS = (5, 10, 20, 50)


@query(f"""
WITH {EVENTS_SQL},
p AS (SELECT player_id, season, rating_after AS peak, row_number() OVER (PARTITION BY player_id ORDER BY round(rating_after, 6) DESC, game_date, game_id) AS j FROM ev),
k AS (SELECT {_ERA} AS period, row_number() OVER (ORDER BY round(peak, 6) DESC, player_id) AS k FROM p WHERE j = 1)
SELECT period, CAST(top AS BIGINT) AS top_n, count(*) FILTER (k <= top) AS players FROM k, (SELECT unnest({list(TOPS)}) AS top) GROUP BY ALL
""")
def peak_era_counts(spark, sf):
    """How many of the highest peaks fall into each period."""
    best = F.min_by(F.struct("season", F.round("rating_after", 6).alias("peak")), F.struct(-F.round("rating_after", 6), "game_date", "game_id")).alias("p")
    peaks = events(spark, sf).groupBy("player_id").agg(best).select("player_id", "p.*")
    rows = ranks.numbered(peaks, [], [F.desc("peak"), F.asc("player_id")], "k").groupBy(era().alias("period")).agg(*[F.count_if(F.col("k") <= n).alias(f"n{n}") for n in TOPS])
    each = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("top_n"), F.col(f"n{n}").alias("players")) for n in TOPS]))
    return rows.select("period", each.alias("x")).select("period", "x.*")


_POINTS = {"p01": 0.01, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
_WEIGHTED = {"w10": 0.1, "w50": 0.5, "w90": 0.9, "w99": 0.99}


@query(f"""
WITH {PERF_SQL},
z AS (SELECT {_ERA} AS period, round(z_score, 6) AS z, minutes AS w FROM zed WHERE track = 'regular'),
r AS (SELECT *, sum(w) OVER (PARTITION BY period ORDER BY z RANGE UNBOUNDED PRECEDING) AS running, sum(w) OVER (PARTITION BY period) AS total FROM z WHERE w > 0),
q AS (SELECT period, {", ".join(f"min(z) FILTER (running >= {v}e0 * total) + 0e0 AS {n}" for n, v in _WEIGHTED.items())} FROM r GROUP BY period),
s AS (SELECT period, count(*) AS n, avg(z) AS mean, stddev_pop(z) AS sd, {", ".join(f"quantile_cont(z, {v}) AS {n}" for n, v in _POINTS.items())} FROM z GROUP BY period),
k AS (SELECT period, avg(power((z - mean) / sd, 3)) AS skew FROM z JOIN s USING (period) GROUP BY period)
SELECT period, n, round(mean, 5) + 0e0 AS mean, round(sd, 5) AS sd, round(skew, 4) + 0e0 AS skew, {", ".join(f"round({c}, 5) + 0e0 AS {c}" for c in _POINTS)}, {", ".join(_WEIGHTED)} FROM s JOIN k USING (period) JOIN q USING (period)
""")
def era_score_distribution(spark, sf):
    """The distribution of performance by period over all rows, by heads and by minutes: few groups of any size."""
    rows = performed(spark, sf).where("track = 'regular'").select(era().alias("period"), F.round("z_score", 6).alias("z"), F.col("minutes").alias("w"))
    rows = written(rows, "era-scores")
    whole = rows.groupBy("period").agg(F.count("*").alias("n"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("sd"), F.skewness("z").alias("skew"))
    out = whole.join(selection.quantiles(rows, ["period"], "z", _POINTS), "period").join(stats.weighted_quantiles(rows, ["period"], "z", "w", _WEIGHTED), "period")
    signed = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    return out.select("period", "n", signed("mean", 5), F.round("sd", 5).alias("sd"), signed("skew", 4), *[signed(c, 5) for c in _POINTS], *[(F.col(c) + F.lit(0.0)).alias(c) for c in _WEIGHTED])


_MEANS = "m AS (SELECT season, sum(rating_after * minutes) / sum(minutes) AS mean FROM (SELECT e.season, e.player_id, any_value(e.rating_after) AS rating_after, sum(c.minutes) AS minutes FROM ending e JOIN clean c USING (season, player_id) GROUP BY ALL) GROUP BY season)"


def relative(log: DataFrame) -> DataFrame:
    """The log with above: rating less the season's mean of last ratings by minutes.  log has minutes."""
    last = log.groupBy("season", "player_id").agg(F.max_by("rating_after", F.struct("game_date", "game_id")).alias("v"), F.sum("minutes").alias("w"))
    means = last.groupBy("season").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("season_mean"))
    return log.join(F.broadcast(means), "season").withColumn("above", F.col("rating_after") - F.col("season_mean"))  # a row a season


@query(f"""
WITH {EVENTS_SQL},{_MEANS},
r AS (SELECT e.*, c.minutes, c.share, e.rating_after - m.mean AS above FROM ev e JOIN clean c USING (game_id, player_id) JOIN m ON m.season = e.season),
a AS (SELECT player_id, count(*) AS games, avg(rating_after) AS mean, sum(rating_after * share) / sum(share) AS weighted_mean, avg(above) AS mean_above, sum(above * share) / sum(share) AS weighted_above, max(rating_after) AS peak, avg(perf) AS perf, min(season) AS first_season, max(season) AS last_season FROM r GROUP BY player_id)
SELECT player_id, games, round(mean, 4) AS mean, round(weighted_mean, 4) AS weighted_mean, round(mean_above, 4) + 0e0 AS mean_above, round(weighted_above, 4) + 0e0 AS weighted_above, round(peak, 4) AS peak, round(perf, 5) + 0e0 AS mean_perf, first_season, last_season,
  row_number() OVER (ORDER BY round(mean, 6) DESC, player_id) AS place FROM a
""")
def career_mean_ranking(spark, sf):
    """All careers by their mean rating, with means by minutes and above the seasons' means."""
    rows = relative(events(spark, sf, "minutes", "share"))
    w = lambda c: stats.weighted_mean(F.col(c), F.col("share"))
    out = rows.groupBy("player_id").agg(
        F.count("*").alias("games"), F.avg("rating_after").alias("mean"), w("rating_after").alias("weighted_mean"), F.avg("above").alias("mean_above"), w("above").alias("weighted_above"),
        F.max("rating_after").alias("peak"), F.avg("perf").alias("mean_perf"), F.min("season").alias("first_season"), F.max("season").alias("last_season"),
    )
    out = ranks.numbered(out.withColumn("shown", F.round("mean", 6)), [], [F.desc("shown"), F.asc("player_id")], "place")
    signed = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    return out.select("player_id", "games", *[signed(c, 4) for c in ("mean", "weighted_mean", "mean_above", "weighted_above", "peak")], signed("mean_perf", 5), "first_season", "last_season", "place")


_TAILS = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query(f"""
WITH {EVENTS_SQL},
g AS (SELECT e.season, e.player_id, arg_max(rating_after, struct_pack(d := e.game_date, g := e.game_id)) AS v, sum(c.minutes) AS w FROM ev e JOIN clean c USING (game_id, player_id) WHERE e.track = 'regular' GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY season ORDER BY v RANGE UNBOUNDED PRECEDING) AS running, sum(w) OVER (PARTITION BY season) AS total FROM g),
q AS (SELECT season, count(*) AS players, {", ".join(f"min(v) FILTER (running >= {x}e0 * total) AS {n}" for n, x in _TAILS.items())}, max(v) AS top FROM r GROUP BY season)
SELECT season, players, {", ".join(f"round({n}, 4) AS {n}" for n in _TAILS)}, round(top, 4) AS top, round(p50 - p10, 4) AS lower_width, round(p90 - p50, 4) AS upper_90, round(p95 - p50, 4) AS upper_95, round(p99 - p50, 4) AS upper_99 FROM q
""")
def season_tails(spark, sf):
    """Quantiles by minutes of the ratings after the regular season, and how wide the tails are."""
    log = events(spark, sf, "minutes").where("track = 'regular'")
    last = log.groupBy("season", "player_id").agg(F.max_by("rating_after", F.struct("game_date", "game_id")).alias("v"), F.sum("minutes").alias("w"))
    last = written(last, "season-last")
    out = last.groupBy("season").agg(F.count("*").alias("players"), F.max("v").alias("top")).join(stats.weighted_quantiles(last, ["season"], "v", "w", _TAILS), "season")
    wide = [("lower_width", "p50", "p10"), ("upper_90", "p90", "p50"), ("upper_95", "p95", "p50"), ("upper_99", "p99", "p50")]
    return out.select("season", "players", *[F.round(c, 4).alias(c) for c in (*_TAILS, "top")], *[F.round(F.col(a) - F.col(b), 4).alias(n) for n, a, b in wide])


LEVELS = (1505, 1510)


@query(f"""
WITH {EVENTS_SQL},
s AS (SELECT player_id, CAST(game_date AS DATE) AS day, game_id, rating_after AS v, date_diff('day', {_BORN}, CAST(game_date AS DATE)) / 365.2425e0 AS age, avg(rating_after) OVER (PARTITION BY player_id ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS smooth,
  row_number() OVER (PARTITION BY player_id ORDER BY game_date, game_id) - 1 AS j, count(*) OVER (PARTITION BY player_id) AS n FROM ev),
k AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY round(v, 6) DESC, day, game_id) AS kv, row_number() OVER (PARTITION BY player_id ORDER BY round(smooth, 6) DESC, day, game_id) AS ks FROM s)
SELECT player_id, count(*) AS games, round(min(age), 4) AS first_age, round(max(age), 4) AS last_age, round(avg(v), 4) AS mean, round(max(v), 4) AS peak, max(day) FILTER (kv = 1) AS peak_day, round(max(age) FILTER (kv = 1), 4) AS peak_age,
  round(max(smooth), 4) AS smooth_peak, max(day) FILTER (ks = 1) AS smooth_peak_day, round(max(age) FILTER (ks = 1), 4) AS smooth_peak_age, {", ".join(f"round(avg(CASE WHEN v >= {x} THEN 1e0 ELSE 0e0 END), 6) AS share_{x}" for x in LEVELS)},
  round(avg(v) FILTER (j < greatest(1, n // 5)), 4) AS first_fifth, round(avg(v) FILTER (j >= n // 5 AND j < 4 * n // 5), 4) AS middle, round(avg(v) FILTER (j >= 4 * n // 5), 4) AS last_fifth FROM k GROUP BY player_id
""")
def career_summary(spark, sf):
    """A career in one row: ages, mean, peaks raw and smoothed with day and age, time at levels, slices."""
    rows = placed(events(spark, sf)).withColumn("smooth", centred_mean(F.col("rating_after"), ["player_id"], ORDER, 10)).withColumn("day", F.to_date("game_date"))
    rows = rows.withColumn("age", scalar.age_years(F.col("day"), born()))
    v, j, n = F.col("rating_after"), F.col("j"), F.col("n")
    fifth, rest = F.floor(n / 5), F.floor(4 * n / 5)
    best = lambda c: F.min_by(F.struct("day", "age"), F.struct(-F.round(c, 6), "day", "game_id"))
    at = lambda c: F.round(c, 4)
    mean = lambda inside: at(F.avg(F.when(inside, v)))
    out = rows.groupBy("player_id").agg(
        F.count("*").alias("games"), at(F.min("age")).alias("first_age"), at(F.max("age")).alias("last_age"), at(F.avg(v)).alias("mean"), at(F.max(v)).alias("peak"), best("rating_after").alias("raw"),
        at(F.max("smooth")).alias("smooth_peak"), best("smooth").alias("soft"), *[F.round(F.avg(F.when(v >= x, 1.0).otherwise(0.0)), 6).alias(f"share_{x}") for x in LEVELS],
        mean(j < F.greatest(F.lit(1), fifth)).alias("first_fifth"), mean((j >= fifth) & (j < rest)).alias("middle"), mean(j >= rest).alias("last_fifth"),
    )
    out = out.withColumn("peak_day", F.col("raw.day")).withColumn("peak_age", at("raw.age")).withColumn("smooth_peak_day", F.col("soft.day")).withColumn("smooth_peak_age", at("soft.age"))
    return out.drop("raw", "soft")


#: Players compared (those with the highest peaks) and the step of the age axis in years.
CHOSEN, STEP = 6, 0.25

_PATHS_SQL = f"""{EVENTS_SQL},
chosen AS (SELECT player_id FROM ev GROUP BY 1 ORDER BY round(max(rating_after), 6) DESC, player_id LIMIT {CHOSEN}),
pts AS (SELECT player_id, date_diff('day', {_BORN}, CAST(game_date AS DATE)) / 365.2425e0 AS x, arg_max(smooth, struct_pack(d := game_date, g := game_id)) AS v
  FROM (SELECT *, avg(rating_after) OVER (PARTITION BY player_id ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS smooth FROM ev WHERE player_id IN (SELECT player_id FROM chosen)) GROUP BY ALL),
seg AS (SELECT *, lead(x) OVER w AS x2, lead(v) OVER w AS v2 FROM pts WINDOW w AS (PARTITION BY player_id ORDER BY x)),
slots AS (SELECT *, unnest(range(ceil(x / {STEP})::BIGINT, CASE WHEN x2 IS NULL THEN floor(x / {STEP})::BIGINT + 1 ELSE ceil(x2 / {STEP})::BIGINT END)) AS slot FROM seg),
path AS (SELECT player_id, slot, CASE WHEN x2 IS NULL THEN v ELSE v + (v2 - v) * ((slot * {STEP} - x) / (x2 - x)) END AS value FROM slots)"""


def chosen_paths(log: DataFrame) -> DataFrame:
    """Smoothed paths by age of the players with the highest peaks."""
    best = log.groupBy("player_id").agg(F.round(F.max("rating_after"), 6).alias("peak")).orderBy(F.desc("peak"), "player_id").limit(CHOSEN)
    rows = log.join(F.broadcast(best.select("player_id")), "player_id")
    smooth = centred_mean(F.col("rating_after"), ["player_id"], ORDER, 10)
    age = scalar.age_years(F.to_date("game_date"), born())
    return paths.resampled(rows.select("player_id", age.alias("x"), smooth.alias("value"), F.struct(*ORDER).alias("at")), STEP)


@query(f"WITH {_PATHS_SQL} SELECT player_id, slot * {STEP} AS age, round(value, 4) AS rating FROM path")
def paths_by_age(spark, sf):
    return chosen_paths(events(spark, sf)).select("player_id", (F.col("slot") * STEP).alias("age"), F.round("value", 4).alias("rating"))


@query(f"""
WITH {_PATHS_SQL},
g AS (SELECT x.player_id AS a, y.player_id AS b, slot, x.value - y.value AS gap FROM path x JOIN path y USING (slot) WHERE x.player_id < y.player_id),
t AS (SELECT *, coalesce(lag(sign(gap)) OVER (PARTITION BY a, b ORDER BY slot) <> sign(gap), false) AS turn FROM g)
SELECT a, b, count(*) AS slots, round(avg(gap), 4) + 0e0 AS mean_gap, round(avg(CASE WHEN gap > 0 THEN 1e0 ELSE 0e0 END), 6) AS share_ahead, arg_max(slot, struct_pack(g := abs(gap), s := -slot)) * {STEP} AS widest_age, round(max(abs(gap)), 4) AS widest, count(*) FILTER (turn) AS turns FROM t GROUP BY a, b
""")
def paths_compared(spark, sf):
    """Every two of the chosen careers side by side on one age axis."""
    out = paths.compared(chosen_paths(events(spark, sf)))
    return out.select("a", "b", "slots", (F.round("mean_gap", 4) + F.lit(0.0)).alias("mean_gap"), F.round("share_ahead", 6).alias("share_ahead"), (F.col("widest_slot") * STEP).alias("widest_age"), F.round("widest", 4).alias("widest"), "turns")
