"""Out-of-sample evaluation: targets, pairs, metrics, tests, resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ladderwork.functions import ranks, scalar, selection, stats
from ladderwork.functions.windows import first_n, latest
from ladderwork.plans.performance import PERF_SQL, performed
from ladderwork.plans.registry import query
from ladderwork.plans.timeline import EVENTS_SQL, events, season_ratings
from ladderwork.sources.arena import read
from ladderwork.sources.warehouse import maybe_broadcast, written

WINDOW, LEAST = 10, 5

TARGET_SQL = f"""{EVENTS_SQL},
nth AS (SELECT *, row_number() OVER (PARTITION BY season, player_id ORDER BY game_date, game_id) AS j FROM ev),
target AS (SELECT season, player_id, avg(perf) AS target, count(*) AS games FROM nth WHERE j <= {WINDOW} GROUP BY ALL HAVING count(*) >= {LEAST}),
pairs AS (
  SELECT e.season AS boundary, e.player_id, (e.rating_after - avg(e.rating_after) OVER (PARTITION BY e.season)) / 100e0 AS pred, t.target
  FROM ending e JOIN target t ON t.player_id = e.player_id AND t.season = e.season + 1)"""


def targets(log, window=WINDOW, least=LEAST):
    """Mean performance of a player's first games of a season, if there are enough."""
    rows = first_n(log, ["season", "player_id"], ["game_date", "game_id"], window)
    return rows.groupBy("season", "player_id").agg(F.avg("perf").alias("target"), F.count("*").alias("games")).where(F.col("games") >= least)


def pairs(log, scale=100.0):
    """Rating at a season's end against performance at the start of the next: one equi-join on the shifted season."""
    table = season_ratings(log).select((F.col("season") + 1).alias("season"), "player_id", "rating_after")
    both = table.join(targets(log), ["season", "player_id"])
    mean = F.avg("rating_after").over(Window.partitionBy("season"))
    return both.select((F.col("season") - 1).alias("boundary"), "player_id", ((F.col("rating_after") - mean) / scale).alias("pred"), "target")


@query(f"WITH {TARGET_SQL} SELECT season, player_id, games, round(target, 6) + 0e0 AS target FROM target")
def target_first_n(spark, sf):
    return targets(events(spark, sf)).select("season", "player_id", "games", (F.round("target", 6) + F.lit(0.0)).alias("target"))


@query(f"WITH {TARGET_SQL} SELECT boundary, player_id, round(pred, 6) + 0e0 AS pred, round(target, 6) + 0e0 AS target FROM pairs")
def cv_pairs(spark, sf):
    return pairs(events(spark, sf)).select("boundary", "player_id", (F.round("pred", 6) + F.lit(0.0)).alias("pred"), (F.round("target", 6) + F.lit(0.0)).alias("target"))


@query(f"""
WITH {TARGET_SQL}
SELECT boundary, count(*) AS n, round(avg(power(pred - target, 2)), 6) AS mse, round(var_pop(target), 6) AS baseline_mse, round(var_pop(target) - avg(power(pred - target, 2)), 6) AS improvement,
  round(corr(pred, target), 6) AS r, round(stddev_pop(pred) / nullif(stddev_pop(target), 0), 6) AS discrimination FROM pairs GROUP BY boundary
""")
def cv_metrics(spark, sf):
    out = stats.error_metrics(pairs(events(spark, sf)), ["boundary"], "pred", "target")
    return out.select("boundary", "n", *[F.round(c, 6).alias(c) for c in ("mse", "baseline_mse", "improvement", "r", "discrimination")])


_P_SQL = """CASE WHEN n > 3 AND abs(r) < 1 THEN 2 * (exp(-z * z / 2) / sqrt(2 * pi()) * (t * (0.319381530e0 + t * (-0.356563782e0 + t * (1.781477937e0 + t * (-1.821255978e0 + t * 1.330274429e0)))))) END"""


@query(f"""
WITH {TARGET_SQL},
c AS (SELECT boundary, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(pred, target) END AS r FROM pairs GROUP BY boundary),
z AS (SELECT *, abs(r * sqrt((n - 2) / nullif(1 - r * r, 0))) AS z FROM c), t AS (SELECT *, 1 / (1 + 0.2316419e0 * z) AS t FROM z)
SELECT boundary, n, round(r, 6) AS r, round({_P_SQL}, 6) + 0e0 AS p FROM t
""")
def pearson_p(spark, sf):
    out = stats.pearson(pairs(events(spark, sf)), ["boundary"], "pred", "target")
    return out.select("boundary", "n", F.round("r", 6).alias("r"), (F.round("p", 6) + F.lit(0.0)).alias("p"))


@query(f"""
WITH {TARGET_SQL},
rk AS (SELECT boundary, rank() OVER (PARTITION BY boundary ORDER BY pred) + (count(*) OVER (PARTITION BY boundary, pred) - 1) / 2e0 AS a,
  rank() OVER (PARTITION BY boundary ORDER BY target) + (count(*) OVER (PARTITION BY boundary, target) - 1) / 2e0 AS b FROM pairs)
SELECT boundary, count(*) AS n, round(corr(a, b), 6) AS rho FROM rk GROUP BY boundary HAVING count(*) >= 3
""")
def spearman(spark, sf):
    return stats.spearman(pairs(events(spark, sf)), ["boundary"], "pred", "target").where("n >= 3").select("boundary", "n", F.round("rho", 6).alias("rho"))


@query(f"""
WITH {PERF_SQL},
team AS (SELECT game_id, team_id, season, track, max(s_team) AS s, 1 / (1 + exp(-sum(share * perf))) AS p FROM perf GROUP BY ALL)
SELECT season, track, count(*) AS n, round(avg(-(s * ln(greatest(1e-12, least(1 - 1e-12, p))) + (1 - s) * ln(1 - greatest(1e-12, least(1 - 1e-12, p))))), 6) AS log_loss, round(avg(power(p - s, 2)), 6) AS brier FROM team GROUP BY ALL
""")
def win_logloss_brier(spark, sf):
    p = 1.0 / (1.0 + F.exp(-F.sum(F.col("share") * F.col("perf"))))
    team = performed(spark, sf).groupBy("game_id", "team_id", "season", "track").agg(F.max("s_team").alias("s"), p.alias("p"))
    out = stats.log_loss_and_brier(team, ["season", "track"], "p", "s")
    return out.select("season", "track", "n", F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))


@query(f"""
WITH {PERF_SQL},
team AS (SELECT game_id, venue_id % 25 AS club, season, max(s_team) AS s, 1 / (1 + exp(-sum(share * perf))) AS p FROM perf WHERE home GROUP BY ALL),
club AS (SELECT season, club, avg(s) AS s, avg(p) AS p, count(*) AS games FROM team GROUP BY ALL)
SELECT season, count(*) AS clubs, CAST(sum(games) AS BIGINT) AS games, round(corr(p, s), 6) AS r FROM club GROUP BY season
""")
def team_win_corr(spark, sf):
    p = 1.0 / (1.0 + F.exp(-F.sum(F.col("share") * F.col("perf"))))
    team = performed(spark, sf).where("home").groupBy("game_id", (F.col("venue_id") % 25).alias("club"), "season").agg(F.max("s_team").alias("s"), p.alias("p"))
    club = team.groupBy("season", "club").agg(F.avg("s").alias("s"), F.avg("p").alias("p"), F.count("*").alias("games"))
    return club.groupBy("season").agg(F.count("*").alias("clubs"), F.sum("games").alias("games"), F.round(F.corr("p", "s"), 6).alias("r"))


@query(f"""
WITH {EVENTS_SQL},
club AS (SELECT DISTINCT season, team_id, game_date, game_id FROM ev WHERE track = 'regular'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY season, team_id ORDER BY game_date, game_id) AS j, count(*) OVER (PARTITION BY season, team_id) AS n FROM club),
cut AS (SELECT season, team_id, game_date AS cut_date, game_id AS cut_game FROM numbered WHERE j = least(n, 41)),
seen AS (SELECT e.*, row_number() OVER (PARTITION BY e.season, e.team_id, e.player_id ORDER BY e.game_date DESC, e.game_id DESC) AS k
  FROM ev e JOIN cut USING (season, team_id) WHERE (e.game_date, e.game_id) <= (cut_date, cut_game))
SELECT season, team_id, player_id, round(rating_after, 4) AS rating FROM seen WHERE k = 1
""")
def as_of_team_game(spark, sf):
    """Ratings after a team's 41st game, or its last in a shorter season."""
    log = events(spark, sf)
    club = log.where("track = 'regular'").select("season", "team_id", "game_date", "game_id").distinct()
    numbered = ranks.numbered(club, ["season", "team_id"], ["game_date", "game_id"], "j")
    game = F.struct("game_date", "game_id")
    cut = numbered.where("j <= 41").groupBy("season", "team_id").agg(F.max(game).alias("cut"))
    seen = log.join(maybe_broadcast(cut), ["season", "team_id"]).where(game <= F.col("cut"))
    last = latest(seen.select("season", "team_id", "player_id", "game_date", "game_id", "rating_after"), ["season", "team_id", "player_id"], ["game_date", "game_id"])
    return last.select("season", "team_id", "player_id", F.round("rating_after", 4).alias("rating"))


@query(f"""
WITH {EVENTS_SQL},
cut AS (SELECT season, player_id, max(struct_pack(d := game_date, g := game_id)) AS c FROM ev WHERE month(game_date) >= 7 GROUP BY ALL),
later AS (SELECT e.*, row_number() OVER (PARTITION BY e.season, e.player_id ORDER BY game_date, game_id) AS j FROM ev e JOIN cut USING (season, player_id)
  WHERE (e.game_date > c.d) OR (e.game_date = c.d AND e.game_id > c.g))
SELECT season, player_id, count(*) AS games, round(avg(perf), 6) + 0e0 AS mean_perf FROM later WHERE j <= {WINDOW} GROUP BY ALL HAVING count(*) >= {LEAST}
""")
def next_window(spark, sf):
    """The games strictly after a player's boundary game."""
    log = events(spark, sf)
    cut = log.where(F.month("game_date") >= 7).groupBy("season", "player_id").agg(F.max(F.struct("game_date", "game_id")).alias("cut"))
    later = log.join(cut, ["season", "player_id"]).where(F.struct("game_date", "game_id") > F.col("cut"))
    rows = first_n(later, ["season", "player_id"], ["game_date", "game_id"], WINDOW)
    out = rows.groupBy("season", "player_id").agg(F.count("*").alias("games"), (F.round(F.avg("perf"), 6) + F.lit(0.0)).alias("mean_perf"))
    return out.where(F.col("games") >= LEAST)


@query(f"""
WITH {PERF_SQL}
SELECT season, count(*) AS n, round(avg(CASE WHEN seen > 0 THEN 0.6e0 * z_score + 0.4e0 * z_on_court ELSE z_score END), 6) + 0e0 AS label, CAST(sum(CASE WHEN seen > 0 THEN 1 ELSE 0 END) AS BIGINT) AS blended FROM zed GROUP BY season
""")
def blended_label(spark, sf):
    seen = F.count("on_court").over(Window.partitionBy("game_id")) > 0
    rows = performed(spark, sf).withColumn("seen", seen)
    label = F.when(F.col("seen"), 0.6 * F.col("z_score") + 0.4 * F.col("z_on_court")).otherwise(F.col("z_score"))
    return rows.groupBy("season").agg(F.count("*").alias("n"), (F.round(F.avg(label), 6) + F.lit(0.0)).alias("label"), F.count_if("seen").alias("blended"))


@query("""
WITH kn AS (SELECT DISTINCT CAST(p_size % 21 AS BIGINT) AS k, CAST(20 AS BIGINT) AS n FROM part),
terms AS (SELECT k, n, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2))) AS p FROM (SELECT k, n, unnest(range(k, n + 1)) AS j FROM kn) GROUP BY ALL)
SELECT k, n, round(p, 8) AS p FROM terms
""")
def binomial_tail(spark, sf):
    kn = read(spark, sf, "part").select((F.col("p_size") % 21).cast("long").alias("k"), F.lit(20).cast("long").alias("n")).distinct()
    return kn.select("k", "n", F.round(scalar.binomial_tail(F.col("k"), F.col("n")), 8).alias("p"))


@query(f"""
WITH {PERF_SQL},
s AS (SELECT player_id, avg(perf) FILTER (track = 'regular') AS ma, var_samp(perf) FILTER (track = 'regular') AS va, count(*) FILTER (track = 'regular') AS na,
  avg(perf) FILTER (track = 'playoffs') AS mb, var_samp(perf) FILTER (track = 'playoffs') AS vb, count(*) FILTER (track = 'playoffs') AS nb FROM perf GROUP BY player_id)
SELECT player_id, na AS regular_games, nb AS playoff_games, round((mb - ma) / sqrt(va / na + vb / nb), 6) + 0e0 AS z, coalesce(abs((mb - ma) / sqrt(va / na + vb / nb)) > 1.96, false) AS significant FROM s WHERE na > 1 AND nb > 1
""")
def welch_z(spark, sf):
    regular, playoffs = F.when(F.col("track") == "regular", F.col("perf")), F.when(F.col("track") == "playoffs", F.col("perf"))
    rows = performed(spark, sf).groupBy("player_id").agg(
        F.avg(regular).alias("ma"), F.var_samp(regular).alias("va"), F.count(regular).alias("na"),
        F.avg(playoffs).alias("mb"), F.var_samp(playoffs).alias("vb"), F.count(playoffs).alias("nb"),
    ).where("na > 1 and nb > 1")
    z = (F.col("mb") - F.col("ma")) / F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb"))
    return rows.select("player_id", F.col("na").alias("regular_games"), F.col("nb").alias("playoff_games"), (F.round(z, 6) + F.lit(0.0)).alias("z"), F.coalesce(F.abs(z) > 1.96, F.lit(False)).alias("significant"))


@query(f"""
WITH {EVENTS_SQL},
m AS (SELECT season, player_id, sum(minutes) AS minutes FROM clean GROUP BY ALL)
SELECT season, count(*) AS players, round(sum(rating_after * minutes) / sum(minutes), 4) AS weighted_mean, round(stddev_pop(rating_after), 4) AS spread, round(max(rating_after), 4) AS top, arg_max(player_id, struct_pack(r := round(rating_after, 6), p := -player_id)) AS top_player
FROM ending JOIN m USING (season, player_id) GROUP BY season
""")
def season_metrics(spark, sf):
    minutes = performed(spark, sf).groupBy("season", "player_id").agg(F.sum("minutes").alias("minutes"))
    rows = season_ratings(events(spark, sf)).join(minutes, ["season", "player_id"])
    return rows.groupBy("season").agg(
        F.count("*").alias("players"), F.round(stats.weighted_mean(F.col("rating_after"), F.col("minutes")), 4).alias("weighted_mean"),
        F.round(F.stddev_pop("rating_after"), 4).alias("spread"), F.round(F.max("rating_after"), 4).alias("top"),
        F.max_by("player_id", F.struct(F.round("rating_after", 6), -F.col("player_id"))).alias("top_player"),
    )


def movements(log):
    """A row per player and season: whether the player enters, and is absent the season after (gone: the last rating then)."""
    table = season_ratings(log).select("season", "player_id", "rating_after")
    w = Window.partitionBy("player_id").orderBy("season")
    rows = table.withColumn("entry", F.lag("season").over(w).isNull()).withColumn("exit", ~F.coalesce(F.lead("season").over(w) == F.col("season") + 1, F.lit(False)))
    return rows.withColumn("gone", F.when(F.col("exit"), F.col("rating_after")))


def entries_exits(log, keys=("season",)):
    """Players, entries, exits and quartiles of the last ratings of those who go."""
    rows = written(movements(log), "movements")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("players"), F.count_if("entry").alias("entries"), F.count_if("exit").alias("exits"))
    found = selection.quantiles(rows, keys, "gone", {"exit_median": 0.5, "exit_q25": 0.25})
    out = counts.join(found, list(keys), "left") if keys else counts.join(F.broadcast(found), how="left")  # one row each
    return out.select(*keys, "players", "entries", "exits", *[F.round(c, 4).alias(c) for c in ("exit_median", "exit_q25")])


ENTRY_EXIT_SQL = f"""
WITH {EVENTS_SQL}, firsts AS (SELECT player_id, min(season) AS season FROM ev GROUP BY 1), lasts AS (SELECT DISTINCT season, player_id FROM ev)
SELECT e.season, count(*) AS players, count(*) FILTER (f.player_id IS NOT NULL) AS entries, count(*) FILTER (n.player_id IS NULL) AS exits,
  round(median(e.rating_after) FILTER (n.player_id IS NULL), 4) AS exit_median, round(quantile_cont(e.rating_after, 0.25) FILTER (n.player_id IS NULL), 4) AS exit_q25
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, player_id ORDER BY game_date DESC, game_id DESC) AS k2 FROM ev) WHERE k2 = 1) e
LEFT JOIN firsts f ON f.player_id = e.player_id AND f.season = e.season LEFT JOIN lasts n ON n.player_id = e.player_id AND n.season = e.season + 1 GROUP BY e.season
"""


@query(ENTRY_EXIT_SQL)
def entry_exit(spark, sf):
    """Entries and exits of every season; absent players are tested on a small table."""
    return entries_exits(events(spark, sf))


@query(f"""
WITH {EVENTS_SQL}, firsts AS (SELECT player_id, min(season) AS season FROM ev GROUP BY 1),
m AS (SELECT e.*, f.player_id IS NOT NULL AS entry, CASE WHEN n.player_id IS NULL THEN e.rating_after END AS gone FROM ending e LEFT JOIN firsts f ON f.player_id = e.player_id AND f.season = e.season
  LEFT JOIN ending n ON n.player_id = e.player_id AND n.season = e.season + 1),
every AS (SELECT count(*) AS all_players, count(*) FILTER (entry) AS all_entries, count(gone) AS all_exits, round(median(gone), 4) AS all_exit_median, round(quantile_cont(gone, 0.25), 4) AS all_exit_q25 FROM m),
seasons AS (SELECT season, count(*) AS players, count(*) FILTER (entry) AS entries, count(gone) AS exits, round(median(gone), 4) AS exit_median, round(quantile_cont(gone, 0.25), 4) AS exit_q25 FROM m GROUP BY season)
SELECT * FROM seasons, every
""")
def entry_exit_all(spark, sf):
    """Entries and exits of every season, beside those of all seasons together: one group of any size."""
    log = events(spark, sf)
    every = entries_exits(log, keys=())
    every = every.select(*[F.col(c).alias(f"all_{c}") for c in every.columns])
    return entries_exits(log).join(F.broadcast(every))  # one row


_DRAW = "(((((12345 + {a} % 2147483647) * 48271) % 2147483647 + {b} % 2147483647) * 48271) % 2147483647 * 48271) % 2147483647"


@query(f"""
WITH {TARGET_SQL},
s AS (SELECT player_id, sum(power(pred - target, 2)) AS s, count(*) AS c FROM pairs GROUP BY player_id),
d AS (SELECT *, unnest(range(0, 200)) AS draw FROM s),
u AS (SELECT *, {_DRAW.format(a="player_id", b="draw")} / 2147483647e0 AS u FROM d),
t AS (SELECT *, (u >= 0.36787944117144233e0)::INT + (u >= 0.7357588823428847e0)::INT + (u >= 0.9196986029286058e0)::INT + (u >= 0.9810118431238462e0)::INT + (u >= 0.9963401531726563e0)::INT + (u >= 0.9994058151824183e0)::INT AS times FROM u)
SELECT draw, round(sum(s * times) / nullif(sum(c * times), 0), 6) AS mean FROM t GROUP BY draw
""")
def cluster_bootstrap(spark, sf):
    rows = pairs(events(spark, sf)).withColumn("error", F.pow(F.col("pred") - F.col("target"), 2))
    return stats.bootstrap_means(rows, "player_id", "error", 200).select(F.col("draw").cast("long").alias("draw"), F.round("mean", 6).alias("mean"))


@query(f"""
WITH {TARGET_SQL},
l AS (SELECT *, row_number() OVER (PARTITION BY boundary ORDER BY player_id) AS place FROM pairs),
r AS (SELECT boundary, target AS shuffled, row_number() OVER (PARTITION BY boundary ORDER BY ((((12345 + player_id % 2147483647) * 48271) % 2147483647) * 48271) % 2147483647, player_id) AS place FROM pairs)
SELECT boundary, count(*) AS n, round(avg(power(pred - shuffled, 2)), 6) AS random_mse FROM l JOIN r USING (boundary, place) GROUP BY boundary
""")
def permutation_baseline(spark, sf):
    rows = stats.shuffled_within(pairs(events(spark, sf)), ["boundary"], "target", "player_id")
    return rows.groupBy("boundary").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("pred") - F.col("shuffled_target"), 2)), 6).alias("random_mse"))
