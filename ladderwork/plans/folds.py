"""The rating fold and its variants; the twins are recursive SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ladderwork.functions.windows import first_n
from ladderwork.operators import fold, performance, quality
from ladderwork.plans.performance import PERF_SQL, performed, picks
from ladderwork.plans.registry import query
from ladderwork.schema import RatingParams
from ladderwork.sources import arena
from ladderwork.sources.arena import CLEAN_SQL
from ladderwork.sources.readers import parameter_grid
from ladderwork.sources.warehouse import written

BASE = RatingParams()
#: The season that the tests fold alone, in Spark and in SQL.
LOG_SEASON = 2001


def _state_sql(
    step: str = "perf - (r - avg(r) OVER ()) / 285e0", start: str = "1425e0", order: str = "game_date, game_id", multiplier: str = "1e0",
    extra: str = "", where: str = "true", games0: str = "0", boost: str = "5", k: str = "45e0",
) -> str:
    """Final state of the fold: one recursion step per game, keyed by player."""
    return f"""
WITH RECURSIVE {PERF_SQL},
dealt AS (
  SELECT *, dense_rank() OVER (ORDER BY {order}) AS n FROM perf WHERE {where}),
starts AS (SELECT player_id AS pid, CAST({start} AS DOUBLE) AS r0, CAST({games0} AS BIGINT) AS g0 FROM (SELECT DISTINCT player_id FROM dealt) s {extra}),
st(pid, n, r, gp) USING KEY (pid) AS (
  SELECT pid, CAST(0 AS BIGINT), r0, g0 FROM starts
  UNION
  SELECT pid, n, r + raw - avg(raw) OVER (), gp + 1 FROM (
    SELECT pid, n, r, gp, {k} * (1 + {boost} * exp(-gp / 60e0)) * {multiplier} * share * (used + lift) AS raw FROM (
      SELECT s.pid, d.n, s.r, s.gp, d.share, d.track, {step} AS used, {{lift}} AS lift
      FROM dealt d JOIN recurring.st s ON s.pid = d.player_id WHERE d.n = (SELECT max(n) FROM recurring.st) + 1)))
"""


def state_sql(lift: str = "0e0", **kw: str) -> str:
    return _state_sql(**kw).replace("{lift}", lift)


FINAL = "SELECT pid AS player_id, round(r, 4) AS rating, gp AS games_played FROM st WHERE n > 0"


def states(rows, params, *args, **kw):
    return fold.checkpoint(fold.rating_updates(rows, params, *args, columns=fold.STATE, last=True, **kw))


def final(out):
    return out.select("player_id", F.round("rating", 4).alias("rating"), "games_played")


@query(state_sql() + FINAL)
def rating_final_state(spark, sf):
    """The flagship: ratings of all players after the last game."""
    return final(states(performed(spark, sf), [BASE]))


@query(state_sql(order="game_date DESC, game_id DESC") + FINAL)
def rating_reverse(spark, sf):
    return final(states(performed(spark, sf), [BASE], reverse=True))


@query(state_sql(multiplier="(CASE WHEN track = 'playoffs' THEN 0.5e0 ELSE 1e0 END)") + FINAL)
def rating_playoff_k(spark, sf):
    return final(states(performed(spark, sf), [replace(BASE, playoff_multiplier=0.5)]))


@query(state_sql(step="perf - (r - 1500e0) / 285e0") + FINAL)
def rating_anchor_fixed(spark, sf):
    return final(states(performed(spark, sf), [replace(BASE, anchor="fixed")]))


@query(state_sql(step="perf") + FINAL)
def rating_no_anchor(spark, sf):
    return final(states(performed(spark, sf), [replace(BASE, anchor=None)]))


@query()
def rating_anchor_league(spark, sf):
    """The anchor is the mean over players seen so far; tested against a brute-force fold."""
    return final(states(performed(spark, sf), [replace(BASE, anchor="league")]))


_TEAM = "(sum(r * share) FILTER (team_id = '{t}') OVER () / sum(share) FILTER (team_id = '{t}') OVER ())"
_HOME, _AWAY = _TEAM.format(t="F"), _TEAM.format(t="O")
_LIFT = f"""(0.6e0 * (s_team - 1 / (1 + power(10e0, -(CASE WHEN team_id = 'F' THEN {_HOME} - {_AWAY} + 65e0 ELSE {_AWAY} - {_HOME} END) / 400))))"""


@query(state_sql(lift=_LIFT) + FINAL)
def rating_theta(spark, sf):
    """The result against the expectation counts too; the home bonus is one-sided."""
    return final(states(performed(spark, sf), [replace(BASE, theta=0.6, home_advantage=65.0)]))


@query(
    state_sql(
        start="CASE WHEN player_id % 4 = 0 THEN 1350e0 ELSE greatest(1580e0 - (player_id % 60) * 5, 1350e0) END"
    ) + FINAL
)
def rating_draft_start(spark, sf):
    start = performance.draft_start(picks(spark, sf)).select("player_id", "start_rating")
    return final(states(performed(spark, sf).join(start, "player_id", "left"), [BASE]))


@query(state_sql() + FINAL)
def rating_resume(spark, sf):
    """Folding to a season and resuming from the checkpoint equals folding through."""
    rows = performed(spark, sf)
    early = written(states(rows.where("season <= 1996"), [BASE]).drop("variant"), "early")
    late = written(states(rows.where("season > 1996"), [BASE], early).drop("variant"), "late")
    both = late.unionByName(early.join(late, "player_id", "left_anti"))
    return both.select("player_id", F.round("rating", 4).alias("rating"), "games_played")


#: The sets of the grid: the sweep over k and scale, and two steps at the flagship's scale.
GRID = [replace(BASE, variant=f"k={k}", k=float(k)) for k in (20, 45)]
GRID += [replace(p, variant=f"k={p.k:g} scale={p.surprise_scale:g}") for p in parameter_grid('{"k": [8.0, 10.0, 15.0, 20.0], "surprise_scale": [300.0, 350.0, 400.0, 500.0]}')]
#: First regular games of a season that make a target, and the least of them.
FIRST_GAMES, LEAST_GAMES = 10, 3

def _sets(text: str) -> str:
    return ", ".join(text.format(i=i, k=p.k, scale=p.surprise_scale) for i, p in enumerate(GRID))


#: One recursion with a column for each set; a player's present state has season -1, the others are those at the end of a season.
GRID_SQL = f"""
WITH RECURSIVE {PERF_SQL},
dealt AS (SELECT *, dense_rank() OVER (ORDER BY game_date, game_id) AS n FROM perf),
grid AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{p.variant}', {p.k}e0, {p.surprise_scale}e0)" for i, p in enumerate(GRID))}) g(place, variant, k, scale)),
st(pid, season, n, gp, {_sets("r{i}")}) USING KEY (pid, season) AS (
  SELECT player_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), {_sets("1425e0")} FROM (SELECT DISTINCT player_id FROM dealt)
  UNION
  SELECT pid, unnest([CAST(-1 AS BIGINT), season]), n, gp, {_sets("r{i}")} FROM (
    SELECT pid, season, n, gp + 1 AS gp, {_sets("r{i} + d{i} - avg(d{i}) OVER () AS r{i}")} FROM (
      SELECT *, {_sets("{k}e0 * (1 + 5 * exp(-gp / 60e0)) * share * (perf - (r{i} - avg(r{i}) OVER ()) / {scale}e0) AS d{i}")} FROM (
        SELECT s.pid, d.season, d.n, s.gp, d.share, d.perf, {_sets("s.r{i}")}
        FROM dealt d JOIN recurring.st s ON s.pid = d.player_id WHERE s.season = -1 AND d.n = (SELECT max(n) FROM recurring.st) + 1)))),
long AS (SELECT variant, k, scale, s.* FROM (SELECT pid, season, n, unnest(range({len(GRID)})) AS place, unnest([{_sets("r{i}")}]) AS r FROM st) s JOIN grid USING (place)),
target AS (
  SELECT season, player_id, avg(perf) AS target FROM (SELECT *, row_number() OVER (PARTITION BY season, player_id ORDER BY game_date, game_id) AS j FROM perf WHERE track = 'regular')
  WHERE j <= {FIRST_GAMES} GROUP BY ALL HAVING count(*) >= {LEAST_GAMES}),
pred AS (SELECT variant, season, pid AS player_id, (r - avg(r) OVER (PARTITION BY variant, season)) / scale AS pred FROM long WHERE season >= 0),
metric AS (
  SELECT variant, count(*) AS pairs, count(DISTINCT p.season) AS boundaries, round(avg(power(target - pred, 2)), 6) AS mse, round(avg(target * target), 6) AS baseline_mse,
    round(corr(pred, target), 6) AS r, round(stddev_pop(pred), 6) AS pred_sd, round(stddev_pop(target), 6) AS target_sd, round(stddev_pop(pred) / nullif(stddev_pop(target), 0), 6) AS discrimination
  FROM pred p JOIN target t ON t.player_id = p.player_id AND t.season = p.season + 1 GROUP BY variant),
state AS (SELECT variant, count(*) AS players, round(avg(r), 4) AS mean, round(max(r), 4) AS top FROM long WHERE season = -1 AND n > 0 GROUP BY variant)
SELECT variant, k, scale, players, mean, top, pairs, boundaries, mse, baseline_mse, m.r, pred_sd, target_sd, discrimination FROM grid JOIN state USING (variant) LEFT JOIN metric m USING (variant)
"""


@query(GRID_SQL)
def rating_grid(spark, sf):
    """Parameter sets side by side, each judged by what its ratings at a season's end foretell.

    Ratings less the season's mean, over the scale, against the mean
    performance in the next season's first regular games; all boundaries
    together.  One scan, one set of features and one fold serve all sets.
    """
    rows, players = fold.with_leagues(performed(spark, sf), ["game_id", "game_date", "season", "player_id", "team_id", "share", "perf"])
    ends = written(fold.grid_updates(rows, GRID, players), "grid-ends")
    first = first_n(rows.where("track = 'regular'").select("season", "player_id", "game_date", "game_id", "perf"), ["season", "player_id"], ["game_date", "game_id"], FIRST_GAMES)
    target = first.groupBy("season", "player_id").agg(F.avg("perf").alias("target"), F.count("*").alias("games")).where(F.col("games") >= LEAST_GAMES)

    sets = spark.createDataFrame([(i, p.variant, p.k, p.surprise_scale) for i, p in enumerate(GRID)], "place int, variant string, k double, scale double")
    each = ends.join(target.select((F.col("season") - 1).alias("season"), "player_id", "target"), ["season", "player_id"], "left")
    each = each.select("season", "player_id", "target", F.posexplode("ratings").alias("place", "rating"))
    means = each.groupBy("place", "season").agg(F.avg("rating").alias("mean"))  # a row a set and season
    pairs = each.where("target is not null").join(F.broadcast(means), ["place", "season"]).join(F.broadcast(sets), "place")
    pairs = pairs.withColumn("pred", (F.col("rating") - F.col("mean")) / F.col("scale"))
    at = lambda c: F.round(c, 6)
    metric = pairs.groupBy("place").agg(
        F.count("*").alias("pairs"), F.countDistinct("season").alias("boundaries"), at(F.avg(F.pow(F.col("target") - F.col("pred"), 2))).alias("mse"),
        at(F.avg(F.col("target") * F.col("target"))).alias("baseline_mse"), at(F.corr("pred", "target")).alias("r"), at(F.stddev_pop("pred")).alias("pred_sd"),
        at(F.stddev_pop("target")).alias("target_sd"), at(F.stddev_pop("pred") / F.nullif(F.stddev_pop("target"), F.lit(0.0))).alias("discrimination"),
    )
    state = ends.groupBy("player_id").agg(F.max_by("ratings", "games_played").alias("ratings")).select(F.posexplode("ratings").alias("place", "rating"))
    state = state.groupBy("place").agg(F.count("*").alias("players"), F.round(F.avg("rating"), 4).alias("mean"), F.round(F.max("rating"), 4).alias("top"))
    return F.broadcast(sets).join(state, "place").join(F.broadcast(metric), "place", "left").drop("place")


LOG_SQL = f"""
WITH RECURSIVE {PERF_SQL},
dealt AS (SELECT *, dense_rank() OVER (ORDER BY game_date, game_id) AS n FROM perf WHERE season = {LOG_SEASON}),
st(n, pid, b, gp, raw, a) USING KEY (n, pid) AS (
  SELECT CAST(0 AS BIGINT), player_id, 0e0, CAST(-1 AS BIGINT), 0e0, 1425e0 FROM (SELECT DISTINCT player_id FROM dealt)
  UNION
  SELECT n, pid, r, gp, raw, r + raw - avg(raw) OVER () FROM (
    SELECT n, pid, r, gp, 45e0 * (1 + 5 * exp(-gp / 60e0)) * share * (perf - (r - avg(r) OVER ()) / 285e0) AS raw FROM (
      SELECT d.n, d.player_id AS pid, d.share, d.perf, s.r, s.gp FROM dealt d
      JOIN (SELECT pid, arg_max(a, n) AS r, arg_max(gp, n) + 1 AS gp FROM recurring.st GROUP BY pid) s ON s.pid = d.player_id
      WHERE d.n = (SELECT max(n) FROM recurring.st) + 1)))
"""


def season_log(spark, sf):
    return fold.rating_updates(performed(spark, sf).where(F.col("season") == LOG_SEASON), [BASE])


def _shown(log):
    rounded = [F.round(c, 4).alias(c) for c in ("rating_before", "delta_raw", "rating_after")]
    return log.select("game_id", "player_id", "games_before", *rounded)


#: The log of one season folded alone; quadratic in SQL, so only the tests run it.
SEASON_LOG_SQL = LOG_SQL + "SELECT d.game_id, st.pid AS player_id, gp AS games_before, round(b, 4) AS rating_before, round(raw, 4) AS delta_raw, round(a, 4) AS rating_after FROM st JOIN (SELECT DISTINCT n, game_id FROM dealt) d USING (n)"


@query()
def rating_event_log(spark, sf):
    """The event log's main columns over all games; the tests hold a season of it against SQL."""
    return _shown(fold.rating_updates(performed(spark, sf), [BASE], columns=["game_id", *fold.STATE, "rating_before", "delta_raw"]))


@query()
def rating_full_log(spark, sf):
    """The event log of all games with all its columns; tested against a plain Python fold."""
    return fold.rating_updates(performed(spark, sf), [BASE])


@query("SELECT unnest(['zero_sum', 'chain', 'games_in_steps', 'no_nulls', 'range']) AS check_name, CAST(0 AS BIGINT) AS failures")
def rating_log_checks(spark, sf):
    """Invariants of the whole log; each must hold for every row."""
    log = fold.rating_updates(performed(spark, sf), [BASE, replace(BASE, variant="theta", theta=0.6)], columns=quality.CHECKED)
    return quality.log_checks(written(log, "checked-log"))


@query(f"WITH {CLEAN_SQL} SELECT track, season, count(*) AS updates, count(DISTINCT game_id) AS games FROM clean GROUP BY ALL")
def event_counts(spark, sf):
    """A clean row is an update, so the counts need no fold."""
    return arena.clean(spark, sf).groupBy("track", "season").agg(F.count("*").alias("updates"), F.countDistinct("game_id").alias("games"))


@query()
def rating_three_pass(spark, sf):
    """Forward, backward, forward again; a task makes all passes over its leagues."""
    return final(fold.three_pass_states(performed(spark, sf), BASE))


def team_games(spark, sf):
    """One row per usable game; nations of the venue stand for teams."""
    home = arena.clean(spark, sf).where("home").groupBy("game_id", "game_date", "venue_id").agg(F.max("s_team").alias("home_won"))
    team = lambda c: F.concat(F.lit("t"), c.cast("string"))
    return home.select("game_id", "game_date", team(F.col("venue_id") % 25).alias("home_team"), team((F.col("venue_id") % 25 + 1 + F.col("game_id") % 24) % 25).alias("away_team"), "home_won")


@query()
def team_elo_final(spark, sf):
    """Team ratings after the last game; tested against a brute-force fold."""
    updates = fold.team_updates(team_games(spark, sf), home_advantage=65.0)
    return updates.groupBy("team").agg(F.round(F.max_by("rating_after", F.struct("game_date", "game_id")), 4).alias("rating"))
