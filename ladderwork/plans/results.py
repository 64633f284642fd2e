"""Reports with their context: lifts with ranks, records with opponents, coverage, tops, mentions, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.functions import ranks, scalar, selection
from ladderwork.functions.windows import running_max_before
from ladderwork.plans.context import game_context
from ladderwork.plans.performance import PERF_SQL, performed
from ladderwork.plans.registry import query
from ladderwork.plans.timeline import EVENTS_SQL, events, season_ratings
from ladderwork.sources import arena
from ladderwork.sources.arena import CLEAN_SQL
from ladderwork.sources.warehouse import written

#: Share of a career's best games in the high end, and games that a player needs on each side.
TOP_SHARE, LEAST_REGULAR, LEAST_PLAYOFFS = 0.05, 20, 5


def _variant_sql(name: str, weight: float) -> str:
    return f"""
{name}_r AS (SELECT player_id, game_id, game_date, track, 1500 + sum(perf * CASE WHEN track = 'playoffs' THEN {weight}e0 ELSE 1e0 END) OVER (PARTITION BY player_id ORDER BY game_date, game_id) AS v FROM perf),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY round(v, 6) DESC, game_date, game_id) AS k, count(*) OVER (PARTITION BY player_id) AS n FROM {name}_r),
{name}_p AS (SELECT player_id, max(v) AS peak, max(CAST(game_date AS DATE)) FILTER (k = 1) AS day, max(track) FILTER (k = 1) AS track, avg(v) FILTER (k <= greatest(1, ceil(n * {TOP_SHARE}))) AS high FROM {name}_k GROUP BY player_id),
{name} AS (SELECT *, row_number() OVER (ORDER BY round(peak, 6) DESC, player_id) AS place FROM {name}_p)"""


def variant_peaks(rows: DataFrame, weight: float, name: str) -> DataFrame:
    """Peak, its day and track, mean of the best games and place of each career, the playoffs' steps weighted."""
    w = Window.partitionBy("player_id")
    v = F.lit(1500.0) + F.sum(F.col("perf") * F.when(F.col("track") == "playoffs", weight).otherwise(1.0)).over(w.orderBy("game_date", "game_id"))
    rows = rows.withColumn("v", v).withColumn("shown", F.round("v", 6))
    rows = rows.withColumn("k", F.row_number().over(w.orderBy(F.desc("shown"), "game_date", "game_id"))).withColumn("n", F.count("*").over(w))
    first = lambda c: F.max(F.when(F.col("k") == 1, c))
    best = F.col("k") <= F.greatest(F.lit(1), F.ceil(F.col("n") * TOP_SHARE))
    out = rows.groupBy("player_id").agg(
        F.max("v").alias(f"peak_{name}"), first(F.to_date("game_date")).alias(f"day_{name}"), first(F.col("track")).alias(f"track_{name}"), F.avg(F.when(best, F.col("v"))).alias(f"high_{name}")
    )
    out = out.withColumn("shown", F.round(f"peak_{name}", 6))
    return ranks.numbered(out, [], [F.desc("shown"), F.asc("player_id")], f"place_{name}").drop("shown")


_KIND = "CASE WHEN a <= -0.01 OR b <= -0.01 THEN 'playoff_penalty' WHEN a >= 0.01 AND b >= 0.01 THEN 'playoff_redefined' WHEN a >= 0.01 AND abs(b) < 0.01 THEN 'playoff_spike' WHEN abs(a) < 0.01 AND b >= 0.01 THEN 'steady_boost' ELSE 'playoff_neutral' END"


@query(f"""
WITH {PERF_SQL},{_variant_sql("x", 0.0)},{_variant_sql("y", 2.0)},
c AS (SELECT player_id, count(*) FILTER (track = 'regular') AS regular_games, count(*) FILTER (track = 'playoffs') AS playoff_games FROM perf GROUP BY 1),
m AS (SELECT c.*, x.peak AS px, y.peak AS py, x.high AS hx, y.high AS hy, x.day AS dx, y.day AS dy, x.track AS tx, y.track AS ty, x.place AS rx, y.place AS ry, (y.peak - x.peak) / x.peak AS a, (y.high - x.high) / x.high AS b
  FROM c JOIN x USING (player_id) JOIN y USING (player_id) WHERE regular_games >= {LEAST_REGULAR} AND playoff_games >= {LEAST_PLAYOFFS})
SELECT player_id, regular_games, playoff_games, round(px, 4) AS peak_pk0, round(py, 4) AS peak_pk2, round(a, 6) + 0e0 AS relative_peak_lift, rx AS peak_rank_pk0, ry AS peak_rank_pk2, rx - ry AS peak_rank_change, dx AS peak_day_pk0, dy AS peak_day_pk2,
  tx || '_to_' || ty AS peak_source_switch, CASE WHEN tx = 'regular' AND ty = 'playoffs' THEN 1 WHEN tx = 'playoffs' AND ty = 'regular' THEN -1 ELSE 0 END::INTEGER AS peak_source_signal,
  round(hx, 4) AS high_end_pk0, round(hy, 4) AS high_end_pk2, round(b, 6) + 0e0 AS relative_high_end_lift, {_KIND} AS analysis_class, CASE WHEN a >= 0 AND b >= 0 THEN 'Q1' WHEN a < 0 AND b >= 0 THEN 'Q2' WHEN a < 0 AND b < 0 THEN 'Q3' ELSE 'Q4' END AS quadrant FROM m
""")
def lift_ranking(spark, sf):
    """Careers without and with doubled playoff steps: peaks, high ends, places among all, classes."""
    rows = written(performed(spark, sf).select("player_id", "game_id", "game_date", "track", "perf"), "steps")
    games = rows.groupBy("player_id").agg(F.count_if(F.col("track") == "regular").alias("regular_games"), F.count_if(F.col("track") == "playoffs").alias("playoff_games"))
    games = games.where((F.col("regular_games") >= LEAST_REGULAR) & (F.col("playoff_games") >= LEAST_PLAYOFFS))
    both = games.join(variant_peaks(rows, 0.0, "pk0"), "player_id").join(variant_peaks(rows, 2.0, "pk2"), "player_id")
    peak = (F.col("peak_pk2") - F.col("peak_pk0")) / F.col("peak_pk0")
    high = (F.col("high_pk2") - F.col("high_pk0")) / F.col("high_pk0")
    label, signal = scalar.source_switch(F.col("track_pk0"), F.col("track_pk2"))
    at = lambda c, n: F.round(c, 4).alias(n)
    return both.select(
        "player_id", "regular_games", "playoff_games", at("peak_pk0", "peak_pk0"), at("peak_pk2", "peak_pk2"), (F.round(peak, 6) + F.lit(0.0)).alias("relative_peak_lift"),
        F.col("place_pk0").alias("peak_rank_pk0"), F.col("place_pk2").alias("peak_rank_pk2"), (F.col("place_pk0") - F.col("place_pk2")).alias("peak_rank_change"),
        F.col("day_pk0").alias("peak_day_pk0"), F.col("day_pk2").alias("peak_day_pk2"), label.alias("peak_source_switch"), signal.cast("int").alias("peak_source_signal"),
        at("high_pk0", "high_end_pk0"), at("high_pk2", "high_end_pk2"), (F.round(high, 6) + F.lit(0.0)).alias("relative_high_end_lift"),
        scalar.lift_kind(peak, high).alias("analysis_class"), scalar.quadrant(peak, high).alias("quadrant"),
    )


@query(f"""
WITH {EVENTS_SQL},
r AS (SELECT *, max(rating_after) OVER (ORDER BY game_date, game_id, player_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ev),
s AS (SELECT game_id, player_id, home, CAST(floor(CASE WHEN home THEN team_score ELSE other_score END) AS BIGINT) AS hs, CAST(floor(CASE WHEN home THEN other_score ELSE team_score END) AS BIGINT) AS vs FROM clean)
SELECT CAST(game_date AS DATE) AS day, game_id, player_id, round(rating_after, 2) AS rating, round(best, 2) AS record_before, CASE WHEN home THEN 'O' ELSE 'F' END AS opponent,
  CASE WHEN (home AND hs > vs) OR (NOT home AND vs > hs) THEN 'W ' || hs || '-' || vs WHEN home THEN 'L ' || hs || '-' || vs ELSE 'L ' || vs || '-' || hs END AS result, CASE WHEN track = 'playoffs' THEN 'Playoffs' ELSE 'Regular' END AS game_type
FROM r JOIN s USING (game_id, player_id) WHERE best IS NULL OR rating_after > best
""")
def records_in_context(spark, sf):
    """All-time records as they fall, with opponent, result and kind of game."""
    log = events(spark, sf).withColumn("day", F.to_date("game_date"))
    rows = running_max_before(log, "rating_after", "day", ["game_date", "game_id", "player_id"]).where("max_before is null or rating_after > max_before")
    kind = F.when(F.col("track") == "playoffs", "Playoffs").otherwise("Regular")
    out = rows.join(game_context(spark, sf), ["game_id", "player_id"])
    return out.select("day", "game_id", "player_id", F.round("rating_after", 2).alias("rating"), F.round("max_before", 2).alias("record_before"), "opponent", "result", kind.alias("game_type"))


@query(f"WITH {EVENTS_SQL} SELECT season, season + 1 AS season_end, arg_max(player_id, struct_pack(r := round(rating_after, 6), p := -player_id)) AS player_id, round(max(rating_after), 4) AS rating FROM ending GROUP BY season")
def top_by_season(spark, sf):
    """The highest rated player at each season's end (the least id of equals)."""
    key = F.struct(F.round("rating_after", 6), -F.col("player_id"))
    out = season_ratings(events(spark, sf)).groupBy("season").agg(F.max_by("player_id", key).alias("player_id"), F.round(F.max("rating_after"), 4).alias("rating"))
    return out.select("season", (F.col("season") + 1).alias("season_end"), "player_id", "rating")


@query(f"""
WITH {CLEAN_SQL},
g AS (SELECT season, game_id, count(*) AS players FROM clean GROUP BY ALL),
s AS (SELECT season, count(*) AS games, avg(players) AS mean_players, median(players) AS median_players, quantile_cont(players, 0.1) AS p10_players, quantile_cont(players, 0.9) AS p90_players, 100 * avg(CASE WHEN players >= 5 THEN 1e0 ELSE 0e0 END) AS percent_5plus FROM g GROUP BY season),
t AS (SELECT season, venue_id % 25 AS club, count(DISTINCT game_id) AS games FROM clean GROUP BY ALL),
q AS (SELECT season, count(*) AS clubs, avg(games) AS mean_club_games, min(games) AS least_club_games, median(games) AS median_club_games, max(games) AS most_club_games FROM t GROUP BY season)
SELECT season, s.games, round(mean_players, 4) AS mean_players, round(median_players, 4) AS median_players, round(p10_players, 4) AS p10_players, round(p90_players, 4) AS p90_players, round(percent_5plus, 4) AS percent_5plus,
  clubs, round(mean_club_games, 4) AS mean_club_games, least_club_games, round(median_club_games, 4) AS median_club_games, most_club_games FROM s JOIN q USING (season)
""")
def window_coverage(spark, sf):
    """Players a game and games a club in each season, with quantiles."""
    rows = written(arena.clean(spark, sf).select("season", "game_id", (F.col("venue_id") % 25).alias("club")), "appearances")
    games = rows.groupBy("season", "game_id").agg(F.count("*").alias("players"))
    clubs = rows.groupBy("season", "club").agg(F.countDistinct("game_id").alias("games"))
    full = games.groupBy("season").agg((100 * F.avg((F.col("players") >= 5).cast("double"))).alias("percent"))
    a = selection.described(games, ["season"], "players", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    b = selection.described(clubs, ["season"], "games", {"middle": 0.5})
    b = b.select("season", F.col("n").alias("clubs"), F.round("mean", 4).alias("mean_club_games"), F.col("least").cast("long").alias("least_club_games"), F.round("middle", 4).alias("median_club_games"), F.col("greatest").cast("long").alias("most_club_games"))
    at = lambda c: F.round(c, 4).alias(f"{c}_players")
    return a.join(full, "season").join(b, "season").select("season", F.col("n").alias("games"), *map(at, ("mean", "median", "p10", "p90")), F.round("percent", 4).alias("percent_5plus"), *b.columns[1:])


_CORES_SQL = f"""WITH {CLEAN_SQL},
m AS (SELECT season, venue_id % 25 AS club, player_id, sum(minutes) AS minutes FROM clean WHERE home GROUP BY ALL),
core AS (SELECT *, row_number() OVER (PARTITION BY season, club ORDER BY minutes DESC, player_id) AS k FROM m)"""


@query(f"""
{_CORES_SQL},
line AS (SELECT season, club, size, string_agg(CAST(player_id AS VARCHAR), ' / ' ORDER BY k) AS players FROM core, (SELECT unnest([2, 3, 5]) AS size) WHERE k <= size GROUP BY ALL),
each AS (SELECT DISTINCT season, club, size, unnest(string_split(players, ' / ')) AS player FROM line)
SELECT player, count(*) AS mentions, count(*) FILTER (size = 2) AS in_two, count(*) FILTER (size = 3) AS in_three, count(*) FILTER (size = 5) AS in_five FROM each GROUP BY player ORDER BY mentions DESC, player LIMIT 12
""")
def core_mentions(spark, sf):
    """The twelve players named most often in the texts of clubs' cores, each once a text."""
    minutes = arena.clean(spark, sf).where("home").groupBy("season", (F.col("venue_id") % 25).alias("club"), "player_id").agg(F.sum("minutes").alias("minutes"))
    core = minutes.withColumn("k", F.row_number().over(Window.partitionBy("season", "club").orderBy(F.desc("minutes"), "player_id"))).where("k <= 5")
    line = core.groupBy("season", "club").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "player_id"))), lambda x: x["player_id"].cast("string")).alias("five"))
    line = line.withColumn("size", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5)))).withColumn("players", F.array_join(F.slice("five", F.lit(1), F.col("size")), " / "))
    return mentioned(line, "players", " / ", "size", {"in_two": 2, "in_three": 3, "in_five": 5}, 12)


def mentioned(texts: DataFrame, text: str, separator: str, slot: str, slots: dict[str, int], top: int) -> DataFrame:
    """How often each name stands in separated texts (once a text), in all and by slot; the most frequent ones."""
    names = texts.select(slot, F.explode(F.array_distinct(F.split(text, separator))).alias("player"))
    counts = names.groupBy("player").agg(F.count("*").alias("mentions"), *[F.count_if(F.col(slot) == v).alias(n) for n, v in slots.items()])
    return counts.orderBy(F.desc("mentions"), "player").limit(top)


@query(f"""
WITH {EVENTS_SQL}
SELECT CASE WHEN season < 1980 THEN '1976-79' WHEN season < 1990 THEN '1980s' WHEN season < 2000 THEN '1990s' WHEN season < 2010 THEN '2000s' WHEN season < 2020 THEN '2010s' ELSE '2020s' END AS by_start,
  CASE WHEN season + 1 < 1980 THEN '1977-79' WHEN season + 1 < 1990 THEN '1980s' WHEN season + 1 < 2000 THEN '1990s' WHEN season + 1 < 2010 THEN '2000s' WHEN season + 1 < 2020 THEN '2010s' ELSE '2020-26' END AS by_end,
  count(*) AS player_seasons, printf('%.1f', max(rating_after)) AS top_label, printf('%.2f', avg(rating_after)) AS mean_label FROM ending GROUP BY ALL
""")
def period_labels(spark, sf):
    """Both sets of period labels (by the year a season starts and ends), numbers as texts of fixed decimals."""
    rows = season_ratings(events(spark, sf))
    by = [scalar.period_of_start(F.col("season")).alias("by_start"), scalar.period_of_end(F.col("season") + 1).alias("by_end")]
    return rows.groupBy(*by).agg(
        F.count("*").alias("player_seasons"), scalar.fixed_decimals(F.max("rating_after"), 1).alias("top_label"), scalar.fixed_decimals(F.avg("rating_after"), 2).alias("mean_label")
    )
