"""Labels, texts and clocks around the ratings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ladderwork.functions import scalar
from ladderwork.functions.windows import recentred
from ladderwork.plans.performance import PERF_SQL, performed
from ladderwork.plans.registry import query
from ladderwork.sources import arena
from ladderwork.sources.arena import CLEAN_SQL, GAMES_SQL, read

_CHANGE = "avg(perf) FILTER (track = '{t}' AND season > 1996) - avg(perf) FILTER (track = '{t}' AND season <= 1996)"


@query(f"""
WITH {PERF_SQL}, c AS (SELECT player_id, {_CHANGE.format(t="regular")} AS x, {_CHANGE.format(t="playoffs")} AS y FROM perf GROUP BY player_id)
SELECT player_id, CASE WHEN x >= 0 AND y >= 0 THEN 'all_phase_riser' WHEN x < 0 AND y >= 0 THEN 'playoff_reversal' WHEN x < 0 AND y < 0 THEN 'all_phase_decliner' WHEN x >= 0 AND y < 0 THEN 'playoff_penalty' END AS phase,
  round(sqrt(x * x + y * y), 6) AS distance FROM c
""")
def stage_phase(spark, sf):
    """Change of performance in both tracks: its quadrant's name and its distance from the origin."""

    def change(track):
        late, early = (F.avg(F.when((F.col("track") == track) & side, F.col("perf"))) for side in (F.col("season") > 1996, F.col("season") <= 1996))
        return late - early

    rows = performed(spark, sf).groupBy("player_id").agg(change("regular").alias("x"), change("playoffs").alias("y"))
    return rows.select("player_id", scalar.phase(F.col("x"), F.col("y")).alias("phase"), F.round(F.hypot("x", "y"), 6).alias("distance"))


@query(f"""
WITH {PERF_SQL},
p AS (SELECT player_id, arg_max(track, struct_pack(v := round(perf, 6), g := -game_id)) AS a, arg_max(track, struct_pack(v := round(points, 6), g := -game_id)) AS b FROM perf GROUP BY player_id)
SELECT player_id, a || '_to_' || b AS switch, CAST(CASE WHEN a = 'regular' AND b = 'playoffs' THEN 1 WHEN a = 'playoffs' AND b = 'regular' THEN -1 ELSE 0 END AS BIGINT) AS signal FROM p
""")
def source_switch(spark, sf):
    """The tracks of a player's peaks by two measures."""
    peak = lambda c: F.max_by("track", F.struct(F.round(c, 6), -F.col("game_id")))
    rows = performed(spark, sf).groupBy("player_id").agg(peak("perf").alias("a"), peak("points").alias("b"))
    label, signal = scalar.source_switch(F.col("a"), F.col("b"))
    return rows.select("player_id", label.alias("switch"), signal.cast("long").alias("signal"))


@query(f"""
WITH {CLEAN_SQL},
s AS (SELECT game_id, player_id, home, CAST(floor(CASE WHEN home THEN team_score ELSE other_score END) AS BIGINT) AS hs, CAST(floor(CASE WHEN home THEN other_score ELSE team_score END) AS BIGINT) AS vs FROM clean)
SELECT game_id, player_id, CASE WHEN home THEN 'O' ELSE 'F' END AS opponent,
  CASE WHEN (home AND hs > vs) OR (NOT home AND vs > hs) THEN 'W ' || hs || '-' || vs WHEN home THEN 'L ' || hs || '-' || vs ELSE 'L ' || vs || '-' || hs END AS result FROM s
""")
def game_context(spark, sf):
    """Opponent and result as text; a guest's loss names the guest's score first."""
    home = F.col("home")
    whole = lambda own, other: scalar.whole_score(F.when(home, F.col(own)).otherwise(F.col(other)))
    home_score, guest_score = whole("team_score", "other_score"), whole("other_score", "team_score")
    return arena.clean(spark, sf).select("game_id", "player_id", F.when(home, "O").otherwise("F").alias("opponent"), scalar.result_text(home, home_score, guest_score).alias("result"))


@query("SELECT CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS quarter, count(*) AS n FROM lineitem GROUP BY 1")
def half_even(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.bround(F.col("l_quantity") / 4, 0).cast("long").alias("quarter")).agg(F.count("*").alias("n"))


@query(f"""
WITH {CLEAN_SQL}, m AS (SELECT player_id, CAST(floor(max(minutes)) AS BIGINT) AS most FROM clean GROUP BY player_id)
SELECT 'player ' || player_id AS name, CAST(most AS DOUBLE) AS value FROM m
""")
def peak_cells(spark, sf):
    """Cells like 'player 7 (41)' taken apart again."""
    rows = arena.clean(spark, sf).groupBy("player_id").agg(F.floor(F.max("minutes")).cast("double").alias("most"))
    cell = F.concat(F.lit("player "), F.col("player_id").cast("string"), F.lit(" ("), scalar.general_number(F.col("most")), F.lit(")"))
    name, value = scalar.named_value(F.col("cell"))
    return rows.select(cell.alias("cell")).select(name.alias("name"), value.alias("value"))


_SEASON = "CAST(CASE WHEN year(ts) = 2020 AND month(ts) BETWEEN 7 AND 9 THEN 2019 WHEN month(ts) < 7 THEN year(ts) - 1 ELSE year(ts) END AS BIGINT)"


@query(f"""
WITH f AS (SELECT {_SEASON} AS season, CAST(ts AS DATE) AS day FROM events GROUP BY ALL),
s AS (SELECT *, CASE WHEN day = max(day) OVER (PARTITION BY season) THEN 3e0 ELSE 1e0 END + 0.5e0 AS seconds FROM f)
SELECT season, day, sum(seconds) OVER (ORDER BY season, day) - seconds AS start_seconds, sum(seconds) OVER (ORDER BY season, day) AS end_seconds FROM s
""")
def frame_clock(spark, sf):
    """Start and end of each frame; seasons run side by side and are shifted by the sums of those before."""
    rows = read(spark, sf, "events").select(scalar.season_start(F.col("ts")).alias("season"), F.to_date("ts").alias("day")).distinct()
    w = Window.partitionBy("season")
    rows = rows.withColumn("seconds", F.when(F.col("day") == F.max("day").over(w), 3.0).otherwise(1.0) + 0.5)
    within = rows.withColumn("upto", F.sum("seconds").over(w.orderBy("day")))
    sums = rows.groupBy("season").agg(F.sum("seconds").alias("all"))  # a row for each season
    shift = sums.withColumn("shift", F.sum("all").over(Window.orderBy("season")) - F.col("all")).drop("all")
    end = F.col("upto") + F.col("shift")
    return within.join(shift, "season").select("season", "day", (end - F.col("seconds")).alias("start_seconds"), end.alias("end_seconds"))


_BORN = "DATE '1955-01-01' + CAST(player_id % 9000 AS INTEGER)"


@query(f"""
WITH {CLEAN_SQL}
SELECT CASE WHEN season < 1980 THEN '1970s' WHEN season < 1990 THEN '1980s' WHEN season < 2000 THEN '1990s' WHEN season < 2010 THEN '2000s' WHEN season < 2020 THEN '2010s' ELSE '2020s' END AS period,
  count(*) AS n, round(avg(date_diff('day', {_BORN}, CAST(game_date AS DATE)) / 365.2425e0), 4) AS mean_age FROM clean GROUP BY 1
""")
def ages_by_period(spark, sf):
    born = F.date_add(F.make_date(F.lit(1955), F.lit(1), F.lit(1)), (F.col("player_id") % 9000).cast("int"))
    rows = arena.clean(spark, sf).select(scalar.period_label(F.col("season")).alias("period"), scalar.age_years(F.to_date("game_date"), born).alias("age"))
    return rows.groupBy("period").agg(F.count("*").alias("n"), F.round(F.avg("age"), 4).alias("mean_age"))


@query("SELECT trim(coalesce(lang, '') || ' ' || coalesce(source, '')) AS full_name, count(*) AS n FROM documents GROUP BY 1")
def full_names(spark, sf):
    return read(spark, sf, "documents").groupBy(scalar.full_name(F.col("lang"), F.col("source")).alias("full_name")).agg(F.count("*").alias("n"))


@query(f"""
WITH {GAMES_SQL}, t AS (SELECT year(game_date) AS raw, CASE WHEN track = 'playoffs' THEN 'Playoffs' ELSE 'Regular Season' END AS kind, game_date FROM games)
SELECT CAST(CASE WHEN kind = 'Playoffs' AND raw = year(game_date) THEN raw - 1 ELSE raw END AS BIGINT) AS season, kind, count(*) AS n FROM t GROUP BY ALL
""")
def normalised_seasons(spark, sf):
    kind = F.when(F.col("track") == "playoffs", "Playoffs").otherwise("Regular Season")
    rows = arena.games(spark, sf).select(F.year("game_date").cast("long").alias("raw"), kind.alias("kind"), "game_date")
    return rows.groupBy(scalar.normalised_season(F.col("raw"), F.col("kind"), F.col("game_date")).alias("season"), "kind").agg(F.count("*").alias("n"))


@query(f"WITH {PERF_SQL}, c AS (SELECT game_id, share * perf - avg(share * perf) OVER (PARTITION BY game_id) AS d FROM perf) SELECT game_id, count(*) AS n, round(max(d), 6) + 0e0 AS top, round(sum(d), 6) + 0e0 AS total FROM c GROUP BY game_id")
def zero_sum_steps(spark, sf):
    """Steps of a game recentred so that they sum to zero."""
    rows = performed(spark, sf).select("game_id", recentred(F.col("share") * F.col("perf"), ["game_id"]).alias("d"))
    return rows.groupBy("game_id").agg(F.count("*").alias("n"), (F.round(F.max("d"), 6) + F.lit(0.0)).alias("top"), (F.round(F.sum("d"), 6) + F.lit(0.0)).alias("total"))
