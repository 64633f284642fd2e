"""Leaderboards, stints, records and sessions over the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ladderwork.functions.scalar import season_start
from ladderwork.functions.windows import gap_sessions, running_max_before
from ladderwork.operators import leaderboard
from ladderwork.plans.registry import query
from ladderwork.sources.arena import read
from ladderwork.sources.sinks import nested_frames
from ladderwork.sources.warehouse import written

LOG_SQL = """
log AS (
  SELECT CAST(ts AS DATE) AS day, ts, event_id, user_id AS player_id,
    1500 + sum(value - 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 10e0 AS rating FROM events)"""

BOARD_SQL = f"""{LOG_SQL},
last AS (SELECT player_id, day, arg_max(rating, struct_pack(t := ts, e := event_id)) AS rating FROM log GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY player_id ORDER BY day) AS until FROM last),
board AS (
  SELECT d.day AS board_day, row_number() OVER (PARTITION BY d.day ORDER BY round(rating, 6) DESC, player_id) AS place, player_id, rating
  FROM (SELECT DISTINCT day FROM log) d JOIN spans s ON d.day >= s.day AND (s.until IS NULL OR d.day < s.until)),
top10 AS (SELECT * FROM board WHERE place <= 10),
spine AS (SELECT board_day, lag(board_day) OVER (ORDER BY board_day) AS before_day, lead(board_day) OVER (ORDER BY board_day) AS next_day FROM (SELECT DISTINCT board_day FROM top10))"""


def log(spark, sf):
    running = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf, "events").select(
        F.to_date("ts").alias("day"), "ts", "event_id", F.col("user_id").alias("player_id"), F.struct("ts", "event_id").alias("at"),
        (F.lit(1500.0) + F.sum(F.col("value") - 50).over(running) / 10.0).alias("rating"),
    )


def board(spark, sf, k=10):
    return leaderboard.daily_board(log(spark, sf), k)


@query(f"WITH {BOARD_SQL} SELECT board_day, place, player_id, round(rating, 4) AS rating FROM top10")
def daily_top10(spark, sf):
    return board(spark, sf).withColumn("rating", F.round("rating", 4))


@query(f"""
WITH {BOARD_SQL}
SELECT t.board_day, t.player_id, t.place, b.place AS place_before, round(t.rating - b.rating, 4) + 0e0 AS change FROM top10 t JOIN spine s USING (board_day)
LEFT JOIN top10 b ON b.board_day = s.before_day AND b.player_id = t.player_id
""")
def frame_changes(spark, sf):
    """Place and rating on the previous board date, if the player was on it."""
    rows = board(spark, sf)
    spine = rows.select("board_day").distinct()
    spine = spine.select("board_day", F.lag("board_day").over(Window.orderBy("board_day")).alias("before_day"))
    w = Window.partitionBy("player_id").orderBy("board_day")
    there = F.lag("board_day").over(w) == F.col("before_day")
    out = rows.join(F.broadcast(spine), "board_day")
    return out.select(
        "board_day", "player_id", "place", F.when(there, F.lag("place").over(w)).alias("place_before"),
        (F.round(F.when(there, F.col("rating") - F.lag("rating").over(w)), 4) + F.lit(0.0)).alias("change"),
    )


_STINTS = """
marked AS (SELECT r.*, s.before_day, s.next_day, lag(board_day) OVER w AS previous FROM {rows} r JOIN spine s USING (board_day) WINDOW w AS (PARTITION BY player_id ORDER BY board_day)),
islands AS (SELECT *, sum(CASE WHEN previous IS NULL OR previous < before_day THEN 1 ELSE 0 END) OVER (PARTITION BY player_id ORDER BY board_day) AS stint FROM marked),
stints AS (SELECT player_id, CAST(stint AS BIGINT) AS stint, min(board_day) AS first_day, max(board_day) AS last_day, count(*) AS dates,
  CAST(sum(datediff('day', board_day, coalesce(next_day, board_day))) AS BIGINT) AS days FROM islands GROUP BY player_id, stint)"""

TOP10_STINTS_SQL = f"WITH {BOARD_SQL},{_STINTS.format(rows='top10')}"
LEADER_STINTS_SQL = f"WITH {BOARD_SQL},{_STINTS.format(rows='(SELECT * FROM top10 WHERE place = 1)')}"


@query(TOP10_STINTS_SQL + " SELECT * FROM stints")
def top10_stints(spark, sf):
    return leaderboard.stints(board(spark, sf), keep_gaps=False)


@query(LEADER_STINTS_SQL + " SELECT * FROM stints")
def no1_stints(spark, sf):
    return leaderboard.stints(board(spark, sf, 1), keep_gaps=False)


_SUMMARY = " SELECT player_id, count(*) AS stints, CAST(sum(days) AS BIGINT) AS days, max(days) AS longest, min(first_day) AS first_day, row_number() OVER (ORDER BY min(first_day), player_id) AS nth FROM stints GROUP BY player_id"


def _summary(rows):
    out = rows.groupBy("player_id").agg(F.count("*").alias("stints"), F.sum("days").alias("days"), F.max("days").alias("longest"), F.min("first_day").alias("first_day"))
    return out.withColumn("nth", F.row_number().over(Window.orderBy("first_day", "player_id")).cast("long"))


@query(LEADER_STINTS_SQL + _SUMMARY)
def no1_summary(spark, sf):
    return _summary(no1_stints(spark, sf))


@query(TOP10_STINTS_SQL + _SUMMARY)
def top10_summary(spark, sf):
    return _summary(top10_stints(spark, sf))


@query(f"""
WITH {LOG_SQL},
r AS (SELECT *, max(rating) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log)
SELECT event_id, player_id, round(rating, 4) AS rating, round(before, 4) AS record_before FROM r WHERE before IS NULL OR rating > before
""")
def record_events(spark, sf):
    """All-time records as they fall: a two-level running maximum."""
    rows = running_max_before(log(spark, sf), "rating", "day", ["ts", "event_id"]).where("max_before is null or rating > max_before")
    return rows.select("event_id", "player_id", F.round("rating", 4).alias("rating"), F.round("max_before", 4).alias("record_before"))


@query(f"""
WITH {LOG_SQL},
r AS (SELECT *, max(rating) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log),
k AS (SELECT *, lag(player_id) OVER (ORDER BY ts, event_id) AS holder FROM r WHERE before IS NULL OR rating > before)
SELECT event_id, holder AS old_holder, player_id AS new_holder FROM k WHERE holder IS DISTINCT FROM player_id
""")
def leader_changes(spark, sf):
    """Records that pass to another player; records are few, so one window over them is small."""
    rows = running_max_before(log(spark, sf), "rating", "day", ["ts", "event_id"]).where("max_before is null or rating > max_before")
    holder = rows.withColumn("old_holder", F.lag("player_id").over(Window.orderBy("ts", "event_id")))
    return holder.where(~F.col("old_holder").eqNullSafe(F.col("player_id"))).select("event_id", "old_holder", F.col("player_id").alias("new_holder"))


@query("""
WITH RECURSIVE d AS (SELECT DISTINCT user_id % 10 AS grp, CAST(ts AS DATE) AS day FROM events),
pick AS (
  SELECT grp, min(day) AS day FROM d GROUP BY grp
  UNION ALL
  SELECT p.grp, (SELECT min(day) FROM d WHERE d.grp = p.grp AND d.day >= p.day + 7) FROM pick p WHERE EXISTS (SELECT 1 FROM d WHERE d.grp = p.grp AND d.day >= p.day + 7))
SELECT grp, day FROM pick UNION SELECT grp, max(day) FROM d GROUP BY grp
""")
def frame_sampling_7d(spark, sf):
    """Days at least a week apart for each of ten groups of users; frame_sampling_season has the seasons'."""
    days = read(spark, sf, "events").select((F.col("user_id") % 10).alias("grp"), F.to_date("ts").alias("day"))
    return leaderboard.greedy_frames(days, ["grp"], 7)


@query("""
WITH RECURSIVE d AS (
  SELECT DISTINCT CAST(CASE WHEN year(ts) = 2020 AND month(ts) BETWEEN 7 AND 9 THEN 2019 WHEN month(ts) < 7 THEN year(ts) - 1 ELSE year(ts) END AS BIGINT) AS season, CAST(ts AS DATE) AS day FROM events),
pick AS (
  SELECT season, min(day) AS day FROM d GROUP BY season
  UNION ALL
  SELECT p.season, (SELECT min(day) FROM d WHERE d.season = p.season AND d.day >= p.day + 7) FROM pick p WHERE EXISTS (SELECT 1 FROM d WHERE d.season = p.season AND d.day >= p.day + 7))
SELECT season, day FROM pick UNION SELECT season, max(day) FROM d GROUP BY season
""")
def frame_sampling_season(spark, sf):
    """Days of a season at least a week apart, from all events; the season's last day is always in."""
    days = read(spark, sf, "events").select(season_start(F.col("ts")).alias("season"), F.to_date("ts").alias("day"))
    return leaderboard.greedy_frames(days, ["season"], 7)


SEASON_BOARD_SQL = f"""{LOG_SQL},
slog AS (
  SELECT *, CAST(CASE WHEN year(ts) = 2020 AND month(ts) BETWEEN 7 AND 9 THEN 2019 WHEN month(ts) < 7 THEN year(ts) - 1 ELSE year(ts) END AS BIGINT) AS season FROM log),
counted AS (SELECT *, count(*) OVER (PARTITION BY season, player_id ORDER BY ts, event_id) AS games FROM slog),
slast AS (SELECT season, player_id, day, arg_max(rating, struct_pack(t := ts, e := event_id)) AS rating, max(games) AS games FROM counted GROUP BY ALL),
sspans AS (SELECT *, lead(day) OVER (PARTITION BY season, player_id ORDER BY day) AS until FROM slast),
sboard AS (
  SELECT season, d.day AS board_day, row_number() OVER (PARTITION BY season, d.day ORDER BY round(rating, 6) DESC, player_id) AS place, player_id, rating, games
  FROM (SELECT DISTINCT season, day FROM slog) d JOIN sspans s USING (season) WHERE d.day >= s.day AND (s.until IS NULL OR d.day < s.until)),
stop AS (SELECT * FROM sboard WHERE place <= 10)"""


def season_log(spark, sf):
    """The log with its season and the player's games in it so far."""
    rows = log(spark, sf).withColumn("season", season_start(F.col("ts")))
    return rows.withColumn("games", F.count("*").over(Window.partitionBy("season", "player_id").orderBy("ts", "event_id")))


def live_board(spark, sf, k=10):
    return leaderboard.daily_board(season_log(spark, sf), k, scope=["season"], extra=["games"])


@query(f"WITH {SEASON_BOARD_SQL} SELECT season, board_day, place, player_id, round(rating, 4) AS rating, games FROM stop")
def season_board(spark, sf):
    """The ten best of the players seen in the season so far, on every date, with their games in it."""
    return live_board(spark, sf).withColumn("rating", F.round("rating", 4))


#: Seconds that a frame of the animation stands and moves.
HOLD, MOVE = 1.2, 0.8

_FRAMES_SQL = f"""WITH RECURSIVE {SEASON_BOARD_SQL},
d AS (SELECT DISTINCT season, board_day AS day FROM stop),
pick AS (
  SELECT season, min(day) AS day FROM d GROUP BY season
  UNION ALL
  SELECT p.season, (SELECT min(day) FROM d WHERE d.season = p.season AND d.day >= p.day + 7) FROM pick p WHERE EXISTS (SELECT 1 FROM d WHERE d.season = p.season AND d.day >= p.day + 7)),
chosen AS (SELECT season, day FROM pick UNION SELECT season, max(day) FROM d GROUP BY season),
frames AS (
  SELECT row_number() OVER (ORDER BY day) - 1 AS frame_id, season, day,
    CASE WHEN day = min(day) OVER s AND day = max(day) OVER s THEN 'season_first_season_last' WHEN day = min(day) OVER s THEN 'season_first' WHEN day = max(day) OVER s THEN 'season_last' ELSE 'weekly' END AS role
  FROM chosen WINDOW s AS (PARTITION BY season))"""


def frames(board_days):
    """The frames' dates of each season, numbered, with their role and clock; one row a frame."""
    chosen = leaderboard.greedy_frames(board_days, ["season"], 7)
    season = Window.partitionBy("season")
    first, last = F.col("day") == F.min("day").over(season), F.col("day") == F.max("day").over(season)
    role = F.when(first & last, "season_first_season_last").when(first, "season_first").when(last, "season_last").otherwise("weekly")
    frame_id = F.row_number().over(Window.orderBy("day")).cast("long") - 1  # a frame a week: few
    rows = chosen.select("season", "day", role.alias("role"), frame_id.alias("frame_id"))
    return rows.withColumn("start_seconds", F.round(F.col("frame_id") * (HOLD + MOVE), 4)).withColumn("end_seconds", F.round((F.col("frame_id") + 1) * (HOLD + MOVE), 4))


@query(f"""{_FRAMES_SQL}
SELECT frame_id, day AS frame_date, season, season + 1 AS display_season, role, {HOLD}::DOUBLE AS hold_seconds, {MOVE}::DOUBLE AS transition_seconds,
  round(frame_id * {HOLD + MOVE}e0, 4) AS start_seconds, round((frame_id + 1) * {HOLD + MOVE}e0, 4) AS end_seconds FROM frames
""")
def board_meta(spark, sf):
    """What the animation knows of each frame: date, season, role and clock."""
    days = live_board(spark, sf, 1).select("season", F.col("board_day").alias("day"))
    return frames(days).select(
        "frame_id", F.col("day").alias("frame_date"), "season", (F.col("season") + 1).alias("display_season"), "role",
        F.lit(HOLD).alias("hold_seconds"), F.lit(MOVE).alias("transition_seconds"), "start_seconds", "end_seconds",
    )


@query(f"""{_FRAMES_SQL},
shown AS (SELECT f.frame_id, f.day, f.role, t.season, t.place, t.player_id, t.rating, t.games FROM frames f JOIN stop t ON t.season = f.season AND t.board_day = f.day)
SELECT a.frame_id, a.day AS frame_date, a.role, a.place, a.player_id, round(a.rating, 4) AS rating, a.games, b.place AS previous_place, b.place - a.place AS place_change, round(a.rating - b.rating, 4) + 0e0 AS rating_change
FROM shown a LEFT JOIN shown b ON b.frame_id = a.frame_id - 1 AND b.player_id = a.player_id
""")
def board_frames(spark, sf):
    """The board in every frame, with place and rating against the frame before."""
    rows = written(live_board(spark, sf), "live-board")
    chosen = frames(rows.select("season", F.col("board_day").alias("day")))
    shown = rows.join(F.broadcast(chosen.select("season", F.col("day").alias("board_day"), "role", "frame_id")), ["season", "board_day"])
    w = Window.partitionBy("player_id").orderBy("frame_id")
    there = F.lag("frame_id").over(w) == F.col("frame_id") - 1
    before = F.when(there, F.lag("place").over(w))
    return shown.select(
        "frame_id", F.col("board_day").alias("frame_date"), "role", "place", "player_id", F.round("rating", 4).alias("rating"), "games", before.alias("previous_place"),
        (before - F.col("place")).alias("place_change"), (F.round(F.when(there, F.col("rating") - F.lag("rating").over(w)), 4) + F.lit(0.0)).alias("rating_change"),
    )


@query(f"WITH {BOARD_SQL} SELECT board_day, count(*) AS entries, CAST(sum(place) AS BIGINT) AS places FROM top10 GROUP BY board_day")
def frame_json(spark, sf):
    """One nested JSON frame per date; read back and counted."""
    frames = nested_frames(board(spark, sf), "board_day", "place", ["player_id", "rating"])
    top = F.from_json("frame", "top array<struct<place: long, player_id: long, rating: double>>")["top"]
    return frames.select("board_day", F.size(top).cast("long").alias("entries"), F.aggregate(top["place"], F.lit(0).cast("long"), lambda a, b: a + b).alias("places"))


@query("""
WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session
""")
def sessions_by_gap(spark, sf):
    rows = gap_sessions(read(spark, sf, "events"), ["user_id"], "ts", "6 HOURS", "event_id")
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT user_id, date_trunc('month', ts)::DATE AS month, arg_max(value, struct_pack(t := ts, e := event_id)) AS last_value, count(*) AS events FROM events GROUP BY ALL")
def monthly_last(spark, sf):
    rows = read(spark, sf, "events").groupBy("user_id", F.to_date(F.trunc(F.to_date("ts"), "MM")).alias("month"))
    return rows.agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.count("*").alias("events"))
