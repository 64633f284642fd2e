"""Live leaderboards, stints and records over timestamped ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.sources.warehouse import maybe_broadcast, written


def spans(log: DataFrame, scope: list[str], extra: list[str]) -> DataFrame:
    """How long each player's last rating of a day holds: until the player's next day in the scope, or the scope's last.

    from_day and to_day are day numbers; shown is the rating that places go by.
    """
    last = log.groupBy(*scope, "player_id", F.unix_date("day").alias("from_day")).agg(F.max_by(F.struct("rating", *extra), "at").alias("s"))
    until = F.lead("from_day").over(Window.partitionBy(*scope, "player_id").orderBy("from_day"))
    ends = log.groupBy(*scope).agg(F.max(F.unix_date("day")).alias("end"))
    rows = last.withColumn("until", until)
    rows = rows.join(maybe_broadcast(ends), scope) if scope else rows.join(F.broadcast(ends))  # one row
    return rows.select(*scope, "player_id", "from_day", F.coalesce(F.col("until") - 1, "end").alias("to_day"), "s.*", F.round("s.rating", 6).alias("shown"))


def contenders(rows: DataFrame, days: DataFrame, k: int, width: int, scope: list[str]) -> DataFrame:
    """The parts of spans that may be among the k best of a day, cut at blocks of `width` days.

    The k-th best of the least ratings of players seen through a whole block
    is a bound from below of every day's k-th place in it; parts under it go.
    days: scope and day (a number), the days that are asked for.
    """
    at = [*scope, "block"]
    blocks = F.sequence(F.floor(F.col("from_day") / width), F.floor(F.col("to_day") / width))
    parts = rows.withColumn("block", F.explode(blocks))
    start = F.col("block") * width
    parts = parts.withColumn("from_day", F.greatest("from_day", start).cast("int")).withColumn("to_day", F.least("to_day", start + width - 1).cast("int"))
    edges = days.groupBy(*scope, F.floor(F.col("day") / width).alias("block")).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    edges = maybe_broadcast(edges)
    least = parts.groupBy(*at, "player_id").agg(F.min("shown").alias("least"), F.min("from_day").alias("from_day"), F.max("to_day").alias("to_day"))
    through = least.join(edges, at).where("from_day <= first_day and to_day >= last_day")
    place = F.row_number().over(Window.partitionBy(*at).orderBy(F.desc("least")))  # tasks keep k rows a block before it
    bounds = through.withColumn("place", place).where(F.col("place") <= k).groupBy(*at).agg(F.min("least").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k)
    kept = parts.join(maybe_broadcast(bounds.drop("n")), at, "left").where("bound is null or shown >= bound")
    return kept.drop("block", "bound")


def daily_board(log: DataFrame, k: int, width: int = 32, scope: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Top k players of every date on which something happened.

    log: day, player_id, at (order inside the day), rating, the scope (columns
    inside which a player has to be seen first) and extra columns to carry.  A
    player's last rating holds until the next one.  Only spans that may reach
    the board in their block of days are laid out by day.
    """
    scope, extra = scope or [], extra or []
    days = written(log.select(*scope, F.unix_date("day").alias("day")).distinct(), "board-days")
    rows = contenders(spans(log, scope, extra), days, k, width, scope)
    spread = rows.withColumn("day", F.explode(F.sequence("from_day", "to_day"))).join(maybe_broadcast(days), [*scope, "day"])
    place = F.row_number().over(Window.partitionBy(*scope, "day").orderBy(F.desc("shown"), "player_id"))
    best = spread.withColumn("place", place.cast("long")).where(F.col("place") <= k)
    return best.select(*scope, F.date_from_unix_date("day").alias("board_day"), "place", "player_id", "rating", *extra)


def stints(board: DataFrame, keep_gaps: bool) -> DataFrame:
    """Runs of consecutive board dates of each player on the board.

    keep_gaps: False breaks a run when the player misses a board date.
    A stint lasts until the next board date; the last date counts 0 days.
    """
    spine = board.select("board_day").distinct()
    order = Window.orderBy("board_day")
    spine = F.broadcast(spine.select("board_day", F.lag("board_day").over(order).alias("before_day"), F.lead("board_day").over(order).alias("next_day")))
    rows = board.join(spine, "board_day")
    w = Window.partitionBy("player_id").orderBy("board_day")
    previous = F.lag("board_day").over(w)
    new = previous.isNull() if keep_gaps else previous.isNull() | (previous < F.col("before_day"))
    marked = rows.withColumn("new", new.cast("int"))
    marked = marked.withColumn("stint", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = F.datediff(F.coalesce("next_day", "board_day"), "board_day")
    return marked.groupBy("player_id", "stint").agg(
        F.min("board_day").alias("first_day"), F.max("board_day").alias("last_day"), F.count("*").alias("dates"), F.sum(days).alias("days")
    )


def greedy_frames(days: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Dates at least `step` days apart, chosen from the first on, with the last always in.

    The dates of a key (a season's, so bounded) are folded in order by an
    array function.
    """
    empty = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<date>").alias("kept"))

    def add(state, day):
        take = state["last"].isNull() | (F.datediff(day, state["last"]) >= step)
        return F.struct(F.when(take, day).otherwise(state["last"]).alias("last"), F.when(take, F.concat(state["kept"], F.array(day))).otherwise(state["kept"]).alias("kept"))

    folded = days.groupBy(*keys).agg(F.sort_array(F.collect_set("day")).alias("all"))
    kept = F.aggregate("all", empty, add, lambda s: s["kept"])
    return folded.select(*keys, F.explode(F.array_union(kept, F.array(F.element_at("all", -1)))).alias("day"))
