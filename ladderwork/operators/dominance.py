"""Places of rows at a time of their own, by counting dominated points in two dimensions.

A state that holds from one time until another is +1 at its start and -1 at
its end.  How many states hold at t with a rating above r is then the sum over
points with time <= t and rating > r.  Points are cut into ranges of rating of
bounded size: ranges that lie wholly above are summed as cells (range x time)
by running sums, and only points of a row's own range are compared with it.
No state meets another group's, and no row meets all states of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.sources.warehouse import written


@dataclass(frozen=True)
class DominanceParams:
    #: points of a range of ratings, on average
    range_points: int = 4096
    #: ratings of a group and player that a task sorts, on average
    task_rows: int = 500_000
    #: rows compared with their range at once
    rows: int = 256


def _compared(points: pd.DataFrame, p: DominanceParams) -> pd.DataFrame:
    """near: for each asked row, the sum over its range's points that lie above it and not after it."""
    rating, who, t, sign = (points[c].to_numpy() for c in ("rating", "who", "t", "sign"))
    asked, near = np.flatnonzero(points["asked"].to_numpy()), []
    for k in range(0, len(asked), p.rows):
        at = asked[k : k + p.rows, None]
        above = (rating > rating[at]) | ((rating == rating[at]) & (who < who[at]))
        near.append((above & (t <= t[at])) @ sign)
    out = points.iloc[asked][["grp", "part", "who", "t"]].copy()
    out["near"] = np.concatenate(near) if near else np.zeros(0, dtype=np.int64)
    return out


def places(states: DataFrame, p: DominanceParams = DominanceParams()) -> DataFrame:
    """grp, who, t, active (states that hold at t) and place of the asked rows of states.

    states: grp, who, rating (not null), t and until (dates; until null: for
    good) and asked.  A place is 1 plus the states of the group that hold at t
    with a greater rating, or an equal one and a lesser who.  States of one
    (grp, who) do not overlap; those with one rating share a range.  Null
    groups are left out.
    """
    spark = states.sparkSession
    rows = states.where("grp is not null").select(
        "grp", "who", F.col("rating").cast("double").alias("rating"), F.explode(
            F.array(
                F.struct(F.unix_date("t").alias("t"), F.lit(1).cast("long").alias("sign"), "asked"),
                F.struct(F.unix_date("until").alias("t"), F.lit(-1).cast("long").alias("sign"), F.lit(False).alias("asked")),
            )
        ).alias("point"),
    )
    states_of = rows.where("point.t is not null").groupBy("grp", "rating", "who").agg(F.collect_list("point").alias("points"))
    # tasks follow the rows by far fewer than ranges do; a task cuts its sorted rows into ranges
    rows = written(states_of, "states")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // p.task_rows))
    order = ("grp", F.desc("rating"), "who")
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33) * F.lit(1 << 33) + F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) * 2 / p.range_points)
    points = written(dealt.select("grp", part.alias("part"), "who", "rating", F.explode("points").alias("p")).select("grp", "part", "who", "rating", "p.*"), "ranged-points")

    cells = points.groupBy("grp", "part", "t").agg(F.sum("sign").alias("s"))
    days = points.where("asked").select("grp", "t").distinct()
    times = cells.groupBy("grp", "t").agg(F.sum("s").alias("s"))
    active = times.select("grp", "t", F.sum("s").over(Window.partitionBy("grp").orderBy("t")).alias("active")).join(days, ["grp", "t"])
    # each range's sum at each asked time: a row of the spine comes after the cells of its time
    spine = points.select("grp", "part").distinct().join(days, "grp")
    both = cells.select("grp", "part", "t", "s", F.lit(0).alias("spine")).unionByName(spine.select("grp", "part", "t", F.lit(0).cast("long").alias("s"), F.lit(1).alias("spine")))
    running = F.sum("s").over(Window.partitionBy("grp", "part").orderBy("t", "spine").rowsBetween(Window.unboundedPreceding, 0))
    sums = both.withColumn("sum", running).where("spine = 1")
    whole = F.sum("sum").over(Window.partitionBy("grp", "t").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    whole = sums.select("grp", "part", "t", F.coalesce(whole, F.lit(0)).alias("whole"))

    kind = dict(points.dtypes)
    near = points.groupBy("grp", "part").applyInPandas(lambda g: _compared(g, p), f"grp {kind['grp']}, part long, who {kind['who']}, t int, near long")
    out = near.join(whole, ["grp", "part", "t"]).join(active, ["grp", "t"])
    return out.select("grp", "who", F.date_from_unix_date("t").alias("t"), "active", (F.col("near") + F.col("whole") + 1).alias("place"))
