"""Paths of ratings on one axis, and paths side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resampled(points: DataFrame, step: float) -> DataFrame:
    """player_id, slot and value: each path at the multiples of `step` between its first and last point.

    points: player_id, x, value; of points with one x the greatest `at` counts
    (x, at, value).  Between two points the value is interpolated, so every
    grid point comes from the one segment that holds it.
    """
    last = points.groupBy("player_id", "x").agg(F.max_by("value", "at").alias("value"))
    w = Window.partitionBy("player_id").orderBy("x")
    seg = last.select("player_id", "x", "value", F.lead("x").over(w).alias("x2"), F.lead("value").over(w).alias("value2"))
    # a segment holds its own start, its end belongs to the next; the last point stands alone
    first_slot = F.ceil(F.col("x") / step)
    last_slot = F.when(F.col("x2").isNull(), F.floor(F.col("x") / step)).otherwise(F.ceil(F.col("x2") / step) - 1)
    held = seg.withColumn("from_slot", first_slot).withColumn("to_slot", last_slot).where("from_slot <= to_slot")
    slots = held.withColumn("slot", F.explode(F.sequence("from_slot", "to_slot")))
    part = (F.col("slot") * step - F.col("x")) / (F.col("x2") - F.col("x"))
    value = F.when(F.col("x2").isNull(), F.col("value")).otherwise(F.col("value") + (F.col("value2") - F.col("value")) * part)
    return slots.select("player_id", "slot", value.alias("value"))


def compared(paths: DataFrame) -> DataFrame:
    """Two paths side by side for every pair of them: common slots, gap, share ahead, changes of the lead.

    paths: player_id, slot, value; of chosen players, few.  The lead counts
    as changed where the sign of the gap differs from the slot before.
    """
    a = paths.select(F.col("player_id").alias("a"), "slot", F.col("value").alias("va"))
    b = paths.select(F.col("player_id").alias("b"), "slot", F.col("value").alias("vb"))
    both = a.join(b, "slot").where("a < b").withColumn("gap", F.col("va") - F.col("vb"))
    before = F.lag(F.signum("gap")).over(Window.partitionBy("a", "b").orderBy("slot"))
    both = both.withColumn("turn", F.coalesce(before != F.signum("gap"), F.lit(False)))
    return both.groupBy("a", "b").agg(
        F.count("*").alias("slots"), F.avg("gap").alias("mean_gap"), F.avg(F.when(F.col("gap") > 0, 1.0).otherwise(0.0)).alias("share_ahead"),
        F.max_by("slot", F.struct(F.abs("gap"), -F.col("slot"))).alias("widest_slot"), F.max(F.abs("gap")).alias("widest"), F.count_if("turn").alias("turns"),
    )
