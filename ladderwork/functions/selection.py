"""Exact quantiles of groups of any size by distributed selection.

Equal values of a group are summed into one row first.  A range of values that
holds a wanted rank is cut at approximate quantiles of what is in it; the
weights of the parts are summed exactly, and the part with the wanted rank is
the next range.  All groups and all points take a round together, and a range
is read once however many points lie in it.  Ranges of up to `small` distinct
values are sorted, so no task holds more of a group than that; a round makes
ranges about `splits` times smaller, whatever the values look like.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.sources.warehouse import maybe_broadcast, written


@dataclass(frozen=True)
class SelectionParams:
    #: distinct values that a task sorts
    small: int = 50_000
    #: parts that a range is cut into
    splits: int = 64


RANGE = ["group_", "lo", "hi"]


def _inside(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """values with the range of their group that holds them; a group's ranges do not overlap."""
    named = ranges.withColumnRenamed("group_", "of")
    above = F.col("lo").isNull() | (F.col("v") > F.col("lo"))
    within = (F.col("group_") == F.col("of")) & above & (F.col("hi").isNull() | (F.col("v") <= F.col("hi")))
    return values.join(maybe_broadcast(named), within).drop("of")


def _cut(values: DataFrame, ranges: DataFrame, p: SelectionParams) -> DataFrame:
    """The parts of each range: weight before, own weight, distinct values, bounds, first and last."""
    shares = [k / p.splits for k in range(1, p.splits)]
    marks = _inside(values, ranges).groupBy(*RANGE).agg(F.percentile_approx("v", F.array(*map(F.lit, shares)), F.lit(10 * p.splits)).alias("marks"))
    cut = _inside(values, written(marks, "marks")).withColumn("part", F.size(F.filter("marks", lambda x: x < F.col("v"))))
    sums = cut.groupBy(*RANGE, "part").agg(F.sum("w").alias("own"), F.count("*").alias("m_part"), F.max("v").alias("top"))
    w = Window.partitionBy(*RANGE).orderBy("part")
    before = F.coalesce(F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return sums.select(
        *[F.col(c).alias(f"{c}_") for c in RANGE], before.alias("before"), "own", "m_part", F.coalesce(F.lag("top").over(w), "lo").alias("from"), "top",
        F.lag("part").over(w).isNull().alias("first"), F.lead("part").over(w).isNull().alias("last"),
    )


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, targets: Mapping[str, Column], weight: str | None = None, p: SelectionParams = SelectionParams()) -> DataFrame:
    """keys, for each target the least value whose running weight reaches it, and total_, the group's weight.

    targets: expressions over `total`, the group's weight.  Without `weight`
    rows count 1 each.  Null values and rows without a weight above 0 are left
    out; groups of nothing else do not appear.  Null keys are a group.
    """
    group = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))
    rows = df.select(group.alias("group_"), F.col(value).cast("double").alias("v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    values = written(rows.where("v is not null and w > 0").groupBy("group_", "v").agg(F.sum("w").alias("w")), "values")
    totals = values.groupBy("group_").agg(F.sum("w").alias("total"), F.count("*").alias("m"))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), t.cast("double").alias("at"), "total") for n, t in targets.items()])).alias("t")
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    open_ = written(totals.select("group_", wanted, none.alias("lo"), none.alias("hi"), zero.alias("below"), "m").select("group_", "t.*", "lo", "hi", "below", "m"), "targets")
    while True:
        large = open_.where(F.col("m") > p.small)
        ranges = large.select(*RANGE).distinct()
        if ranges.isEmpty():
            break
        parts = written(_cut(values, ranges, p), "parts")
        same = (F.col("group_") == F.col("group__")) & F.col("lo").eqNullSafe(F.col("lo_")) & F.col("hi").eqNullSafe(F.col("hi_"))
        start = F.col("below") + F.col("before")
        here = (F.col("first") | (F.col("at") > start)) & (F.col("last") | (F.col("at") <= start + F.col("own")))
        moved = large.join(maybe_broadcast(parts), same & here).select(
            "group_", "name", "at", "total", F.col("from").alias("lo"), F.col("top").alias("hi"), start.alias("below"), F.col("m_part").alias("m")
        )
        open_ = written(open_.where(F.col("m") <= p.small).unionByName(moved), "targets")

    chosen = open_.groupBy(*RANGE, "below").agg(F.collect_list(F.struct("name", "at", "total")).alias("targets"))
    w = Window.partitionBy(*RANGE).orderBy("v")
    rows = _inside(values, chosen).withColumn("running", F.col("below") + F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.lag("running").over(w)).withColumn("last", F.lead("v").over(w).isNull())
    here = lambda t: (F.col("before").isNull() | (t["at"] > F.col("before"))) & (F.col("last") | (t["at"] <= F.col("running")))
    found = rows.select("group_", "v", F.explode(F.filter("targets", here)).alias("t"))
    out = found.groupBy("group_").agg(*[F.max(F.when(F.col("t.name") == n, F.col("v"))).alias(n) for n in targets], F.max("t.total").alias("total_"))
    return out.select(*[F.col(f"group_.k{i}").alias(k) for i, k in enumerate(keys)], *targets, "total_")


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, points: Mapping[str, float], p: SelectionParams = SelectionParams()) -> DataFrame:
    """Smallest value whose running weight reaches the share of the total; rows without a weight above 0 do not count."""
    return order_statistics(df, keys, value, {n: q * F.col("total") for n, q in points.items()}, weight, p).drop("total_")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float], p: SelectionParams = SelectionParams()) -> DataFrame:
    """Quantiles with linear interpolation between the two nearest ranks."""
    targets = {}
    for n, q in points.items():
        targets |= {f"{n}_low_": F.floor(q * (F.col("total") - 1)) + 1, f"{n}_high_": F.ceil(q * (F.col("total") - 1)) + 1}
    out = order_statistics(df, keys, value, targets, None, p)
    shown = []
    for n, q in points.items():
        place, low = q * (F.col("total_") - 1), F.col(f"{n}_low_")
        shown.append((low + (F.col(f"{n}_high_") - low) * (place - F.floor(place))).alias(n))
    return out.select(*keys, *shown)


def described(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float], p: SelectionParams = SelectionParams()) -> DataFrame:
    """count, mean, sample deviation, least and greatest value and quantiles of each group with a value."""
    v = F.col(value).cast("double")
    of = [F.col(k).alias(f"{k}_of_") for k in keys]
    moments = df.where(F.col(value).isNotNull()).groupBy(*of).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("greatest")
    )
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_of_"))
    found = quantiles(df, keys, value, points, p)
    return found.join(moments if keys else F.broadcast(moments), same).select(*keys, "n", "mean", "sd", "least", *points, "greatest")
