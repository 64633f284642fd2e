"""Window and sequence building blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key: one aggregation with a map-side combine, no sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return picked.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, name: str = "nth") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place.cast("long")).where(F.col(name) <= n)


def zscore(value: Column, keys: Sequence[str], floor: float = 1.0) -> Column:
    """Distance from the group's mean in population deviations of at least `floor`."""
    w = Window.partitionBy(*keys)
    return (value - F.avg(value).over(w)) / F.greatest(F.stddev_pop(value).over(w), F.lit(floor))


def recentred(value: Column, keys: Sequence[str]) -> Column:
    return value - F.avg(value).over(Window.partitionBy(*keys))


def average_rank(value: Column, keys: Sequence[str] = ()) -> Column:
    """Rank with ties at their mean place."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2.0


def centred_mean(value: Column, keys: Sequence[str], order: Sequence[str], each_side: int, least: int = 1) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-each_side, each_side)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows between rows where `starts` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def gap_sessions(df: DataFrame, keys: Sequence[str], time: str, gap: str, tie: str) -> DataFrame:
    """Sessions that a gap longer than `gap` (an interval) splits."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    before = F.lag(time).over(w)
    return islands(df.withColumn("before", before), keys, [time, tie], F.col("before").isNull() | (F.col(time) > F.col("before") + F.expr(f"INTERVAL {gap}")), "session").drop("before")


def running_max_before(df: DataFrame, value: str, bucket: str, order: Sequence[str]) -> DataFrame:
    """Global maximum over all earlier rows, in two levels.

    Maxima per bucket (for example a date) are few and get the global running
    maximum; inside a bucket the window is partitioned.  No window over all
    rows sits in one task.
    """
    tops = df.groupBy(bucket).agg(F.max(value).alias("top"))
    w = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    earlier = tops.select(bucket, F.max("top").over(w).alias("earlier"))
    inside = F.max(value).over(Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    joined = df.withColumn("inside", inside).join(earlier, bucket)
    return joined.withColumn("max_before", F.greatest("inside", "earlier")).drop("inside", "earlier")


def global_rank(df: DataFrame, value: str, name: str, width: float) -> DataFrame:
    """Rank of all rows by descending value, equal values alike, without a window over all rows.

    Values are cut into ranges of `width`; the few ranges' sizes shift the
    ranks that are taken inside each range.
    """
    ranged = df.withColumn("_range", F.floor(F.col(value) / width))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    above = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.rank().over(Window.partitionBy("_range").orderBy(F.desc(value)))
    return ranged.join(sizes.select("_range", above.alias("_above")), "_range").withColumn(name, (inside + F.col("_above")).cast("long")).drop("_range", "_above")
