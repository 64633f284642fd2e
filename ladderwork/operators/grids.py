"""Counts over grids of thresholds: how many rows reach every threshold of every axis.

A row counts once, in the cell of the highest thresholds that it reaches; the
corners (at least this, and at least that) are running sums over the cells,
one axis after the other.  Rows are never laid out by threshold, and the grid
has as many cells as the thresholds' numbers multiply to.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _reached(value: Column, thresholds: Sequence[float]) -> Column:
    """Place of the highest threshold that is not above the value; null below the first or for null."""
    out = F.lit(None).cast("int")
    for k, t in enumerate(sorted(thresholds)):
        out = F.when(value >= t, k).otherwise(out)
    return out


def corners(df: DataFrame, keys: Sequence[str], axes: Mapping[str, Sequence[float]], sums: Mapping[str, Column]) -> DataFrame:
    """keys, a threshold column for each axis (same name) and the sums over rows that reach all of them.

    Corners that nothing reaches are 0 for keys that appear.  Rows under an
    axis's first threshold, or null there, count nowhere.
    """
    spark = df.sparkSession
    cells = df.select(*keys, *[_reached(F.col(a), t).alias(a) for a, t in axes.items()], *[c.alias(n) for n, c in sums.items()])
    inside = F.lit(True)
    for a in axes:
        inside &= F.col(a).isNotNull()
    cells = cells.where(inside).groupBy(*keys, *axes).agg(*[F.sum(n).alias(n) for n in sums])
    grid = spark.range(1).select(*[F.explode(F.array(*map(F.lit, range(len(axes[a]))))).alias(a) for a in list(axes)[:1]])
    for a in list(axes)[1:]:
        grid = grid.withColumn(a, F.explode(F.array(*map(F.lit, range(len(axes[a]))))))
    present = cells.select(*keys).distinct() if keys else None
    spine = present.join(F.broadcast(grid)) if keys else grid  # the grid is a list of parameters
    kinds = dict(cells.dtypes)
    zeros = spine.select(*keys, *axes, *[F.lit(0).cast(kinds[n]).alias(n) for n in sums])
    full = zeros.unionByName(cells).groupBy(*keys, *axes).agg(*[F.sum(n).alias(n) for n in sums])
    for a in axes:
        others = [x for x in axes if x != a]
        w = Window.partitionBy(*keys, *others).orderBy(F.desc(a)).rowsBetween(Window.unboundedPreceding, 0)
        full = full.select(*keys, *axes, *[F.sum(n).over(w).alias(n) for n in sums])
    shown = [F.element_at(F.array(*[F.lit(t) for t in sorted(ts)]), F.col(a) + 1).alias(a) for a, ts in axes.items()]
    return full.select(*keys, *shown, *sums)
