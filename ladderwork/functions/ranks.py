"""Row numbers, running sums and ranks in groups of any size.

Rows are dealt by range of (keys, order), so a large group lies in several
consecutive partitions.  Each partition counts or adds up its own rows, and
what its predecessors hold of a group is added afterwards; that table has a
row for each partition and group in it.  No window holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.sources.warehouse import maybe_broadcast, written


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """df in ranges of (keys, order), with part_ and at_ (consecutive numbers inside a part, in order)."""
    by = [*map(F.asc, keys), *[F.asc(c) if isinstance(c, str) else c for c in order]]
    rows = df.withColumn("tie_", F.monotonically_increasing_id())  # equal rows need not share a part
    by.append(F.asc("tie_"))
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie_")
    return written(rows.withColumn("at_", F.monotonically_increasing_id()), "dealt").withColumn("part_", F.shiftright("at_", 33))


def _with_starts(rows: DataFrame, keys: Sequence[str], amounts: dict[str, Column]) -> DataFrame:
    """rows with, for each amount, what earlier parts hold of the row's group, and the group's first at_ in the part."""
    sums = rows.groupBy(*keys, "part_").agg(F.min("at_").alias("first_"), *[F.sum(a).alias(n) for n, a in amounts.items()])
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"{k}_of_") for k in keys], F.col("part_").alias("of_"), "first_", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in amounts]
    )
    same = F.col("part_") == F.col("of_")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_of_"))
    return rows.join(maybe_broadcast(written(starts, "starts")), same).drop("of_", *[f"{k}_of_" for k in keys])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Row number (from 1) among the rows of the keys; equal rows get numbers of their own."""
    rows = _with_starts(_dealt(df, keys, order), keys, {"before_": F.lit(1)})
    return rows.withColumn(name, F.col("at_") - F.col("first_") + F.col("before_") + 1).drop("at_", "part_", "first_", "before_")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column | str]) -> DataFrame:
    """Running sums of amounts among the rows of the keys, each row included; rows of one place in the order come one after another."""
    rows = _dealt(df, keys, order)
    amounts = {f"{n}_before_": F.col(a) if isinstance(a, str) else a for n, a in sums.items()}
    rows = _with_starts(rows, keys, amounts)
    w = Window.partitionBy("part_", *keys).orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)
    for n in sums:
        rows = rows.withColumn(n, F.sum(amounts[f"{n}_before_"]).over(w) + F.col(f"{n}_before_"))
    return rows.drop("at_", "part_", "first_", *amounts)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the rank of value among the rows of the keys, ties at their mean place; value is not null."""
    df = written(df, "ranked")  # values are matched exactly, and a second run of df may sum in another order
    counts = df.groupBy(*keys, value).agg(F.count("*").cast("double").alias("ties_"))
    ranked = running_sums(counts, keys, [value], {"upto_": "ties_"})
    ranked = ranked.select(*[F.col(k).alias(f"{k}_of_") for k in [*keys, value]], (F.col("upto_") - (F.col("ties_") - 1) / 2).alias(name))
    same = F.lit(True)
    for k in [*keys, value]:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_of_"))
    return df.join(ranked, same).drop(*[f"{k}_of_" for k in [*keys, value]])


def dense_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, descending: bool = True) -> DataFrame:
    """df with the place of value among the distinct values of the keys; value is not null."""
    df = written(df, "ranked")  # as above
    places = numbered(df.select(*keys, value).distinct(), keys, [F.desc(value) if descending else F.asc(value)], name)
    places = places.select(*[F.col(k).alias(f"{k}_of_") for k in [*keys, value]], name)
    same = F.lit(True)
    for k in [*keys, value]:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_of_"))
    return df.join(places, same).drop(*[f"{k}_of_" for k in [*keys, value]])
