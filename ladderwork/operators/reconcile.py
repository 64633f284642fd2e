"""Reconciling two logs: digests that do not depend on order, compared as a tree.

A row's digest is two 64-bit hashes of its columns; a node's is the sum of its
rows', so that parents are sums of children and repeated rows count.  Both
logs are scanned once for the leaves (scope, bucket of keys).  The tree is
compared from the top; only children of nodes that differ are looked at, and
only rows of leaves that differ are read again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.sources.warehouse import maybe_broadcast, written


@dataclass(frozen=True)
class ReconcileParams:
    #: children of a node below the scope, and levels of them
    fan: int = 16
    levels: int = 3

    @property
    def leaves(self) -> int:
        return self.fan**self.levels


def _bucket(keys: Sequence[str], p: ReconcileParams) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(p.leaves)).cast("int")


def leaf_digests(log: DataFrame, scope: str, keys: Sequence[str], values: Sequence[str], p: ReconcileParams) -> DataFrame:
    """scope, bucket, rows and the two sums of digests."""
    columns = [scope, *keys, *values]
    whole = "decimal(38,0)"
    return log.groupBy(F.col(scope).alias("scope"), _bucket(keys, p).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast(whole)).alias("h1"), F.sum(F.xxhash64(F.lit("second"), *columns).cast(whole)).alias("h2")
    )


def differing(left: DataFrame, right: DataFrame, p: ReconcileParams) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Leaves (scope, bucket) that differ, and how many nodes each level compared and found different.

    left and right: leaf digests.
    """
    sums = [F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0)).alias(f"{c}_{s}") for c in ("n", "h1", "h2") for s in (0, 1)]
    both = written(left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))), "leaf-digests")
    open_, seen = None, []
    for level in range(p.levels + 1):
        width = p.fan ** (p.levels - level)
        nodes = both.withColumn("node", F.floor(F.col("bucket") / width))
        if open_ is not None:
            parents = open_.select(F.col("scope").alias("of_scope"), F.col("node").alias("of_node"))
            nodes = nodes.join(maybe_broadcast(parents), F.col("scope").eqNullSafe(F.col("of_scope")) & (F.floor(F.col("node") / p.fan) == F.col("of_node")), "left_semi")
        compared = nodes.groupBy("scope", "node").agg(*sums)
        compared = written(compared.select("scope", "node", ((F.col("n_0") != F.col("n_1")) | (F.col("h1_0") != F.col("h1_1")) | (F.col("h2_0") != F.col("h2_1"))).alias("differs")), "nodes")
        seen.append(tuple(compared.agg(F.count("*"), F.count_if("differs")).first()))
        open_ = compared.where("differs")
    return open_.select("scope", F.col("node").cast("int").alias("bucket")), seen


def differences(left: DataFrame, right: DataFrame, scope: str, keys: Sequence[str], values: Sequence[str], p: ReconcileParams = ReconcileParams()) -> DataFrame:
    """scope, keys, kind (only_left, only_right, changed) and the names of the columns that differ.

    Rows with equal keys are matched in the order of their values, so repeated
    rows are compared by number.  Nulls are equal to nulls.
    """
    leaves, _ = differing(leaf_digests(left, scope, keys, values, p), leaf_digests(right, scope, keys, values, p), p)
    leaves = maybe_broadcast(written(leaves, "open-leaves").toDF("of_scope", "of_bucket"))

    def opened(log: DataFrame, side: int) -> DataFrame:
        here = F.col(scope).eqNullSafe(F.col("of_scope")) & (_bucket(keys, p) == F.col("of_bucket"))
        rows = log.select(scope, *keys, *values).join(leaves, here, "left_semi")
        nth = F.row_number().over(Window.partitionBy(scope, *keys).orderBy(*values))
        return rows.select(scope, *keys, nth.alias("nth"), F.struct(*values).alias("row"), F.lit(side).alias("side"))

    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("row")))
    both = opened(left, 0).unionByName(opened(right, 1)).groupBy(scope, *keys, "nth").agg(pick(0).alias("l"), pick(1).alias("r"))
    kind = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").otherwise("changed")
    names = F.concat_ws(",", *[F.when(~F.col(f"l.{v}").eqNullSafe(F.col(f"r.{v}")), F.lit(v)) for v in values])
    out = both.withColumn("kind", kind).withColumn("columns", F.when(F.col("kind") == "changed", names))
    return out.where("kind <> 'changed' or columns <> ''").select(scope, *keys, "kind", "columns")
