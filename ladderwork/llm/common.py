"""What the operators share: intermediate tables, row keys and components.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, which all executors share, so that a lost executor
costs a re-read and not a wrong result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and values in them, up to which a side may be broadcast once both have been counted.
BROADCAST_ROWS = 200_000
BROADCAST_VALUES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-ladderwork-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Stands for a null id in Python code, where a null would turn the column to floats.
NO_ID = -(2**63)


def given_id(name: str, to: str | None = None) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias(to or name)


def null_id(name: str, to: str | None = None) -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(to or name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """128-bit key of a text; null and empty texts share one."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def small_enough(df: DataFrame, values: Column | None = None) -> bool:
    """Whether df may be broadcast: few rows, and few values where rows hold arrays or texts.

    `values` says how many numbers (or eight bytes of text) a row holds; rows
    of plain columns need none.  Counts no further than the bound on rows.
    """
    part = df.limit(BROADCAST_ROWS + 1)
    n, held = part.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if values is None else values), F.lit(0))).first()
    return n <= BROADCAST_ROWS and held <= BROADCAST_VALUES


def maybe_broadcast(df: DataFrame, values: Column | None = None) -> DataFrame:
    """A broadcast hint only behind a count; otherwise the join shuffles."""
    return F.broadcast(df) if small_enough(df, values) else df


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of links (a, b): rows (id, component), the least id.

    Distributed union-find by alternating large-star and small-star steps
    (Kiveris et al., 2014).  Every step is two hash aggregations and one
    equi-join whose hot keys adaptive execution may split; no component is
    gathered anywhere.  Ids without a link do not appear.
    """
    both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = written(both.where("u <> v").distinct(), name)
    before = None
    while True:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        )
        large = large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
