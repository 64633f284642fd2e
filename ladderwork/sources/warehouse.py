"""The warehouse: tables made by queries, rows added by queries, views, queries with bound values."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own under the cluster's shared one (a temporary one only where none is set)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-warehouse-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a side may be broadcast once they have been counted.
BROADCAST_ROWS = 200_000


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """A broadcast hint behind a count (that goes no further than the bound); otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def bound(spark: SparkSession, sql: str, args: Mapping[str, object] | None = None, **frames: DataFrame) -> DataFrame:
    """A query whose values are bound by name (never pasted into the text) over named frames."""
    return spark.sql(sql, args=dict(args or {}), **frames)


def create_as(spark: SparkSession, table: str, rows: DataFrame, path: str) -> None:
    """CREATE TABLE AS SELECT: the rows become a Parquet table at path."""
    spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{path}' AS SELECT * FROM {{rows}}", rows=rows)


def insert_select(spark: SparkSession, table: str, rows: DataFrame) -> None:
    """INSERT INTO ... SELECT, columns by name."""
    spark.sql(f"INSERT INTO {table} BY NAME SELECT * FROM {{rows}}", rows=rows)


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join that fails when a key of the right side repeats.

    The check rides on the aggregation by the key that the join needs anyway.
    """
    rest = [c for c in right.columns if c not in on]
    checked = right.groupBy(*on).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    single = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit("a key of the right side repeats")))
    return left.join(checked.select(*on, single.alias("_row")), on, how).select(left["*"], *[F.col(f"_row.{c}").alias(c) for c in rest])


def without_nan(rows: DataFrame) -> DataFrame:
    """NaN becomes null in every column of floating numbers."""
    floats = {c for c, kind in rows.dtypes if kind in ("double", "float")}
    return rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in rows.columns])


def upsert(spark: SparkSession, rows: DataFrame, on: list[str], path: str, version: int) -> None:
    """Bulk load with replacement: the table's next version has the given rows and the last version's others.

    Of given rows with one key the last by all columns counts.  A version that
    is loaded again is written again from the same predecessor.
    """
    rest = [c for c in rows.columns if c not in on]
    new = without_nan(rows).groupBy(*on).agg(F.max(F.struct(*rest)).alias("r")).select(*on, *[F.col(f"r.{c}").alias(c) for c in rest])
    if version:
        old = spark.read.schema(rows.schema).parquet(f"{path}/version={version - 1}")
        both = old.select("*", F.lit(0).alias("_new")).unionByName(new.select("*", F.lit(1).alias("_new")))
        new = both.groupBy(*on).agg(F.max_by(F.struct(*rest), "_new").alias("r")).select(*on, *[F.col(f"r.{c}").alias(c) for c in rest])
    new.write.mode("overwrite").parquet(f"{path}/version={version}")
