"""Readers: CSV, Parquet, JSON grids and checkpoints, each with a fixed schema."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ladderwork.schema import CHECKPOINT_SCHEMA, RatingParams


def read_csv(spark: SparkSession, path: str, schema: StructType | str, columns: Iterable[str] | None = None) -> DataFrame:
    """Header CSV (also .gz) with a schema; unreadable fields become NULL. Only `columns` are parsed."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.select(*columns) if columns else df


def with_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in order; missing ones are added as NULL."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    )


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Player state from a CSV or Parquet checkpoint."""
    df = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    return with_schema(df, CHECKPOINT_SCHEMA)


def parameter_grid(text: str) -> list[RatingParams]:
    """A JSON list of objects, or an object of lists whose product is taken."""
    spec = json.loads(text)
    if isinstance(spec, dict):
        names = list(spec)
        values = [v if isinstance(v, list) else [v] for v in spec.values()]
        spec = [dict(zip(names, combination, strict=True)) for combination in itertools.product(*values)]
    out = []
    for i, entry in enumerate(spec):
        entry = dict(entry)
        entry.setdefault("variant", ",".join(f"{k}={v:g}" if isinstance(v, float) else f"{k}={v}" for k, v in entry.items()) or str(i))
        out.append(RatingParams(**entry))
    return out
