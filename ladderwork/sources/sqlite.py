"""A SQLite database as a Spark data source: a table in ranges of row ids, or a query with bound values.

The file has to lie where every executor can open it (SQLite reads local
paths only), so this is for databases of a shared mount or of one machine; all
else in the library reads what Spark reads.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Mapping
from contextlib import closing
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Rows(InputPartition):
    """Row ids from low up to high, or all rows of a query (null bounds)."""

    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: Mapping[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Rows]:
        if "query" in self.options:
            return [Rows(None, None)]
        with closing(_opened(self.options["path"])) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.options['table'])}").fetchone()
        if low is None:
            return [Rows(0, 0)]
        n = max(1, int(self.options.get("partitions", "8")))
        width = -(-(high - low + 1) // n)
        return [Rows(a, a + width) for a in range(low, high + 1, width)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        with closing(_opened(self.options["path"])) as db:
            if partition.low is None:
                found = db.execute(self.options["query"], json.loads(self.options.get("params", "{}")))
            else:
                names = ", ".join(_quoted(f.name) for f in self.schema.fields)
                found = db.execute(f"SELECT {names} FROM {_quoted(self.options['table'])} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))
            kinds = [f.dataType for f in self.schema.fields]
            for row in found:
                yield tuple(_fitting(v, k) for v, k in zip(row, kinds, strict=True))


def _fitting(value, kind):
    """SQLite holds any value in any column: one that is not of the column's type becomes null or its text."""
    if value is None or isinstance(kind, StringType):
        return None if value is None else value if isinstance(value, str) else str(value)
    if isinstance(kind, BinaryType):
        return value if isinstance(value, bytes) else None
    try:
        return float(value) if isinstance(kind, DoubleType) else int(value)
    except (TypeError, ValueError):
        return None


class SqliteSource(DataSource):
    """format("sqlite"): options path and table (partitions), or path, query and params (JSON, by name)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        """Types by declared affinity; a query's columns are text unless a schema is given."""
        with closing(_opened(self.options["path"])) as db:
            if "query" in self.options:
                cursor = db.execute(f"SELECT * FROM ({self.options['query']}) LIMIT 0", json.loads(self.options.get("params", "{}")))
                return StructType([StructField(c[0], StringType()) for c in cursor.description])
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        return StructType([StructField(c[1], _type_of(c[2] or "")) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, dict(self.options))


def _type_of(declared: str):
    """SQLite's rules of affinity."""
    name = declared.upper()
    if "INT" in name:
        return LongType()
    if any(x in name for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if not name or "BLOB" in name:
        return BinaryType()
    return DoubleType()


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).load()


def read_query(spark: SparkSession, path: str, query: str, params: Mapping[str, object] | None = None, schema: str | None = None) -> DataFrame:
    """A query with values bound by name (:name), never pasted into its text."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("path", path).option("query", query).option("params", json.dumps(dict(params or {})))
    return (reader.schema(schema) if schema else reader).load()
