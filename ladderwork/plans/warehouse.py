"""Warehouse steps: tables made and filled by queries, bound values, coerced dates, required fields, checked joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ladderwork.plans.registry import query
from ladderwork.sources import arena, warehouse
from ladderwork.sources.arena import CLEAN_SQL, read

_SUMS = "SELECT season, track, player_id, count(*) AS games, round(sum(minutes), 4) AS minutes"


@query(f"WITH {CLEAN_SQL} {_SUMS} FROM clean WHERE track IN ('regular', 'playoffs') GROUP BY ALL")
def warehouse_table(spark, sf):
    """A table made from one track's seasons, to which a second query adds the other's; its entry in the catalog goes again."""
    rows = arena.clean(spark, sf).groupBy("season", "track", "player_id").agg(F.count("*").alias("games"), F.round(F.sum("minutes"), 4).alias("minutes"))
    table = f"season_minutes_{uuid.uuid4().hex}"
    warehouse.create_as(spark, table, rows.where("track = 'regular'"), warehouse.new_path(spark, "season-minutes"))
    warehouse.insert_select(spark, table, rows.where("track = 'playoffs'"))
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


@query(f"WITH {CLEAN_SQL} SELECT season, track, count(*) AS n, count(DISTINCT player_id) AS players FROM clean WHERE season BETWEEN 1993 AND 1996 AND track IN ('regular', 'playoffs') GROUP BY ALL")
def bound_values(spark, sf):
    return warehouse.bound(
        spark,
        "SELECT season, track, count(*) AS n, count(DISTINCT player_id) AS players FROM {rows} WHERE season BETWEEN :low AND :high AND track IN (:one, :other) GROUP BY ALL",
        {"low": 1993, "high": 1996, "one": "regular", "other": "playoffs"},
        rows=arena.clean(spark, sf),
    )


@query(f"WITH {CLEAN_SQL}, leaders AS (SELECT season, player_id, sum(points) AS points FROM clean WHERE track = 'playoffs' GROUP BY ALL) SELECT season, count(*) AS players, CAST(floor(max(points)) AS BIGINT) AS most FROM leaders GROUP BY season")
def view_over_view(spark, sf):
    """A view on a view; both are read by name and dropped."""
    rows, leaders = (f"v_{uuid.uuid4().hex}" for _ in range(2))
    arena.clean(spark, sf).createOrReplaceTempView(rows)
    spark.sql(f"CREATE TEMPORARY VIEW {leaders} AS SELECT season, player_id, sum(points) AS points FROM {rows} WHERE track = 'playoffs' GROUP BY ALL")
    out = spark.sql(f"SELECT season, count(*) AS players, CAST(floor(max(points)) AS BIGINT) AS most FROM {leaders} GROUP BY season")
    for name in (leaders, rows):
        spark.catalog.dropTempView(name)
    return out


@query("""
WITH t AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 5 = 1 THEN NULL WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%Y-13-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text FROM orders)
SELECT year(try_cast(text AS DATE)) AS year, count(*) AS n, count(text) AS given, CAST(sum(CASE WHEN text IS NOT NULL AND try_cast(text AS DATE) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unreadable FROM t GROUP BY 1
""")
def dates_coerced(spark, sf):
    """Unreadable dates become NULL and are counted."""
    key, date = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = F.when(key == 0, "n/a").when(key == 1, None).when(key == 2, F.date_format(date, "yyyy-'13'-dd")).otherwise(F.date_format(date, "yyyy-MM-dd"))
    rows = read(spark, sf, "orders").select(text.alias("text")).withColumn("day", F.try_to_timestamp("text", F.lit("yyyy-MM-dd")))
    return rows.groupBy(F.year("day").cast("long").alias("year")).agg(
        F.count("*").alias("n"), F.count("text").alias("given"), F.count_if(F.expr("text is not null and day is null")).alias("unreadable")
    )


@query(f"WITH {CLEAN_SQL} SELECT season, count(*) AS rows_kept, round(avg(plus_minus), 6) + 0e0 AS mean_plus_minus FROM clean WHERE plus_minus IS NOT NULL AND minutes IS NOT NULL GROUP BY season")
def required_fields(spark, sf):
    rows = arena.clean(spark, sf).na.drop(subset=["plus_minus", "minutes"])
    return rows.groupBy("season").agg(F.count("*").alias("rows_kept"), (F.round(F.avg("plus_minus"), 6) + F.lit(0.0)).alias("mean_plus_minus"))


@query(f"WITH {CLEAN_SQL} SELECT s_nationkey AS nation, count(*) AS n, count(DISTINCT player_id) AS players FROM clean LEFT JOIN supplier ON s_suppkey = player_id GROUP BY 1")
def validated_join(spark, sf):
    """Each box row finds at most one player; a repeated player would fail the query."""
    players = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_nationkey").alias("nation"))
    rows = warehouse.many_to_one(arena.clean(spark, sf).select("player_id"), players, ["player_id"])
    return rows.groupBy("nation").agg(F.count("*").alias("n"), F.countDistinct("player_id").alias("players"))


@query(f"""
WITH {CLEAN_SQL}, s AS (SELECT season, count(DISTINCT game_id) AS games, count(DISTINCT player_id) AS players, max(team_score) AS top FROM clean GROUP BY season)
SELECT string_agg('- ' || season || ': ' || games || ' games, ' || players || ' players, top score ' || CAST(CAST(floor(top) AS BIGINT) AS VARCHAR), chr(10) ORDER BY season) AS report FROM s
""")
def season_report(spark, sf):
    """A small report in Markdown: one line a season (as many rows as seasons meet)."""
    rows = arena.clean(spark, sf).groupBy("season").agg(F.countDistinct("game_id").alias("games"), F.countDistinct("player_id").alias("players"), F.floor(F.max("team_score")).alias("top"))
    line = F.format_string("- %d: %d games, %d players, top score %d", "season", "games", "players", "top")
    lines = F.array_sort(F.collect_list(F.struct("season", line.alias("line"))))
    return rows.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("report"))
