"""Ingest: seasons, tracks, minutes, keys, sentinels, coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ladderwork.functions import scalar
from ladderwork.plans.registry import query
from ladderwork.sources import arena
from ladderwork.sources.arena import GAMES_SQL, read


@query("""
SELECT o_orderkey AS game_id,
  CAST(CASE WHEN year(o_orderdate) = 2020 AND month(o_orderdate) BETWEEN 7 AND 9 THEN 2019
            WHEN month(o_orderdate) < 7 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END AS BIGINT) AS season,
  CASE WHEN month(o_orderdate) < 7 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END || '-' ||
    lpad(CAST((CASE WHEN month(o_orderdate) < 7 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END + 1) % 100 AS VARCHAR), 2, '0') AS label
FROM orders
""")
def season_from_date(spark, sf):
    start = scalar.season_start(F.col("o_orderdate"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("game_id"), start.alias("season"), scalar.season_label(start).alias("label"))


@query("""
SELECT track, season_type, count(*) AS n FROM (
  SELECT CASE WHEN lower(trim(o_orderpriority)) = '5-low' THEN 'excluded' WHEN lower(trim(o_orderpriority)) = '1-urgent' THEN 'playoffs' ELSE 'regular' END AS track,
         CASE WHEN lower(trim(o_orderpriority)) = '1-urgent' THEN 'Playoffs' ELSE 'Regular Season' END AS season_type FROM orders)
GROUP BY ALL
""")
def track_classify(spark, sf):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", " Playoffs").otherwise("Regular")
    label = F.when(F.col("o_orderpriority") == "5-LOW", "Cup Championship")
    track, season_type = scalar.classify_track(kind, label)
    return read(spark, sf, "orders").select(track.alias("track"), season_type.alias("season_type")).groupBy("track", "season_type").agg(F.count("*").alias("n"))


_MINUTES = """
SELECT kind, count(*) AS n, count(m) AS parsed, round(sum(m), 4) AS total FROM (
  SELECT kind, CASE WHEN v >= 0 THEN v END AS m FROM (
    SELECT l_linenumber % 5 AS kind,
      CASE l_linenumber % 5 WHEN 0 THEN CAST(floor(l_quantity) AS DOUBLE) + CAST(l_linenumber * 7 % 60 AS DOUBLE) / 60
        WHEN 1 THEN CAST(floor(l_quantity) AS DOUBLE) WHEN 2 THEN NULL WHEN 3 THEN -CAST(floor(l_quantity) AS DOUBLE) ELSE NULL END AS v
    FROM lineitem))
GROUP BY kind
"""


@query(_MINUTES)
def minutes_parse(spark, sf):
    kind, whole = F.col("l_linenumber") % 5, F.floor("l_quantity").cast("string")
    text = (
        F.when(kind == 0, F.concat(whole, F.lit(":"), (F.col("l_linenumber") * 7 % 60).cast("string")))
        .when(kind == 1, whole).when(kind == 2, "  ").when(kind == 3, F.concat(F.lit("-"), whole)).otherwise("DNP")
    )
    rows = read(spark, sf, "lineitem").select(kind.alias("kind"), scalar.parse_minutes(text).alias("m"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count("m").alias("parsed"), F.round(F.sum("m"), 4).alias("total"))


@query("""
WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS known,
             lower(trim(r_name)) || '|' || lower(trim(n_name)) AS team_key
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT lower(trim(r_name)) || '|' || lower(trim(n_name)) AS team_key, min(n_nationkey) AS id FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT c_custkey AS row_id, coalesce(known, id) AS team_id, known IS NULL AS filled FROM k LEFT JOIN m USING (team_key)
""")
def team_key_enrich(spark, sf):
    """Missing team ids are filled from a dictionary on city|name; the dictionary is the small nation table."""
    names = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    keyed = names.select("n_nationkey", scalar.team_key(F.upper("r_name"), F.concat(F.lit(" "), "n_name")).alias("team_key"))
    dictionary = keyed.groupBy("team_key").agg(F.min("n_nationkey").alias("id"))
    rows = read(spark, sf, "customer").join(keyed, F.col("c_nationkey") == F.col("n_nationkey"))
    known = F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey"))
    rows = rows.select("c_custkey", known.alias("known"), "team_key")
    return rows.join(dictionary, "team_key", "left").select(
        F.col("c_custkey").alias("row_id"), F.coalesce("known", "id").alias("team_id"), F.col("known").isNull().alias("filled")
    )


@query("""
SELECT n_nationkey AS nation, count(*) AS n, CAST(sum(CASE WHEN pick = -1 THEN 1 ELSE 0 END) AS BIGINT) AS undrafted, min(CASE WHEN pick <> -1 THEN pick END) AS best,
  CAST(sum(coalesce(CASE WHEN pick <> -1 THEN pick END, fallback)) AS BIGINT) AS filled
FROM (SELECT s_nationkey AS n_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN -1 ELSE s_suppkey % 60 + 1 END AS pick, s_suppkey % 7 AS fallback FROM supplier)
GROUP BY 1
""")
def sentinel_null(spark, sf):
    """-1 becomes NULL, the raw value is kept, and a second source fills the gap."""
    key = F.col("s_suppkey")
    raw = F.when(key % 4 == 0, -1).otherwise(key % 60 + 1)
    rows = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), raw.alias("raw"), F.nullif(raw, F.lit(-1)).alias("pick"), (key % 7).alias("fallback"))
    return rows.groupBy("nation").agg(
        F.count("*").alias("n"), F.count_if(F.col("raw") == -1).alias("undrafted"), F.min("pick").alias("best"), F.sum(F.coalesce("pick", "fallback")).alias("filled")
    )


@query("""
SELECT o_custkey AS player_id, o_orderkey AS game_id, o_orderpriority AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1
""")
def dedupe_priority(spark, sf):
    """The first row per key by source priority, then date: one aggregation instead of a sort."""
    first = F.min_by(F.struct(F.col("o_orderkey").alias("game_id"), F.col("o_orderpriority").alias("source")), F.struct("o_orderpriority", "o_orderdate", "o_orderkey"))
    return read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("player_id")).agg(first.alias("r")).select("player_id", "r.game_id", "r.source")


@query(f"""
WITH {GAMES_SQL}
SELECT g.season, g.track, count(DISTINCT g.game_id) AS games, count(DISTINCT l.l_suppkey) AS players, count(l.l_orderkey) AS row_count,
  count(DISTINCT CASE WHEN l.l_orderkey IS NULL THEN g.game_id END) AS without_rows
FROM games g LEFT JOIN lineitem l ON l.l_orderkey = g.game_id GROUP BY ALL
""")
def coverage_summary(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("game_id"), "l_suppkey")
    rows = arena.games(spark, sf).join(lines, "game_id", "left")
    return rows.groupBy("season", "track").agg(
        F.countDistinct("game_id").alias("games"), F.countDistinct("l_suppkey").alias("players"), F.count("l_suppkey").alias("row_count"),
        F.countDistinct(F.when(F.col("l_suppkey").isNull(), F.col("game_id"))).alias("without_rows"),
    )


@query("""
SELECT l_shipmode_key AS part_band, count(*) AS n, min(team) AS first_team, max(team) AS last_team FROM (
  SELECT p_partkey % 10 AS l_shipmode_key, unnest(['home', 'away']) AS side, p_partkey AS game_id, unnest([p_size % 9, p_size % 11]) AS team FROM part)
GROUP BY 1
""")
def home_away_unpivot(spark, sf):
    """A home and an away column become two rows."""
    rows = read(spark, sf, "part").select((F.col("p_partkey") % 10).alias("part_band"), "p_partkey", (F.col("p_size") % 9).alias("home"), (F.col("p_size") % 11).alias("away"))
    return rows.unpivot(["part_band", "p_partkey"], ["home", "away"], "side", "team").groupBy("part_band").agg(
        F.count("*").alias("n"), F.min("team").alias("first_team"), F.max("team").alias("last_team")
    )


@query("""
WITH a AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 49),
b AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_linestatus = 'O' AND l_quantity < 2)
SELECT 'both' AS part, id FROM a WHERE id IN (SELECT id FROM b) UNION ALL SELECT 'left', id FROM a WHERE id NOT IN (SELECT id FROM b)
UNION ALL SELECT 'right', id FROM b WHERE id NOT IN (SELECT id FROM a)
""")
def id_set_operations(spark, sf):
    lines = read(spark, sf, "lineitem")
    a = lines.where("l_linestatus = 'F' and l_quantity > 49").select(F.col("l_suppkey").alias("id")).distinct()
    b = lines.where("l_linestatus = 'O' and l_quantity < 2").select(F.col("l_suppkey").alias("id")).distinct()
    tag = lambda df, name: df.select(F.lit(name).alias("part"), "id")
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "left")).unionByName(tag(b.exceptAll(a), "right"))


@query("""
SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL
""")
def json_props(spark, sf):
    return read(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))
