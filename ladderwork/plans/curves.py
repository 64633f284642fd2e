"""Career curves and clusters over the surrogate ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderwork.operators import curves
from ladderwork.plans.registry import query
from ladderwork.plans.timeline import EVENTS_SQL, events
from ladderwork.sources.warehouse import written

#: Given centres: rising, falling and arched curves.
CENTRES = [[(i - 20) / 12.0 for i in range(41)], [(20 - i) / 12.0 for i in range(41)], [1.2 - (i - 20) * (i - 20) / 150.0 for i in range(41)]]

CURVE_SQL = f"""{EVENTS_SQL},
sm AS (SELECT player_id, row_number() OVER w AS j, count(*) OVER (PARTITION BY player_id) AS n,
  avg(rating_after) OVER (PARTITION BY player_id ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS v FROM ev WINDOW w AS (PARTITION BY player_id ORDER BY game_date, game_id)),
pt AS (SELECT player_id, n, i, i * (n - 1) / 40e0 AS x FROM (SELECT DISTINCT player_id, n FROM sm WHERE n >= 42), range(41) t(i)),
raw AS (SELECT p.player_id, p.i, a.v + (coalesce(b.v, a.v) - a.v) * (x - floor(x)) AS y FROM pt p JOIN sm a ON a.player_id = p.player_id AND a.j = CAST(floor(x) AS BIGINT) + 1
  LEFT JOIN sm b ON b.player_id = p.player_id AND b.j = CAST(floor(x) AS BIGINT) + 2),
curve AS (SELECT player_id, i, (y - avg(y) OVER w) / stddev_pop(y) OVER w AS v FROM raw WINDOW w AS (PARTITION BY player_id))"""

_CENTRES_SQL = "centre AS (SELECT unnest(range(41)) AS i, 0 AS k, (unnest(range(41)) - 20) / 12e0 AS c UNION ALL SELECT unnest(range(41)), 1, (20 - unnest(range(41))) / 12e0 UNION ALL SELECT unnest(range(41)), 2, 1.2e0 - (unnest(range(41)) - 20) * (unnest(range(41)) - 20) / 150e0)"

ASSIGN_SQL = f"""{CURVE_SQL}, {_CENTRES_SQL},
dist AS (SELECT player_id, k, sum((v - c) * (v - c)) AS d FROM curve JOIN centre USING (i) GROUP BY ALL),
assigned AS (SELECT player_id, k AS cluster, sqrt(d) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY d, k) AS r FROM dist) WHERE r = 1)"""


def all_curves(spark, sf):
    return curves.career_curves(events(spark, sf))


@query(f"WITH {CURVE_SQL} SELECT player_id, CAST(i AS BIGINT) AS place, round(v, 5) + 0e0 AS value FROM curve")
def career_curve_41(spark, sf):
    rows = all_curves(spark, sf).select("player_id", F.posexplode("curve").alias("place", "value"))
    return rows.select("player_id", F.col("place").cast("long").alias("place"), (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query(f"WITH {ASSIGN_SQL} SELECT player_id, CAST(cluster AS BIGINT) AS cluster, round(distance, 5) AS distance FROM assigned")
def curve_assign(spark, sf):
    return curves.assigned(all_curves(spark, sf), CENTRES).select("player_id", F.col("cluster").cast("long").alias("cluster"), F.round("distance", 5).alias("distance"))


@query(f"""
WITH {ASSIGN_SQL},
d AS (SELECT a.player_id AS p, b.player_id AS q, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM curve a JOIN curve b ON a.i = b.i AND a.player_id <> b.player_id GROUP BY ALL),
m AS (SELECT p, x.cluster AS own, y.cluster AS c, avg(d) AS mean FROM d JOIN assigned x ON x.player_id = p JOIN assigned y ON y.player_id = q GROUP BY ALL),
s AS (SELECT p, own, coalesce(max(mean) FILTER (c = own), 0) AS a, min(mean) FILTER (c <> own) AS b FROM m GROUP BY ALL)
SELECT p AS player_id, CAST(own AS BIGINT) AS cluster, round((b - a) / greatest(a, b), 5) + 0e0 AS silhouette FROM s
""")
def silhouette_euclid(spark, sf):
    out = curves.silhouettes(curves.assigned(all_curves(spark, sf), CENTRES))
    return out.select("player_id", F.col("cluster").cast("long").alias("cluster"), (F.round("silhouette", 5) + F.lit(0.0)).alias("silhouette"))


@query(f"WITH {ASSIGN_SQL} SELECT CAST(cluster AS BIGINT) AS cluster, CAST(i AS BIGINT) AS place, count(*) AS n, round(quantile_cont(v, 0.25), 5) + 0e0 AS q25, round(median(v), 5) + 0e0 AS q50, round(quantile_cont(v, 0.75), 5) + 0e0 AS q75 FROM curve JOIN assigned USING (player_id) GROUP BY ALL")
def cluster_bands(spark, sf):
    out = curves.bands(curves.assigned(all_curves(spark, sf), CENTRES))
    return out.select(F.col("cluster").cast("long").alias("cluster"), F.col("place").cast("long").alias("place"), "n", *[(F.round(q, 5) + F.lit(0.0)).alias(q) for q in ("q25", "q50", "q75")])


@query()
def kmeans_fit(spark, sf):
    """Clusters of fitted centres; tested for inertia that does not rise and for order by peak."""
    rows = all_curves(spark, sf)
    return curves.assigned(rows, curves.kmeans(rows, 3)).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 5).alias("mean_distance"))


@query()
def k_selection(spark, sf):
    """Mean silhouette for several k."""
    rows = written(all_curves(spark, sf), "all-curves")
    out = None
    for k, centres in curves.kmeans_each(rows, (3, 4, 5, 6)).items():
        s = curves.silhouettes(curves.assigned(rows, centres))
        one = s.agg(F.lit(k).alias("k"), F.round(F.avg("silhouette"), 5).alias("mean_silhouette"))
        out = one if out is None else out.unionByName(one)
    return out
