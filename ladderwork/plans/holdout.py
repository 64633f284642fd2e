"""The hold-out summary: gain against the baseline with its paired t, bootstrap interval, result row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderwork.functions import scalar, stats
from ladderwork.plans.evaluation import _DRAW, _P_SQL, TARGET_SQL, pairs
from ladderwork.plans.performance import performed
from ladderwork.plans.registry import query
from ladderwork.plans.timeline import events, season_ratings
from ladderwork.sources.warehouse import written

DRAWS = 2000

_UPPER = """CASE WHEN t >= 0 THEN tail ELSE 1 - tail END"""
_GAIN_SQL = f"""{TARGET_SQL},
g AS (SELECT boundary, count(*) AS n, avg(power(pred - target, 2)) AS mse, avg(target * target) AS baseline, avg(target * target - power(pred - target, 2)) AS gain,
  stddev_samp(target * target - power(pred - target, 2)) AS sd FROM pairs GROUP BY boundary),
t AS (SELECT *, CASE WHEN sd > 0 THEN gain / (sd / sqrt(n)) END AS t FROM g),
z AS (SELECT *, 1 / (1 + 0.2316419e0 * abs(t)) AS u FROM t),
p AS (SELECT *, exp(-t * t / 2) / sqrt(2 * pi()) * (u * (0.319381530e0 + u * (-0.356563782e0 + u * (1.781477937e0 + u * (-1.821255978e0 + u * 1.330274429e0))))) AS tail FROM z)"""


@query(f"WITH {_GAIN_SQL} SELECT boundary, n, round(mse, 6) AS mse, round(baseline, 6) AS baseline_mse, round(gain, 6) + 0e0 AS gain, round(t, 4) + 0e0 AS t, round({_UPPER}, 6) + 0e0 AS p FROM p")
def holdout_gain(spark, sf):
    """Paired t of the squared error's gain over predicting zero, one-sided p by the normal distribution."""
    baseline = F.col("target") * F.col("target")
    error = F.pow(F.col("pred") - F.col("target"), 2)
    rows = pairs(events(spark, sf)).groupBy("boundary").agg(
        F.count("*").alias("n"), F.avg(error).alias("mse"), F.avg(baseline).alias("baseline"), F.avg(baseline - error).alias("gain"), F.stddev_samp(baseline - error).alias("sd")
    )
    rows = rows.withColumn("t", F.when(F.col("sd") > 0, F.col("gain") / (F.col("sd") / F.sqrt("n"))))
    return rows.select(
        "boundary", "n", F.round("mse", 6).alias("mse"), F.round("baseline", 6).alias("baseline_mse"), (F.round("gain", 6) + F.lit(0.0)).alias("gain"),
        (F.round("t", 4) + F.lit(0.0)).alias("t"), (F.round(1.0 - scalar.norm_cdf(F.col("t")), 6) + F.lit(0.0)).alias("p"),
    )


@query(f"""
WITH {TARGET_SQL},
s AS (SELECT player_id, sum(target * target - power(pred - target, 2)) AS s, count(*) AS c FROM pairs GROUP BY player_id),
d AS (SELECT *, unnest(range(0, {DRAWS})) AS draw FROM s),
u AS (SELECT *, {_DRAW.format(a="player_id", b="draw")} / 2147483647e0 AS u FROM d),
t AS (SELECT *, (u >= 0.36787944117144233e0)::INT + (u >= 0.7357588823428847e0)::INT + (u >= 0.9196986029286058e0)::INT + (u >= 0.9810118431238462e0)::INT + (u >= 0.9963401531726563e0)::INT + (u >= 0.9994058151824183e0)::INT AS times FROM u),
m AS (SELECT draw, sum(s * times) / nullif(sum(c * times), 0) AS mean FROM t GROUP BY draw)
SELECT count(mean) AS draws, round(avg(mean), 5) AS mean, round(quantile_cont(mean, 0.025), 5) AS low, round(quantile_cont(mean, 0.975), 5) AS high, round(avg(CASE WHEN mean <= 0 THEN 1e0 ELSE 0e0 END), 4) AS p FROM m
""")
def bootstrap_interval(spark, sf):
    """Interval and p of the mean gain over resampled players; the draws are as many as the reports use."""
    rows = pairs(events(spark, sf)).withColumn("gain", F.col("target") * F.col("target") - F.pow(F.col("pred") - F.col("target"), 2))
    return stats.interval(stats.bootstrap_means(rows, "player_id", "gain", DRAWS), "mean", 5)


@query(f"""
WITH {TARGET_SQL},
m AS (SELECT season, player_id, sum(minutes) AS minutes FROM clean GROUP BY ALL),
last AS (SELECT season, stddev_pop(rating_after) AS sd, sum(rating_after * minutes) / sum(minutes) AS wmean, max(rating_after) AS top FROM ending JOIN m USING (season, player_id) GROUP BY season ORDER BY season DESC LIMIT 1),
metric AS (SELECT count(*) AS n, avg(power(pred - target, 2)) AS mse, corr(pred, target) AS r FROM pairs)
SELECT 'season_end' AS sampling, n, round(mse, 6) AS mse, round(r, 6) AS r, season AS last_season, round(sd, 1) AS last_sd, round(wmean, 1) AS last_minutes_wmean, round(top, 1) AS last_top_rating, CAST(10 AS BIGINT) AS "window", CAST(5 AS BIGINT) AS min_games FROM metric, last
""")
def result_row(spark, sf):
    """One row of a parameter run: the metric beside the last season's scale."""
    log = events(spark, sf)
    metric = pairs(log).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("pred") - F.col("target"), 2)).alias("mse"), F.corr("pred", "target").alias("r"))
    minutes = performed(spark, sf).groupBy("season", "player_id").agg(F.sum("minutes").alias("minutes"))
    scale = season_ratings(log).join(minutes, ["season", "player_id"]).groupBy("season").agg(
        F.stddev_pop("rating_after").alias("sd"), stats.weighted_mean(F.col("rating_after"), F.col("minutes")).alias("wmean"), F.max("rating_after").alias("top")
    )
    last = scale.agg(F.max(F.struct("season", "sd", "wmean", "top")).alias("last")).select("last.*")
    return metric.join(last, F.lit(True)).select(  # one row beside one row
        F.lit("season_end").alias("sampling"), "n", F.round("mse", 6).alias("mse"), F.round("r", 6).alias("r"), F.col("season").alias("last_season"),
        F.round("sd", 1).alias("last_sd"), F.round("wmean", 1).alias("last_minutes_wmean"), F.round("top", 1).alias("last_top_rating"),
        F.lit(10).cast("long").alias("window"), F.lit(5).cast("long").alias("min_games"),
    )


def summary(rows: DataFrame, draws: int = DRAWS) -> DataFrame:
    """One row of all statistics of pairs (boundary, player_id, pred, target).

    Errors and spreads, r and rho with the normal p of r, the boundaries with
    a positive r and their exact sign test, and for players and boundaries as
    clusters the mean, interval and p of r and of the gain.
    """
    rows = written(rows, "pairs")
    p, t = F.col("pred"), F.col("target")
    whole = rows.agg(
        F.count("*").alias("n"), F.countDistinct("player_id").alias("n_players"), F.countDistinct("boundary").alias("n_boundaries"),
        F.avg((t - p) * (t - p)).alias("mse"), F.avg(t * t).alias("baseline_mse"), F.stddev_pop("pred").alias("pred_sd"), F.stddev_pop("target").alias("target_sd"),
    )
    whole = whole.withColumn("improvement", F.col("baseline_mse") - F.col("mse")).withColumn("discrimination", F.col("pred_sd") / F.nullif("target_sd", F.lit(0.0)))
    r = stats.pearson(rows, [], "pred", "target").select("r", F.col("p").alias("p_r_normal"))
    rho = stats.spearman(rows, [], "pred", "target").select("rho")
    each = stats.pearson(rows, ["boundary"], "pred", "target").agg(F.count("*").alias("of"), F.count_if(F.col("r") > 0).alias("n_positive_r"))
    sign = each.select("n_positive_r", scalar.binomial_tail(F.col("n_positive_r"), F.col("of")).alias("p_sign_exact"))
    clusters = F.explode(F.array(F.struct(F.lit("player").alias("kind"), F.col("player_id").alias("of")), F.struct(F.lit("season").alias("kind"), F.col("boundary").alias("of"))))
    told = stats.moments(rows.withColumn("c", clusters).select("c.*", "pred", "target"), "of", "pred", "target", ["kind"])
    found = written(stats.bootstrap_moments(told, draws, once=True, keys=["kind"]), "draws")
    boot = []
    for kind in ("player", "season"):
        for value in ("r", "gain"):
            v = F.when(F.col("kind") == kind, F.col(value))
            below = F.when(v <= 0, 1.0).when(v.isNotNull(), 0.0)
            boot += [c.alias(f"boot_{kind}_{value}_{n}") for n, c in (("mean", F.avg(v)), ("lo", F.percentile(v, 0.025)), ("hi", F.percentile(v, 0.975)), ("p", F.avg(below)))]
    for one in (r, rho, sign, found.agg(*boot)):
        whole = whole.join(F.broadcast(one), how="left")  # one row beside one row
    return whole


_MOMENTS = "count(*)::DOUBLE AS n, sum(pred) AS sx, sum(target) AS sy, sum(pred * pred) AS sxx, sum(target * target) AS syy, sum(pred * target) AS sxy"
_BOOT = ", ".join(
    f"round(avg({v}) FILTER (kind = '{k}'), 5) + 0e0 AS boot_{k}_{v}_mean, round(quantile_cont({v}, 0.025) FILTER (kind = '{k}'), 5) + 0e0 AS boot_{k}_{v}_lo, "
    f"round(quantile_cont({v}, 0.975) FILTER (kind = '{k}'), 5) + 0e0 AS boot_{k}_{v}_hi, round(avg(CASE WHEN {v} <= 0 THEN 1e0 WHEN {v} IS NOT NULL THEN 0e0 END) FILTER (kind = '{k}'), 5) AS boot_{k}_{v}_p"
    for k in ("player", "season") for v in ("r", "gain")
)


def _resampled_sql(times: str) -> str:
    return f"""
c AS (SELECT 'player' AS kind, player_id AS id, {_MOMENTS} FROM pairs GROUP BY player_id UNION ALL SELECT 'season', boundary, {_MOMENTS} FROM pairs GROUP BY boundary),
d AS (SELECT *, unnest(range(0, {DRAWS})) AS draw FROM c),
u AS (SELECT *, {_DRAW.format(a="id", b="draw")} / 2147483647e0 AS u FROM d),
w AS (SELECT *, {times} AS times FROM u),
s AS (SELECT kind, draw, sum(n * times) AS n, sum(sx * times) AS sx, sum(sy * times) AS sy, sum(sxx * times) AS sxx, sum(syy * times) AS syy, sum(sxy * times) AS sxy FROM w GROUP BY ALL),
drawn AS (SELECT kind, draw, CASE WHEN n >= 3 AND n * sxx - sx * sx > 1e-9 AND n * syy - sy * sy > 1e-9 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END AS r, (2 * sxy - sxx) / nullif(n, 0) AS gain FROM s)"""


@query(f"""
WITH {TARGET_SQL},{_resampled_sql("(u >= 0.36787944117144233e0)::INT")},
boot AS (SELECT {_BOOT} FROM drawn),
m AS (SELECT count(*) AS n, count(DISTINCT player_id) AS n_players, count(DISTINCT boundary) AS n_boundaries, avg(power(target - pred, 2)) AS mse, avg(target * target) AS baseline_mse, stddev_pop(pred) AS pred_sd, stddev_pop(target) AS target_sd, corr(pred, target) AS r FROM pairs),
z AS (SELECT n, r, abs(r * sqrt((n - 2) / nullif(1 - r * r, 0))) AS z FROM m), t AS (SELECT *, 1 / (1 + 0.2316419e0 * z) AS t FROM z), pr AS (SELECT {_P_SQL} AS p_r_normal FROM t),
rk AS (SELECT rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2e0 AS a, rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2e0 AS b FROM pairs),
rho AS (SELECT corr(a, b) AS rho FROM rk),
e AS (SELECT count(*) AS of, count(*) FILTER (r > 0) AS k FROM (SELECT CASE WHEN count(*) >= 3 AND stddev_pop(pred) > 0 AND stddev_pop(target) > 0 THEN corr(pred, target) END AS r FROM pairs GROUP BY boundary)),
sg AS (SELECT k AS n_positive_r, sum(exp(lgamma(of + 1) - lgamma(j + 1) - lgamma(of - j + 1) - of * ln(2))) AS p_sign_exact FROM (SELECT k, of, unnest(range(k, of + 1)) AS j FROM e) GROUP BY k)
SELECT n, n_players, n_boundaries, round(mse, 6) AS mse, round(baseline_mse, 6) AS baseline_mse, round(baseline_mse - mse, 6) + 0e0 AS improvement, round(pred_sd, 6) AS pred_sd, round(target_sd, 6) AS target_sd,
  round(pred_sd / nullif(target_sd, 0), 6) AS discrimination, round(r, 6) + 0e0 AS r, round(rho, 6) + 0e0 AS rho, round(p_r_normal, 6) + 0e0 AS p_r_normal, n_positive_r, round(p_sign_exact, 6) AS p_sign_exact, boot.* FROM m, pr, rho, sg, boot
""")
def holdout_summary(spark, sf):
    """All statistics of the pairs in one row."""
    out = summary(pairs(events(spark, sf)))
    whole, signed = ("n", "n_players", "n_boundaries", "n_positive_r"), lambda c: (F.round(c, 5 if c.startswith("boot") else 6) + F.lit(0.0)).alias(c)
    return out.select(*[F.col(c) if c in whole else signed(c) for c in out.columns])


@query(f"""
WITH {TARGET_SQL},{_resampled_sql("(u >= 0.36787944117144233e0)::INT + (u >= 0.7357588823428847e0)::INT + (u >= 0.9196986029286058e0)::INT + (u >= 0.9810118431238462e0)::INT + (u >= 0.9963401531726563e0)::INT + (u >= 0.9994058151824183e0)::INT")}
SELECT kind, count(r) AS draws, round(avg(r), 5) + 0e0 AS mean, round(quantile_cont(r, 0.025), 5) + 0e0 AS low, round(quantile_cont(r, 0.975), 5) + 0e0 AS high, round(avg(CASE WHEN r <= 0 THEN 1e0 WHEN r IS NOT NULL THEN 0e0 END), 5) AS p FROM drawn GROUP BY kind
""")
def bootstrap_correlation(spark, sf):
    """Interval and p of r over resampled players and seasons, clusters by their multiplicities."""
    rows = written(pairs(events(spark, sf)), "pairs")
    clusters = F.explode(F.array(F.struct(F.lit("player").alias("kind"), F.col("player_id").alias("of")), F.struct(F.lit("season").alias("kind"), F.col("boundary").alias("of"))))
    told = stats.moments(rows.withColumn("c", clusters).select("c.*", "pred", "target"), "of", "pred", "target", ["kind"])
    found = stats.bootstrap_moments(told, DRAWS, keys=["kind"])
    at = lambda c: (F.round(c, 5) + F.lit(0.0))
    below = F.when(F.col("r") <= 0, 1.0).when(F.col("r").isNotNull(), 0.0)
    return found.groupBy("kind").agg(
        F.count("r").alias("draws"), at(F.avg("r")).alias("mean"), at(F.percentile("r", 0.025)).alias("low"), at(F.percentile("r", 0.975)).alias("high"), F.round(F.avg(below), 5).alias("p")
    )
