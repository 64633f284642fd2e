"""Statistics over DataFrames, each as few aggregations as it takes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.functions.ranks import average_ranks
from ladderwork.functions.scalar import clip, correlation_p
from ladderwork.functions.selection import weighted_quantiles  # noqa: F401  a statistic like the others


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of products over sum of weights; the plain mean where all weights are 0."""
    total = F.sum(weight)
    return F.when(total != 0, F.sum(value * weight) / F.nullif(total, F.lit(0.0))).otherwise(F.avg(value))


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """r and its p; NULL under three pairs or without spread."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*keys).agg(
        F.count("*").alias("n"), F.corr(x, y).alias("r"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy")
    )
    r = F.when((F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("r"))
    return out.select(*keys, "n", r.alias("r")).withColumn("p", correlation_p(F.col("r"), F.col("n")))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of the ranks, in groups of any size."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both, keys, x, "rx"), keys, y, "ry")
    return pearson(ranked, keys, "rx", "ry").withColumnRenamed("r", "rho")


def error_metrics(pairs: DataFrame, keys: Sequence[str], predicted: str, target: str) -> DataFrame:
    """MSE, the MSE of predicting the mean, the gain, and how far predictions spread."""
    p, t = F.col(predicted), F.col(target)
    out = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((p - t) * (p - t)).alias("mse"), F.var_pop(t).alias("baseline_mse"),
        F.stddev_pop(p).alias("pred_sd"), F.stddev_pop(t).alias("target_sd"), F.corr(p, t).alias("r"),
    )
    return out.withColumn("improvement", F.col("baseline_mse") - F.col("mse")).withColumn(
        "discrimination", F.col("pred_sd") / F.nullif("target_sd", F.lit(0.0))
    )


def log_loss_and_brier(df: DataFrame, keys: Sequence[str], probability: str, outcome: str, edge: float = 1e-12) -> DataFrame:
    p, s = clip(F.col(probability), edge, 1 - edge), F.col(outcome)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(-(s * F.log(p) + (1 - s) * F.log(1 - p))).alias("log_loss"), F.avg((p - s) * (p - s)).alias("brier")
    )


def draw(*parts: Column) -> Column:
    """A reproducible pseudo-random integer below 2**31 from whole numbers, plain arithmetic.

    Any engine computes the same number, so resamples can be compared.
    """
    out = F.lit(12_345).cast("long")
    for part in parts:
        out = F.pmod((out + F.pmod(part.cast("long"), F.lit(2_147_483_647))) * 48_271, F.lit(2_147_483_647))
    return F.pmod(out * 48_271, F.lit(2_147_483_647))


def bootstrap_means(df: DataFrame, cluster: str, value: str, draws: int) -> DataFrame:
    """Means of resamples of clusters with replacement.

    Clusters are reduced to (sum, count) first, so a resample multiplies
    sufficient statistics; each cluster's multiplicity is a hash-derived
    Poisson(1) draw and no row moves between tasks before the sums do.
    """
    stats = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    u = draw(F.col(cluster), F.col("draw")) / 2_147_483_647.0
    cumulative = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    times = sum((F.when(u >= c, 1).otherwise(0) for c in cumulative), F.lit(0))
    spread = stats.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("times", times)
    return spread.groupBy("draw").agg((F.sum(F.col("s") * F.col("times")) / F.nullif(F.sum(F.col("c") * F.col("times")), F.lit(0))).alias("mean"))


def moments(df: DataFrame, cluster: str | Column, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per cluster what a correlation and a gain need: the count and five sums."""
    p, t = F.col(x), F.col(y)
    of = F.col(cluster) if isinstance(cluster, str) else cluster
    return df.groupBy(*keys, of.alias("cluster")).agg(
        F.count("*").cast("double").alias("n"), F.sum(p).alias("sx"), F.sum(t).alias("sy"), F.sum(p * p).alias("sxx"), F.sum(t * t).alias("syy"), F.sum(p * t).alias("sxy")
    )


def _closed(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> dict[str, Column]:
    """r (null under three pairs or without spread) and the mean gain of x over 0 as a prediction of y."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    r = F.when((n >= 3) & (vx > 1e-9) & (vy > 1e-9), (n * sxy - sx * sy) / F.sqrt(vx * vy))
    return {"r": r, "gain": (2 * sxy - sxx) / F.nullif(n, F.lit(0.0))}


def bootstrap_moments(stats: DataFrame, draws: int, once: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """r and gain of resamples of clusters (rows of `moments`), all draws and keys in one aggregation.

    A cluster's multiplicity is Poisson(1) by draw(cluster, number of the
    draw); with `once` a cluster that is drawn counts once.  Only sums leave a
    task: six numbers a draw.
    """
    u = draw(F.col("cluster"), F.col("draw")) / 2_147_483_647.0
    cumulative = [0.36787944117144233] if once else [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    times = sum((F.when(u >= c, 1.0).otherwise(0.0) for c in cumulative), F.lit(0.0))
    spread = stats.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("times", times)
    sums = spread.groupBy(*keys, "draw").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    closed = _closed(*map(F.col, ("n", "sx", "sy", "sxx", "syy", "sxy")))
    return sums.select(*keys, "draw", *[c.alias(n) for n, c in closed.items()])


def shuffled_within(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The values dealt anew inside each group by a hash-derived order (a permutation baseline)."""
    w = Window.partitionBy(*keys)
    left = df.withColumn("place", F.row_number().over(w.orderBy(order)))
    right = df.select(*keys, F.col(value).alias(f"shuffled_{value}"), F.row_number().over(w.orderBy(draw(F.col(order)), order)).alias("place"))
    return left.join(right, [*keys, "place"]).drop("place")


def interval(draws: DataFrame, value: str, digits: int) -> DataFrame:
    """Mean, central 95 % interval and share of draws at or below zero."""
    at = lambda q: F.round(F.percentile(value, q), digits)
    below = F.when(F.col(value) <= 0, 1.0).when(F.col(value).isNotNull(), 0.0).otherwise(0.0)
    return draws.agg(
        F.count(value).alias("draws"), F.round(F.avg(value), digits).alias("mean"), at(0.025).alias("low"), at(0.975).alias("high"), F.round(F.avg(below), 4).alias("p")
    )


def balanced_accuracy(df: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Rows, accuracy and the mean of each class's recall, by keys."""
    hit = F.when(F.col(truth) == F.col(guess), 1.0).otherwise(0.0)
    classes = df.groupBy(*keys, truth).agg(F.count("*").alias("n"), F.sum(hit).alias("hits"))
    return classes.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg(F.col("hits") / F.col("n")).alias("balanced_accuracy")
    )
