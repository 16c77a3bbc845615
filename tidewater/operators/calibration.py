"""How well probabilities and scores hold up: Brier score, reliability, sizing, summaries of coefficients."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, col, expected_max_sharpe, probabilistic_sharpe


def brier(rows: DataFrame, probability: str, outcome: str) -> DataFrame:
    gap = F.col(probability) - F.col(outcome)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(gap * gap).alias("brier"), F.avg(outcome).alias("base_rate"))


def reliability(rows: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """Per bin of equal width the mean forecast, what came true, and the gap."""
    place = F.least(F.lit(bins - 1), F.floor(F.col(probability) * bins))
    sums = rows.groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_p"), F.avg(outcome).alias("observed"))
    return sums.withColumn("gap", F.col("mean_p") - F.col("observed"))


def fractional_kelly(mean, variance, share: float = 0.5, cap: float = 1.0) -> Column:
    """share * mean / variance within cap on both sides; 0 without variance."""
    return clamp(F.coalesce(F.try_divide(share * col(mean), col(variance)), F.lit(0.0)), -cap, cap)


def ic_summary(coefficients: DataFrame, ic: str = "ic") -> DataFrame:
    ratio = F.try_divide(F.avg(ic), F.stddev_pop(ic))
    hits = F.avg(F.when(F.col(ic) > 0, 1.0).otherwise(0.0))
    return coefficients.agg(F.count(F.lit(1)).alias("n"), F.avg(ic).alias("mean_ic"), F.stddev_pop(ic).alias("std_ic"), ratio.alias("ir"), (ratio * F.sqrt(F.count(F.lit(1)))).alias("t_stat"), hits.alias("hit_rate"))


def isotonic(rows: DataFrame, probability: str, outcome: str) -> DataFrame:
    """rows with ``calibrated``: the best fit of outcome that never falls as probability rises.

    Spark pools violators within ranges first; rows of equal probability count as one point with their mean.
    """
    known = rows.filter(F.col(probability).isNotNull() & F.col(outcome).isNotNull())
    known = known.withColumns({"_p": F.col(probability).cast("double"), "_y": F.col(outcome).cast("double")})
    points = known.groupBy("_p").agg(F.avg("_y").alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    model = IsotonicRegression(featuresCol="_p", labelCol="_y", weightCol="_w", predictionCol="calibrated").fit(points)
    return model.transform(known).drop("_p", "_y")


def _at(means: Column, share: float) -> Column:
    return F.get(F.array_sort(means), F.floor(F.size(means) * share).cast("int"))


def block_bootstrap(series: DataFrame, order: str, value: str, by: list[str] | None = None, block: int = 20, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """Per group of ``by`` n, the mean of a series, its 95 % interval by moving blocks (lower, upper), and p_value.

    p_value is the share of iterations whose mean is as far from the mean as that is from zero, one added to both. A
    block's sum is the difference of two running sums, so an iteration is n / block rows that join them by place; starts
    are hashes of seed, group, iteration and number, so reruns agree. A series of one block at most has no interval
    beside its mean; its p_value is that of blocks of its own length, 1 below three values.
    """
    by = by or []
    known = series.filter(F.col(value).isNotNull() & ~F.isnan(value))
    w = Window.partitionBy(*by)
    runs = known.select(*by, F.row_number().over(w.orderBy(order)).alias("place"), F.sum(value).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    whole = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).filter("n > 0").withColumn("length", F.least(F.lit(block), "n").cast("int"))
    runs = runs.unionByName(whole.select(*by, F.lit(0).alias("place"), F.lit(0.0).alias("run")))
    draws = whole.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("k", F.explode(F.expr("sequence(0, CAST(ceil(n / length) AS INT) - 1)")))
    first = F.pmod(F.xxhash64(F.lit(seed), *by, "iteration", "k"), F.col("n") - F.col("length") + 1).cast("int")
    draws = draws.withColumn("first", first).withColumn("last", F.col("first") + F.least("length", F.col("n") - F.col("k") * F.col("length")).cast("int"))
    side = lambda c: runs.select(*by, F.col("place").alias(c), F.col("run").alias(f"{c}_run"))
    drawn = draws.join(side("first"), [*by, "first"]).join(side("last"), [*by, "last"])
    means = drawn.groupBy(*by, "iteration").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), (F.sum(F.col("last_run") - F.col("first_run")) / F.first("n")).alias("m"))
    far = F.count_if(F.abs(F.col("m") - F.col("mean")) >= F.abs("mean"))
    out = means.groupBy(*by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.collect_list("m").alias("ms"), ((far + 1) / (F.count("*") + 1)).alias("p"))
    inside = lambda share: F.when(F.col("n") > block, _at(F.col("ms"), share)).otherwise(F.col("mean"))
    return out.select(*by, "n", inside(0.025).alias("lower"), "mean", inside(0.975).alias("upper"), F.when(F.col("n") >= 3, F.col("p")).otherwise(1.0).alias("p_value"))


def bootstrap_mean(series: DataFrame, order: str, value: str, block: int = 20, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """Mean of a series with its 95 % interval by moving blocks: lower, mean, upper; zeros without values."""
    told = block_bootstrap(series, order, value, None, block, iterations, seed)
    none = told.sparkSession.range(1).join(told.select("lower", "mean", "upper"), F.lit(True), "left")
    return none.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lower", "mean", "upper")])


def cluster_bootstrap(rows: DataFrame, by: list[str], cluster: str, value: str, iterations: int = 2000, seed: int = 42, least: int = 8) -> DataFrame:
    """Per group of ``by`` n, clusters, mean, median and the mean's 95 % interval (lower, upper) by drawing clusters with replacement.

    Only sums by cluster are drawn: an iteration is as many seeded hashes as there are clusters, joined to the sums
    by place and added up where they arise. Fewer than ``least`` clusters have no interval.
    """
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(value))
    told = known.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(cluster).alias("clusters"), F.avg(value).alias("mean"), F.median(value).alias("median"))
    sums = known.groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("c")).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(cluster)) - 1).drop(cluster)
    draws = told.filter(F.col("clusters") >= least).select(*by, "clusters", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    draws = draws.withColumn("k", F.explode(F.expr("sequence(0, CAST(clusters AS INT) - 1)"))).select(*by, "iteration", F.pmod(F.xxhash64(F.lit(seed), *by, "iteration", "k"), F.col("clusters")).cast("int").alias("place"))
    means = draws.join(sums, [*by, "place"]).groupBy(*by, "iteration").agg((F.sum("s") / F.sum("c")).alias("m"))
    bounds = means.groupBy(*by).agg(F.collect_list("m").alias("ms")).select(*by, _at(F.col("ms"), 0.025).alias("lower"), _at(F.col("ms"), 0.975).alias("upper"))
    return told.join(bounds, by, "left")


def deflated_sharpe(trials: DataFrame) -> DataFrame:
    """trials: name, sharpe, n, skew, kurt. With sr0 (the best to expect without skill), psr0 and dsr."""
    every = trials.agg(F.count(F.lit(1)).alias("n_trials"), F.var_pop("sharpe").alias("spread")).first()  # one row
    best = expected_max_sharpe(F.lit(max(2, every["n_trials"])), F.lit(every["spread"] or 0.0))
    psr = lambda against: probabilistic_sharpe("sharpe", "n", "skew", "kurt", against)
    return trials.withColumns({"sr0": best, "psr0": psr(F.lit(0.0)), "dsr": psr(best)})
