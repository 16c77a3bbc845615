"""Risk measures of return series and multiple-testing rules."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import inverse_normal_cdf


def simple_returns(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    return bars.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).filter("ret is not null").select("ticker", "date", "ret")


def risk_summary(returns: DataFrame, alpha: float = 0.95) -> DataFrame:
    """Historical and conditional value at risk, Sharpe, Sortino and Cornish-Fisher figures of each ticker."""
    w = Window.partitionBy("ticker")
    ranked = returns.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("at", F.row_number().over(w.orderBy("ret", "date")) - 1)
    cut = F.floor((1 - F.lit(alpha)) * F.col("n"))
    down = F.col("ret") < 0
    z = inverse_normal_cdf(1 - F.lit(alpha))
    sums = ranked.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("at") == cut, -F.col("ret"))).alias("var"),
        F.coalesce(F.avg(F.when(F.col("at") < cut, -F.col("ret"))), F.max(F.when(F.col("at") == cut, -F.col("ret")))).alias("cvar"),
        F.avg("ret").alias("mean"),
        F.stddev_pop("ret").alias("std"),
        F.coalesce(F.skewness("ret"), F.lit(0.0)).alias("skew"),
        F.coalesce(F.kurtosis("ret"), F.lit(0.0)).alias("kurt"),
        F.sqrt(F.coalesce(F.avg(F.when(down, F.col("ret") * F.col("ret"))), F.lit(0.0))).alias("downside"),
    )
    s, k = F.col("skew"), F.col("kurt")
    adjusted = z + (z * z - 1) * s / 6 + (z * z * z - 3 * z) * k / 24 - (2 * z * z * z - 5 * z) * s * s / 36
    return sums.select(
        "ticker", "n", "var", "cvar", "mean", "std", "skew", "kurt",
        F.coalesce(F.try_divide(F.col("mean"), F.col("std")), F.lit(0.0)).alias("sharpe_daily"),
        (F.coalesce(F.try_divide(F.col("mean"), F.col("std")), F.lit(0.0)) * math.sqrt(252)).alias("sharpe"),
        (F.coalesce(F.try_divide(F.col("mean"), F.col("downside")), F.lit(0.0)) * math.sqrt(252)).alias("sortino"),
        (-(F.col("mean") + adjusted * F.col("std"))).alias("cornish_fisher_var"),
    )


def drawdowns(bars: DataFrame) -> DataFrame:
    """The deepest fall from a running peak, in percent, of each ticker."""
    upto = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("fall", (F.col("close") / F.max("close").over(upto) - 1) * 100).groupBy("ticker").agg(F.min("fall").alias("max_drawdown"))


def betas(returns: DataFrame, market: DataFrame) -> DataFrame:
    """Beta of each ticker to the market's returns; 1 where the market does not move."""
    both = returns.join(market.select("date", F.col("ret").alias("market")), "date")
    return both.groupBy("ticker").agg(F.coalesce(F.try_divide(F.covar_pop("ret", "market"), F.var_pop("market")), F.lit(1.0)).alias("beta"), F.count(F.lit(1)).alias("n"))


def benjamini_hochberg(tests: DataFrame, q: float = 0.1) -> DataFrame:
    """tests (name, p) with ``kept``: the step-up rule. One row a test, so the window is small."""
    order = Window.orderBy("p", "name")
    ranked = tests.withColumn("k", F.row_number().over(order)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    last = F.max(F.when(F.col("p") <= F.col("k") / F.col("m") * q, F.col("k"))).over(Window.partitionBy(F.lit(1)))
    return ranked.withColumn("kept", F.coalesce(F.col("k") <= last, F.lit(False))).select("name", "p", "kept")
