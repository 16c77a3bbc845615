"""Price scores of each ticker's last bars, and ratios of its returns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp
from .panel import by_ticker

TAIL = 200
#: Points a percent of return over so many bars, and steps of the scores of length and age.
TREND = {20: 2.3, 60: 1.15, 120: 0.68}
LENGTHS = ((180, 100.0), (120, 85.0), (60, 65.0), (30, 45.0))
AGES = ((2, 100.0), (4, 82.0), (6, 55.0), (10, 30.0))


def stepped(value: Column, steps, otherwise: float, at_least: bool) -> Column:
    """The score of the first step that the value reaches (or does not exceed)."""
    out = F.lit(otherwise)
    for bound, score in reversed(steps):
        out = F.when(value >= bound if at_least else value <= bound, score).otherwise(out)
    return out


def drawdown(closes: Column) -> Column:
    """The deepest fall below a running peak, percent."""
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc: Column, x: Column) -> Column:
        peak = F.greatest(acc["peak"], x)
        return F.struct(peak.alias("peak"), F.greatest(acc["worst"], F.when(peak > 0, (peak - x) / peak * 100).otherwise(0.0)).alias("worst"))

    return F.aggregate(closes, start, step, lambda acc: acc["worst"])


def price_metrics(bars: DataFrame, anchor: Column) -> DataFrame:
    """One row a ticker from its last TAIL bars: returns, trends, breadth, volatility, drawdown, liquidity, volume and confidence scores.

    anchor: the date that ages count from, an aggregate over the ticker's bars or a literal.
    """
    last = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    rows = bars.withColumn("back", F.row_number().over(last)).filter(F.col("back") <= TAIL)
    w = by_ticker()
    of = lambda k: w.rowsBetween(1 - k, 0)
    rows = rows.withColumn("prior", F.lag("close").over(w)).withColumn("ret", F.when((F.col("prior") > 0) & (F.col("close") > 0), F.log(F.col("close") / F.col("prior"))))
    back = lambda k: F.lag("close", k).over(w)
    change = lambda k: F.when(back(k) > 0, (F.col("close") - back(k)) / back(k) * 100)
    vol = lambda k: F.coalesce(F.stddev_samp("ret").over(of(k)), F.lit(0.0)) * math.sqrt(252) * 100
    down = F.col("close") < F.col("prior")
    paired = lambda x: F.when(F.col("prior").isNotNull(), x)
    rows = rows.select(
        "ticker", "date", "close", "back",
        F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("bar_count"),
        *[change(k).alias(f"return_{k}d") for k in TREND],
        vol(60).alias("annual_volatility"), vol(20).alias("volatility_20"),
        F.collect_list("close").over(of(60)).alias("closes"), F.max("high").over(of(60)).alias("high_60"),
        F.avg("close").over(of(50)).alias("ma_50"), F.avg("close").over(of(200)).alias("ma_200"),
        F.avg("volume").over(of(20)).alias("volume_20"), F.avg("volume").over(of(60)).alias("volume_60"),
        F.sum(paired(F.col("volume"))).over(of(19)).alias("paired_volume"), F.sum(F.when(down, F.col("volume")).otherwise(0.0)).over(of(19)).alias("down_volume"),
        F.avg(paired(down.cast("double"))).over(of(19)).alias("down_days"),
    ).filter("back = 1")
    rows = rows.withColumn("volume_ratio", F.when(F.col("volume_60") > 0, F.col("volume_20") / F.col("volume_60")).otherwise(1.0)).withColumn("drawdown_60d", drawdown(F.col("closes")))
    value, age = F.col("volume_20") * F.col("close"), F.datediff(anchor, "date")
    sure = clamp(stepped(F.col("bar_count"), LENGTHS, 25.0, True) * 0.65 + stepped(age, AGES, 15.0, False) * 0.35, 0, 100)
    points = lambda test, n: F.when(test, n).otherwise(0)
    return rows.select(
        "ticker", F.col("date").alias("price_as_of"), "bar_count", F.col("close").alias("last_price"), *[f"return_{k}d" for k in TREND],
        *[F.coalesce(clamp(50 + F.col(f"return_{k}d") * by, 0, 100), F.lit(50.0)).alias(f"trend_{k}_score") for k, by in TREND.items()],
        clamp(35 + points(F.col("close") > F.col("ma_50"), 25) + points(F.col("close") > F.col("ma_200"), 20) + points(F.col("return_60d") > 0, 20), 0, 100).alias("breadth_score"),
        clamp(F.col("annual_volatility") * 1.25, 0, 100).alias("realized_vol_score"), "annual_volatility",
        clamp(50 + (F.col("volatility_20") - F.col("annual_volatility")) * 1.4, 0, 100).alias("volatility_expansion_score"),
        "drawdown_60d", clamp(F.col("drawdown_60d") * 4.2, 0, 100).alias("drawdown_risk_score"),
        F.when(value > 0, clamp((F.log10(value) - 5.2) * 18, 0, 100)).otherwise(20.0).alias("liquidity_score"),
        "volume_ratio", clamp(50 + (F.col("volume_ratio") - 1) * 75, 0, 100).alias("volume_trend_score"),
        F.when((F.col("bar_count") < 3) | (F.coalesce("paired_volume", F.lit(0.0)) <= 0), 50.0).otherwise(clamp(35 + F.col("down_volume") / F.col("paired_volume") * 55 + F.col("down_days") * 20, 0, 100)).alias("downside_volume_pressure"),
        F.when(F.col("high_60") > 0, clamp(82 + (F.col("close") / F.col("high_60") - 1) * 340, 0, 100)).otherwise(50.0).alias("breakout_quality_score"),
        F.when(age > 6, F.least(sure, F.lit(40.0))).when(age > 4, F.least(sure, F.lit(60.0))).otherwise(sure).alias("data_confidence"),
    )


def jump_stats(returns: DataFrame, sigmas: float = 3.0, window: int = 20) -> DataFrame:
    """Per ticker the returns that leave the band of the ``window`` ones before: yearly intensity, mean, deviation, count."""
    w = by_ticker()
    trailing = w.rowsBetween(-window, -1)
    rows = returns.withColumn("at", F.row_number().over(w)).withColumn("mu", F.avg("ret").over(trailing)).withColumn("sd", F.stddev_pop("ret").over(trailing))
    jump = F.when((F.col("at") > window) & (F.col("sd") > 0) & (F.abs(F.col("ret") - F.col("mu")) > sigmas * F.col("sd")), F.col("ret"))
    out = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count(jump).alias("jumps"), F.avg(jump).alias("mean_jump"), F.stddev_pop(jump).alias("jump_vol"))
    enough = F.col("n") >= 30
    zero = lambda x: F.coalesce(F.when(enough, x), F.lit(0.0))
    years = F.greatest((F.col("n") - window) / 252, F.lit(1 / 252))
    return out.select("ticker", F.when(enough, F.col("jumps")).otherwise(0).alias("jumps"), zero(F.col("jumps") / years).alias("intensity"), zero(F.col("mean_jump")).alias("mean_jump"), zero(F.col("jump_vol")).alias("jump_vol"))


def return_ratios(returns: DataFrame, free: float = 0.045, premium: float = 0.055, weight: float = 0.5) -> DataFrame:
    """Per ticker Calmar, information and Sharpe ratios, CAPM return, and a Black-Litterman blend. returns: ticker, date, ret, market."""
    rows = returns.withColumn("run", F.sum("ret").over(by_ticker())).withColumn("peak", F.max("run").over(by_ticker()))
    active = F.col("ret") - F.col("market")
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        safe(F.avg("ret") * 252, F.max(F.col("peak") - F.col("run"))).alias("calmar"),
        safe(F.avg(active), F.stddev_pop(active)).alias("information_ratio"),
        (safe(F.avg(F.col("ret") - free / 252), F.stddev_pop("ret")) * math.sqrt(252)).alias("sharpe"),
        F.coalesce(F.try_divide(F.covar_pop("ret", "market"), F.var_pop("market")), F.lit(1.0)).alias("beta"),
        F.avg("ret").alias("mean"), F.var_pop("ret").alias("own_var"), F.var_pop("market").alias("market_var"),
    )
    out = out.withColumn("capm", free + F.col("beta") * premium)
    prior, view = 1 / (F.col("market_var") * weight), 1 / F.col("own_var")
    return out.withColumn("blended", (prior * F.col("capm") + view * F.col("mean") * 252) / (prior + view)).drop("mean", "own_var", "market_var")
