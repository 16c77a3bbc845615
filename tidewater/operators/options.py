"""Implied volatility, the distribution that prices tell of, and rules on option prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bsm, col, inverse_normal_cdf

#: Volatilities between which a price's own is searched, and halvings of that range.
LOW, HIGH, HALVINGS = 0.001, 5.0, 60


def implied_volatility(price, kind, spot, strike, years, rate, dividend=0.0) -> Column:
    """The volatility at which a call or put has the price; null without a positive price or time.

    A price grows with volatility, so the range is halved on the side where it lies; a price beyond both ends gives the end.
    """
    price, kind, spot, strike, years, rate, dividend = col(price), col(kind), *map(col, (spot, strike, years, rate, dividend))

    def halved(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        at = bsm(spot, strike, years, rate, middle, dividend)
        under = F.when(kind == "call", at["call"]).otherwise(at["put"]) < price
        return F.struct(F.when(under, middle).otherwise(acc["low"]).alias("low"), F.when(under, acc["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(LOW).alias("low"), F.lit(HIGH).alias("high")), halved, lambda acc: (acc["low"] + acc["high"]) / 2)
    return F.when((price > 0) & (years > 0) & (spot > 0) & (strike > 0), found)


def return_distribution(rows: DataFrame, spot: str, rate, dividend, vol: str, years: str, quantiles=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Each row once for each quantile of its log-normal end price: quantile, price, return_pct."""
    rate, dividend, v, t = map(col, (rate, dividend, vol, years))
    rows = rows.withColumn("quantile", F.explode(F.array(*map(F.lit, quantiles))))
    end = F.col(spot) * F.exp((rate - dividend - v * v / 2) * t + v * F.sqrt(t) * inverse_normal_cdf(F.col("quantile")))
    return rows.withColumn("price", end).withColumn("return_pct", (F.col("price") / F.col(spot) - 1) * 100)


def premium_flags(rows: DataFrame, implied: str, forecast: str, rich: float = 1.3, cheap: float = 0.85) -> DataFrame:
    """Rows whose implied volatility is rich or cheap against the forecast: ``side`` and ``score`` (100 at most).

    A missing or zero volatility on either side gives no flag.
    """
    ratio = F.try_divide(F.col(implied), F.col(forecast))
    side = F.when(ratio > rich, "sell premium").when(ratio < cheap, "buy premium")
    flagged = rows.filter(F.col(implied) > 0).withColumn("iv_rv", ratio).withColumn("side", side).filter("side is not null")
    return flagged.withColumn("score", F.least(F.lit(100.0), F.abs(F.col("iv_rv") - 1) * 100))
