"""Column expressions: clamps, safe statistics, ranks, normal distribution, option pricing."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def clamp(x, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(float(low))), F.lit(float(high)))


def js_round(x) -> Column:
    """Half up, towards plus infinity."""
    return F.floor(col(x) + 0.5)


def safe_corr(x, y) -> Column:
    """Pearson correlation; 0 where either side has no variance."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def midrank(value, over: WindowSpec) -> Column:
    """Percentile with average ranks of ties, 0 to 100; 50 for a single value. over: the partition only."""
    n = F.count(value).over(over)
    low = F.rank().over(over.orderBy(value)) - 1
    ties = F.count(F.lit(1)).over(over.orderBy(value).rangeBetween(0, 0))
    return F.when(n <= 1, F.lit(50.0)).otherwise((low + (ties - 1) / 2) / (n - 1) * 100)


def upper_median(values: Column) -> Column:
    """Element floor(n / 2) of the sorted values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


# Abramowitz and Stegun, formula 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# Abramowitz and Stegun, formula 26.2.17.
POLY_P = 0.2316419
POLY_B = (0.31938153, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
# Acklam's rational approximation of the inverse normal distribution.
INV_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
INV_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
INV_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
INV_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
INV_LOW = 0.02425


def horner(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def erf(x) -> Column:
    x = col(x)
    t = 1 / (1 + ERF_P * F.abs(x))
    return F.signum(x) * (1 - horner(t, ERF_A[::-1]) * t * F.exp(-x * x))


def normal_cdf(z) -> Column:
    return 0.5 * (1 + erf(col(z) / math.sqrt(2)))


def scorer_cdf(z) -> Column:
    """The distribution as the decision scores use it: 1e-7 off normal_cdf."""
    z = col(z)
    t = 1 / (1 + POLY_P * F.abs(z))
    upper = normal_pdf(z) * horner(t, POLY_B[::-1]) * t
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def normal_pdf(z) -> Column:
    return F.exp(-col(z) * col(z) / 2) / math.sqrt(2 * math.pi)


def inverse_normal_cdf(p) -> Column:
    p = col(p)

    def tail(of: Column) -> Column:
        q = F.sqrt(-2 * F.log(of))
        return horner(q, INV_C) / horner(q, INV_D)

    q = p - 0.5
    middle = horner(q * q, INV_A) * q / horner(q * q, INV_B)
    inf = F.lit(float("inf"))
    return F.when(p <= 0, -inf).when(p >= 1, inf).when(p < INV_LOW, tail(p)).when(p > 1 - INV_LOW, -tail(1 - p)).otherwise(middle)


def bsm(spot, strike, years, rate, vol, dividend=0.0) -> dict[str, Column]:
    """Black-Scholes-Merton prices and greeks; vega and rho per 1 %, theta per calendar day."""
    s, k, t, r, v, q = map(col, (spot, strike, years, rate, vol, dividend))
    d1 = (F.log(s / k) + (r - q + v * v / 2) * t) / (v * F.sqrt(t))
    d2 = d1 - v * F.sqrt(t)
    grow, fall = F.exp(-q * t), F.exp(-r * t)
    decay = -s * normal_pdf(d1) * v * grow / (2 * F.sqrt(t))
    return {
        "call": s * grow * normal_cdf(d1) - k * fall * normal_cdf(d2),
        "put": k * fall * normal_cdf(-d2) - s * grow * normal_cdf(-d1),
        "call_delta": grow * normal_cdf(d1),
        "put_delta": grow * (normal_cdf(d1) - 1),
        "gamma": grow * normal_pdf(d1) / (s * v * F.sqrt(t)),
        "vega": s * grow * normal_pdf(d1) * F.sqrt(t) / 100,
        "call_theta": (decay - r * k * fall * normal_cdf(d2) + q * s * grow * normal_cdf(d1)) / 365,
        "put_theta": (decay + r * k * fall * normal_cdf(-d2) - q * s * grow * normal_cdf(-d1)) / 365,
        "call_rho": k * t * fall * normal_cdf(d2) / 100,
        "put_rho": -k * t * fall * normal_cdf(-d2) / 100,
        "prob_above": normal_cdf(d2),
        "prob_below": 1 - normal_cdf(d2),
    }


def probabilistic_sharpe(sharpe, n, skew, excess_kurtosis, against=0.0) -> Column:
    sharpe, n, skew, kurt, against = map(col, (sharpe, n, skew, excess_kurtosis, against))
    spread = F.sqrt(1 - skew * sharpe + (kurt + 2) / 4 * sharpe * sharpe)
    return normal_cdf((sharpe - against) * F.sqrt(n - 1) / spread)


def expected_max_sharpe(trials, variance) -> Column:
    """The largest Sharpe ratio to expect of so many trials without skill."""
    n, gamma = col(trials), 0.5772156649015329
    return F.sqrt(col(variance)) * ((1 - gamma) * inverse_normal_cdf(1 - 1 / n) + gamma * inverse_normal_cdf(1 - 1 / (n * math.e)))


def kelly(mean, variance, rate=0.045) -> Column:
    return clamp(F.coalesce(F.try_divide(col(mean) - col(rate), col(variance)), F.lit(0.0)), 0, 1)
