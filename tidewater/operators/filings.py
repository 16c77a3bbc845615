"""Figures from periodic filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.columns import clamp
from .joins import asof_join


def trailing(periods: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """``ttm``: the sum of the last four periods (null with fewer); ``yoy_pct``: the change on four periods before."""
    order = Window.partitionBy(key).orderBy(period)
    last4 = order.rowsBetween(-3, 0)
    change = (F.try_divide(F.col(value), F.lag(value, 4).over(order)) - 1) * 100
    return periods.withColumns({"ttm": F.when(F.count(F.lit(1)).over(last4) == 4, F.sum(value).over(last4)), "yoy_pct": change})


# Concepts whose filings make a snapshot, others that it reads, and the features with their bounds.
DATED = ("revenue", "netIncome", "operatingCashFlow", "assets", "equity", "shares")
CONCEPTS = (*DATED, "capex", "liabilities", "currentAssets", "currentLiabilities", "retainedEarnings", "operatingIncome", "shortTermDebt", "longTermDebt")
BOUNDS = {
    "fund_revenue_growth_yoy": (-100, 300), "fund_revenue_accel": (-100, 100), "fund_net_margin": (-100, 100), "fund_margin_trend": (-50, 50),
    "fund_fcf_margin": (-100, 100), "fund_leverage": (0, 200), "fund_roe": (-150, 150), "fund_share_change_yoy": (-50, 50), "fund_earnings_yield": (-25, 25),
    "fund_filing_age": (0, 400), "fund_log_market_cap": (10, 32), "fund_altman_z": (-15, 15), "fund_naive_dd": (-5, 15),
}


def _last(rows: Column) -> Column:
    return F.get(rows, F.size(rows) - 1)


def _nearest_value(rows: Column, day: Column, days: int) -> Column:
    """Value of the period that ends nearest the day, at most so many days off; the earlier of two."""
    gap = lambda r: F.abs(F.datediff(r["until"], day))
    near = F.filter(rows, lambda r: gap(r) <= days)
    return F.array_min(F.transform(near, lambda r: F.struct(gap(r).alias("gap"), r["until"].alias("until"), r["value"].alias("value"))))["value"]


def ttm(years: Column, quarters: Column) -> Column:
    """Twelve months of a flow from arrays of its annual and quarterly periods, each ordered by end.

    The last year plus later quarters less the same quarters of the year before; without a year, or where such a
    quarter is missing, four quarters that span 240 to 320 days from first to last end; else the last year as it is.
    """
    year, last4 = _last(years), F.slice(quarters, -4, 4)
    later = F.filter(quarters, lambda r: r["until"] > year["until"])
    change = F.aggregate(later, F.lit(0.0), lambda acc, r: acc + r["value"] - _nearest_value(quarters, scalars.shift_months(r["until"], -12), 21))
    days = F.datediff(F.get(last4, F.lit(3))["until"], F.get(last4, F.lit(0))["until"])
    four = F.when((F.size(quarters) >= 4) & days.between(240, 320), F.aggregate(last4, F.lit(0.0), lambda acc, r: acc + r["value"]))
    return F.when(year.isNull(), four).otherwise(F.coalesce(year["value"] + change, four, year["value"]))


def snapshots(facts: DataFrame) -> DataFrame:
    """What was known of a symbol on each of its filing dates: one row per symbol and ``known``.

    facts: symbol, concept, since (null for instants), until, filed, value, span. A fact holds from its filing to the
    next filing of the same period, so a restatement counts from its own date on; equal filings count once, with the
    least value. Facts without end, filing date or value are left out. All steps share one shuffle by symbol; a
    symbol's facts are a few thousand rows.
    """
    rows = facts.filter("until is not null and filed is not null and value is not null and not isnan(value)").filter(F.col("concept").isin(*CONCEPTS)).repartition("symbol")
    rows = rows.groupBy("symbol", "concept", "since", "until", "filed").agg(F.min(F.struct("value", "span")).alias("v")).select("symbol", "concept", "since", "until", "filed", "v.*")
    rows = rows.withColumn("replaced", F.lead("filed").over(Window.partitionBy("symbol", "concept", "since", "until").orderBy("filed")))
    fact = F.struct("until", "since", "filed", "replaced", "value", "span")
    lists = {c: F.array_sort(F.collect_list(F.when(F.col("concept") == c, fact))).alias(f"{c}_rows") for c in CONCEPTS}
    dates = F.collect_set(F.when(F.col("concept").isin(*DATED), F.col("filed")))
    held = rows.groupBy("symbol").agg(dates.alias("dates"), *lists.values()).select("symbol", F.explode("dates").alias("known"), *[f"{c}_rows" for c in CONCEPTS])
    seen = lambda c: F.filter(f"{c}_rows", lambda r: (r["filed"] <= F.col("known")) & (r["replaced"].isNull() | (r["replaced"] > F.col("known"))))
    held = held.withColumns({f"{c}_rows": seen(c) for c in CONCEPTS}).withColumn("end", _last(F.col("revenue_rows"))["until"])
    year, lag = scalars.shift_months("end", -12), scalars.shift_months("end", -3)
    held = held.withColumns({"year": year, "lag": lag}).withColumn("lag_year", scalars.shift_months("lag", -12))
    flows = {"revenue": ("revenue", None), "revenue_before": ("revenue", "year"), "revenue_lag": ("revenue", "lag"), "revenue_lag_before": ("revenue", "lag_year"), "income": ("netIncome", None), "income_before": ("netIncome", "year"), "cash": ("operatingCashFlow", None), "spent": ("capex", None), "operating": ("operatingIncome", None)}
    instants = [c for c in CONCEPTS if c not in ("revenue", "netIncome", "operatingCashFlow", "capex", "operatingIncome")]
    shares = _last(F.col("shares_rows"))
    then = _nearest_value(F.col("shares_rows"), scalars.shift_months(shares["until"], -12), 100)
    change = F.when((shares["value"] > 0) & (then > 0), (shares["value"] / then - 1) * 100)
    of = lambda c, span, upto: F.filter(f"{c}_rows", lambda r: (r["span"] == span) & (r["until"] <= F.col(upto)) if upto else r["span"] == span)
    held = held.withColumns({f"{n}_{span}": of(c, span, upto) for n, (c, upto) in flows.items() for span in ("annual", "quarter")})
    held = held.select("symbol", "known", *[ttm(F.col(f"{n}_annual"), F.col(f"{n}_quarter")).alias(f"ttm_{n}") for n in flows], *[_last(F.col(f"{c}_rows"))["value"].alias(c) for c in instants], change.alias("share_change_yoy"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100)
    growth = part("ttm_revenue", "ttm_revenue_before") - 100
    held = held.withColumns({
        "revenue_growth_yoy": growth,
        "revenue_accel": growth - (part("ttm_revenue_lag", "ttm_revenue_lag_before") - 100),
        "net_margin": part("ttm_income", "ttm_revenue"),
        "margin_trend": part("ttm_income", "ttm_revenue") - part("ttm_income_before", "ttm_revenue_before"),
        "fcf_margin": F.when(F.col("ttm_revenue") > 0, (F.col("ttm_cash") - F.abs(F.coalesce("ttm_spent", F.lit(0.0)))) / F.col("ttm_revenue") * 100),
        "leverage": part("liabilities", "assets"),
        "roe": part("ttm_income", "equity"),
    })
    return held.drop("ttm_revenue_before", "ttm_revenue_lag", "ttm_revenue_lag_before", "ttm_income_before", "ttm_cash", "ttm_spent")


def fund_features(prices: DataFrame, known: DataFrame) -> DataFrame:
    """The 13 fundamental features of each ticker and date, from the last snapshot filed before the date.

    prices: ticker, date, last_close, volatility (a year's, as a fraction), change (a year's, in percent). Without a
    snapshot all are null but the filing age, which is at its bound.
    """
    carried = [c for c in known.columns if c not in ("symbol", "known")]
    rows = asof_join(prices, known.withColumnRenamed("symbol", "ticker"), "ticker", "date", "known", carried)
    s = lambda c: F.col(f"asof.{c}")
    rows = rows.withColumn("cap", F.when((s("shares") > 0) & (F.col("last_close") > 0), s("shares") * F.col("last_close")))
    owed = F.when(s("shortTermDebt").isNotNull() | s("longTermDebt").isNotNull(), F.coalesce(s("shortTermDebt"), F.lit(0.0)) + 0.5 * F.coalesce(s("longTermDebt"), F.lit(0.0)))
    own = F.greatest(F.lit(0.05), F.col("volatility"))
    rows = rows.withColumns({"owed": owed, "own": own}).withColumn("sigma", (F.col("cap") * F.col("own") + F.col("owed") * (0.05 + 0.25 * F.col("own"))) / (F.col("cap") + F.col("owed")))
    distance = (F.log((F.col("cap") + F.col("owed")) / F.col("owed")) + F.col("change") / 100 - F.col("sigma") * F.col("sigma") / 2) / F.col("sigma")
    altman = 6.56 * (s("currentAssets") - s("currentLiabilities")) / s("assets") + 3.26 * s("retainedEarnings") / s("assets") + 6.72 * s("ttm_operating") / s("assets") + 1.05 * s("equity") / s("liabilities")
    values = {f"fund_{c}": s(c) for c in ("revenue_growth_yoy", "revenue_accel", "net_margin", "margin_trend", "fcf_margin", "leverage", "roe", "share_change_yoy")}
    values |= {
        "fund_earnings_yield": s("ttm_income") / F.col("cap") * 100,
        "fund_filing_age": F.coalesce(F.datediff("date", s("asof_time")), F.lit(400)).cast("double"),
        "fund_log_market_cap": F.log("cap"),
        "fund_altman_z": F.when((s("assets") > 0) & (s("liabilities") > 0), altman),
        "fund_naive_dd": F.when(F.col("cap").isNotNull(), F.when(F.col("owed") > 0, distance).when(F.col("owed").isNotNull(), 15.0)),
    }
    return rows.select("ticker", "date", *[F.when(v.isNotNull(), clamp(v, *BOUNDS[n])).alias(n) for n, v in values.items()])
