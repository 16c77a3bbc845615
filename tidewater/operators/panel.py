"""Panel operators: lagged price features, forward labels, cross-sections and their tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import midrank, safe_corr, upper_median

YEAR = math.sqrt(252)


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def by_date():
    return Window.partitionBy("date")


def before(k: int):
    """The k bars before the current one; the current bar is never part of a feature."""
    return by_ticker().rowsBetween(-k, -1)


def price_features(bars: DataFrame, least: int = 252) -> DataFrame:
    """The 35 price features known before each bar that has ``least`` bars before it.

    All windows share one partitioning and order, so there is one shuffle. Returns are of adjusted closes; traded
    value and the price level are of raw ones (raw_close), where the bars have them.
    """
    c = lambda k: F.lag("close", k).over(by_ticker())
    raw = F.coalesce("raw_close", "close") if "raw_close" in bars.columns else F.col("close")
    df = bars.withColumn("raw", raw).withColumn("before", F.lag("close").over(by_ticker()))
    df = df.withColumn("ret", F.when((F.col("before") > 0) & (F.col("close") > 0), F.log(F.col("close") / F.col("before"))))
    df = df.withColumn("simple", F.when(F.col("before") > 0, (F.col("close") / F.col("before") - 1) * 100))
    df = df.withColumn("vol20", F.stddev_pop("ret").over(before(20)) * YEAR)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(1.0))
    mean = lambda name, k: F.avg(name).over(before(k))
    change = lambda k: F.coalesce(F.when(c(1 + k) > 0, (c(1) / c(1 + k) - 1) * 100), F.lit(0.0))
    vol = lambda k: F.stddev_pop("ret").over(before(k)) * YEAR
    peak = lambda k: F.max("close").over(before(k))
    some = lambda x: F.greatest(x, F.lit(1e-8))
    features: dict[str, Column] = {f"momentum_{k}d": change(k) for k in (5, 20, 60, 120, 252)}
    features |= {"reversal_1d": change(1), "reversal_5d": change(5), "volatility_20d": F.col("vol20"), "volatility_60d": vol(60), "volatility_252d": vol(252)}
    features |= {"vol_change_60_20": ratio(F.col("vol20"), vol(60))}
    features |= {"volume_trend_20_60": ratio(mean("volume", 20), mean("volume", 60)), "volume_trend_5_20": ratio(mean("volume", 5), mean("volume", 20))}
    features["volume_zscore_60d"] = F.coalesce(F.try_divide(F.lag("volume").over(by_ticker()) - mean("volume", 60), F.stddev_pop("volume").over(before(60))), F.lit(0.0))
    traded = F.col("volume") * F.col("raw")
    features["amihud_illiquidity_20d"] = F.coalesce(F.avg(F.when(traded > 0, F.abs("ret") / traded)).over(before(20)) * 1e8, F.lit(0.0))
    features |= {"price_to_high_60d": c(1) / some(peak(60)), "price_to_low_60d": c(1) / some(F.min("close").over(before(60))), "price_to_high_252d": c(1) / some(peak(252))}
    features |= {"sma_50_distance": c(1) / some(mean("close", 50)) - 1, "sma_200_distance": c(1) / some(mean("close", 200)) - 1}
    features |= {"sma_50_over_200": ratio(mean("close", 50), mean("close", 200)) - 1, "last_close_over_sma_20": c(1) / some(mean("close", 20)) - 1}
    features |= {f"drawdown_{k}d": F.coalesce(F.try_divide(c(1) - peak(k), peak(k)), F.lit(0.0)) for k in (60, 252)}
    for k in (60, 252):
        features |= {f"skew_{k}d": F.coalesce(F.skewness("ret").over(before(k)), F.lit(0.0)), f"kurt_{k}d": F.coalesce(F.kurtosis("ret").over(before(k)), F.lit(0.0))}
    features["range_compression_20d"] = F.sum(F.when(F.col("close") > 0, (F.col("high") - F.col("low")) / F.col("close"))).over(before(20)) / 20
    features["price_velocity_acceleration"] = change(20) / 20 - change(60) / 60
    features["max_daily_ret_21d"] = F.greatest(F.lit(0.0), F.max("simple").over(before(21)))
    features["downside_vol_60d"] = F.sqrt(F.coalesce(F.avg(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret"))).over(before(60)), F.lit(0.0))) * YEAR
    vols = F.array(F.col("vol20"), *[F.lag("vol20", k).over(by_ticker()) for k in range(5, 41, 5)])
    level = F.aggregate(vols, F.lit(0.0), lambda acc, x: acc + x) / F.size(vols)
    features["vol_of_vol_60d"] = F.coalesce(F.sqrt(F.aggregate(vols, F.lit(0.0), lambda acc, x: acc + (x - level) * (x - level)) / F.size(vols)), F.lit(0.0))
    since = F.datediff("date", F.min("date").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))
    features["listing_age_years"] = F.least(F.lit(25.0), F.greatest(F.lit(0.0), since / 365.25))
    features["log_price_level"] = F.log(F.greatest(F.lit(0.01), F.lag("raw").over(by_ticker())))
    n_before = F.row_number().over(by_ticker()) - 1
    rows = df.withColumn("n_before", n_before).select("ticker", "date", "n_before", c(1).alias("last"), *[e.alias(n) for n, e in features.items()])
    return rows.filter((F.col("n_before") >= least) & (F.col("last") > 0)).drop("last")


def forward_labels(bars: DataFrame, horizons=(5, 20, 60, 120)) -> DataFrame:
    """k-bar forward returns in percent, and the date on which each label is known; null off the end."""
    at = lambda name, k: F.lead(name, k).over(by_ticker())
    cols = [e for k in horizons for e in (((at("close", k) / F.col("close") - 1) * 100).alias(f"fwd_{k}d"), at("date", k).alias(f"label_end_{k}d"))]
    return bars.select("ticker", "date", *cols)


def demeaned(df: DataFrame, value: str, out: str, least: int = 5) -> DataFrame:
    """value less its date's mean where the date has enough names, else unchanged."""
    return df.withColumn(out, F.when(F.count(value).over(by_date()) >= least, F.col(value) - F.avg(value).over(by_date())).otherwise(F.col(value)))


def zscored(df: DataFrame, value: str, out: str, least: int = 5) -> DataFrame:
    """Per-date z with a floor under sigma. Sparse dates use all rows up to and including the date.

    The expanding moments come from one row a date, so no window holds the panel.
    """
    sums = df.groupBy("date").agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({f"all_{c}": F.sum(c).over(upto) for c in ("n", "s", "ss")})
    level = F.try_divide("all_s", "all_n")
    wide = F.sqrt(F.greatest(F.try_divide("all_ss", "all_n") - level * level, F.lit(0.0)))
    own = F.col("n") >= least
    moments = sums.select("date", F.when(own, F.col("mean")).otherwise(level).alias("mu"), F.greatest(F.when(own, F.col("std")).otherwise(wide), F.lit(1e-6)).alias("sigma"))
    return df.join(moments, "date").withColumn(out, (F.col(value) - F.col("mu")) / F.col("sigma")).drop("mu", "sigma")


def information_coefficients(panel: DataFrame, score: str, label: str, least: int = 5) -> DataFrame:
    """Per-date Pearson and rank correlation of score and label."""
    rows = panel.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    average = lambda c: F.rank().over(by_date().orderBy(c)) + (F.count(F.lit(1)).over(by_date().orderBy(c).rangeBetween(0, 0)) - 1) / 2
    rows = rows.withColumn("rank_score", average(score)).withColumn("rank_label", average(label))
    out = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), safe_corr(score, label).alias("ic"), safe_corr("rank_score", "rank_label").alias("rank_ic"))
    return out.filter(F.col("n") >= least)


def quintile_spreads(panel: DataFrame, score: str, label: str, least: int = 5) -> DataFrame:
    """Per date the mean label of the top fifth less that of the bottom fifth (floor(n / 5) names, one at least)."""
    rows = panel.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    n = F.count(F.lit(1)).over(by_date())
    place = F.row_number().over(by_date().orderBy(score, "ticker"))
    rows = rows.withColumn("n", n).withColumn("place", place).filter(F.col("n") >= least).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    top, low = F.when(F.col("place") > F.col("n") - F.col("k"), F.col(label)), F.when(F.col("place") <= F.col("k"), F.col(label))
    return rows.groupBy("date").agg(F.avg(top).alias("top"), F.avg(low).alias("bottom"), (F.avg(top) - F.avg(low)).alias("spread"))


def percentiles(panel: DataFrame, score: str, out: str = "percentile") -> DataFrame:
    return panel.filter(F.col(score).isNotNull()).withColumn(out, midrank(score, by_date()))


def neutral_ranks(panel: DataFrame, values: list[str], least: int) -> DataFrame:
    """Per date the MIDRANK percentile of each value as ``<value>_rank``; 50 without a value or with too few names."""
    ranks = {}
    for v in values:
        has = Window.partitionBy("date", F.col(v).isNull())
        ranks[f"{v}_rank"] = F.when(F.col(v).isNotNull() & (F.count(v).over(by_date()) >= least), midrank(v, has)).otherwise(50.0)
    return panel.withColumns(ranks)


#: Buckets of a feature's values among which a pooled median is looked for first.
BUCKETS = 256


def imputed(panel: DataFrame, values: list[str]) -> DataFrame:
    """Missing values by their date's upper median, else by that of all values up to and including the date; 0 without any.

    ``<value>_imputed`` tells which. All values are told as rows once. Those earlier ones of dates that have none of their
    own are counted by bucket and running over these dates, so that only the bucket that holds the median is ordered;
    equal values are one row with a count. Rows without a date get 0.
    """
    each = F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("x")) for v in values])
    long = panel.filter("date is not null").select("date", F.explode(each).alias("f")).select("date", "f.*")
    own = long.groupBy("feature", "date").agg(upper_median(F.collect_list("x")).alias("own"))
    backwards = Window.partitionBy("feature").orderBy(F.desc("date"))
    # the first date without values that a row's date comes up to; rows behind the last one are in no pool
    entry = own.withColumn("gap", F.last(F.when(F.col("own").isNull(), F.col("date")), ignorenulls=True).over(backwards)).filter("gap is not null").select("feature", "date", "gap")
    cells = long.filter("x is not null").join(entry, ["feature", "date"]).groupBy("feature", "gap", "x").agg(F.count(F.lit(1)).alias("n"))
    edges = cells.groupBy("feature").agg(F.percentile_approx("x", [k / BUCKETS for k in range(1, BUCKETS)]).alias("edges"))
    # a row a feature, and these are named in the call
    cells = cells.join(F.broadcast(edges), "feature").withColumn("bucket", F.size(F.filter("edges", lambda e: e <= F.col("x")))).drop("edges")
    counts = cells.groupBy("feature", "gap", "bucket").agg(F.sum("n").alias("n"))
    grid = own.filter("own is null").select("feature", F.col("date").alias("gap"), F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"))
    running = Window.partitionBy("feature", "bucket").orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    held = grid.join(counts, ["feature", "gap", "bucket"], "left").withColumn("held", F.coalesce(F.sum("n").over(running), F.lit(0)))
    of_gap = Window.partitionBy("feature", "gap")
    held = held.withColumns({"upto": F.sum("held").over(of_gap.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "place": F.floor(F.sum("held").over(of_gap) / 2)})
    crosses = lambda upto, n, place: (F.col(upto) > F.col(place)) & (F.col(upto) - F.col(n) <= F.col(place))
    chosen = held.filter(crosses("upto", "held", "place")).select("feature", "bucket", F.col("gap").alias("date"), (F.col("place") - F.col("upto") + F.col("held")).alias("rest"))
    near = cells.join(chosen, ["feature", "bucket"]).filter(F.col("gap") <= F.col("date")).groupBy("feature", "date", "rest", "x").agg(F.sum("n").alias("n"))
    near = near.withColumn("upto", F.sum("n").over(Window.partitionBy("feature", "date").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    pooled = near.filter(crosses("upto", "n", "rest")).select("feature", "date", F.col("x").alias("pooled"))
    fills = own.join(pooled, ["feature", "date"], "left").groupBy("date").agg(*[F.max(F.when(F.col("feature") == v, F.coalesce("own", "pooled"))).alias(f"_fill_{v}") for v in values])
    rows = panel.join(fills, "date", "left")
    rows = rows.withColumns({f"{v}_imputed": F.col(v).isNull() for v in values})
    return rows.withColumns({v: F.coalesce(v, f"_fill_{v}", F.lit(0.0)) for v in values}).drop(*[f"_fill_{v}" for v in values])


def survivorship_cohorts(panel: DataFrame, cap: str, age: str, observed: str, young: float = 3.0, counted: str | None = None) -> DataFrame:
    """cohort: noFundamentals, survivorPrivileged (young, or in the date's lowest fifth of observed caps), core.

    The fifth is of the observed names with a cap, or of those that ``counted`` tells, where a missing cap stands last. A cut
    is the cap of one of the rows held against it: read from the panel twice, a cap summed in another order is not the same.
    """
    rows = panel.withColumn("_counted", F.coalesce(F.col(counted) if counted else F.col(observed) & F.col(cap).isNotNull(), F.lit(False)))
    place = F.row_number().over(by_date().orderBy(F.desc("_counted"), F.asc_nulls_last(cap)))
    rows = rows.withColumns({"_place": place, "_n": F.count_if("_counted").over(by_date())})
    at_cut = F.col("_counted") & (F.col("_n") >= 10) & (F.col("_place") == F.floor(F.col("_n") * 0.2) + 1)
    rows = rows.withColumn("_cut", F.max(F.when(at_cut, F.col(cap))).over(by_date()))
    small = F.coalesce(F.col(cap) <= F.col("_cut"), F.lit(False))
    cohort = F.when(~F.col(observed), "noFundamentals").when((F.col(age) < young) | small, "survivorPrivileged").otherwise("core")
    return rows.withColumn("cohort", cohort).drop("_counted", "_place", "_n", "_cut")


def ordinal_correlations(panel: DataFrame, score: str, label: str, least: int = 5) -> DataFrame:
    """Per date the correlation of ordinal ranks, ties in the order of tickers."""
    rows = panel.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    rank = lambda x: F.row_number().over(by_date().orderBy(x, "ticker"))
    rows = rows.withColumn("r_score", rank(score)).withColumn("r_label", rank(label))
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), safe_corr("r_score", "r_label").alias("rank_ic")).filter(F.col("n") >= least)


def batch_normalized(panel: DataFrame, value: str, out: str, mean: float, std: float, least: int = 5) -> DataFrame:
    """z within each date with missing values at the date's upper median; by frozen moments on small dates or where all is missing."""
    dates = panel.groupBy("date").agg(F.count(F.lit(1)).alias("n_names"), F.collect_list(value).alias("known")).withColumn("median", upper_median(F.col("known")))
    # one list a date, told by three numbers: those without a value stand at the median
    filled = F.concat("known", F.array_repeat("median", F.col("n_names").cast("int") - F.size("known")))
    total = lambda f: F.aggregate(filled, F.lit(0.0), lambda acc, x: acc + f(x))
    dates = dates.withColumn("level", total(lambda x: x) / F.col("n_names"))
    dates = dates.withColumn("wide", F.greatest(F.sqrt(total(lambda x: F.pow(x - F.col("level"), 2.0)) / F.col("n_names")), F.lit(1e-6))).drop("known")
    rows = panel.join(dates, panel["date"].eqNullSafe(dates["date"]), "left").drop(dates["date"])
    frozen = (F.coalesce(F.col(value), F.lit(mean)) - mean) / max(1e-12, std)
    z = F.when((F.col("n_names") < least) | F.col("median").isNull(), frozen).otherwise((F.coalesce(value, "median") - F.col("level")) / F.col("wide"))
    return rows.withColumn(out, z).drop("n_names", "median", "level", "wide")


def feature_sharpes(panel: DataFrame, values: list[str], label: str, least: int = 10, dates: int = 5) -> DataFrame:
    """feature, n_dates, sharpe: mean over deviation of the per-date spread between its top and bottom fifths."""
    long = panel.select("date", "ticker", label, F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).alias("x")) for v in values])).alias("f")).select("date", "ticker", label, "f.*")
    of = Window.partitionBy("feature", "date")
    long = long.filter(F.col("x").isNotNull() & F.col(label).isNotNull()).withColumn("n", F.count(F.lit(1)).over(of)).withColumn("at", F.row_number().over(of.orderBy("x", "ticker")))
    long = long.filter(F.col("n") >= least).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    spread = F.avg(F.when(F.col("at") > F.col("n") - F.col("k"), F.col(label))) - F.avg(F.when(F.col("at") <= F.col("k"), F.col(label)))
    each = long.groupBy("feature", "date").agg(spread.alias("spread"))
    out = each.groupBy("feature").agg(F.count(F.lit(1)).alias("n_dates"), F.coalesce(F.try_divide(F.avg("spread"), F.stddev_pop("spread")), F.lit(0.0)).alias("sharpe"))
    return out.filter(F.col("n_dates") >= dates)
