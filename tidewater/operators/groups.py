"""Groups of names with a fallback to the market: sector-adjusted ranks, benchmarks, breadth, and cohorts by correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, midrank

#: Names a sector needs for ranks of its own, and the confidence from which metrics count for the market.
LEAST_NAMES, LEAST_CONFIDENCE = 8, 45
#: Points a percent over the benchmark in 60 and in 20 bars.
STRENGTH = {60: 1.65, 20: 1.05}


def sector_adjusted_ranks(rows: DataFrame, value: str, sector: str, by: list[str], least: int = LEAST_NAMES) -> DataFrame:
    """Percentile of the value in its cross-section, averaged with that in its sector where the sector has enough names: ``rank``.

    A null value has no rank and counts nowhere; a null sector is one of its own. by: what makes a cross-section.
    """
    known = F.col(value).isNotNull()
    rows = rows.withColumn("_known", known).withColumn("_sector", F.coalesce(sector, F.lit("Unknown")))
    market, inner = Window.partitionBy(*by, "_known"), Window.partitionBy(*by, "_known", "_sector")
    wide = midrank(F.col(value), market)
    own = F.when(F.count(F.lit(1)).over(inner) >= least, midrank(F.col(value), inner))
    rank = F.coalesce((own + wide) / 2, wide)
    return rows.withColumn("rank", F.when(F.col("_known"), rank)).drop("_known", "_sector")


def relative_strength(metrics: DataFrame, sectors: DataFrame, benchmarks: dict[str, str], market: tuple[str, ...]) -> DataFrame:
    """Each name's strength against its sector's benchmark: benchmark, relative_strength_score.

    The benchmark is the sector's own, if it has metrics, else the first of ``market`` that has; without any the score is
    the trend of 60 bars. Missing returns are 0. metrics: ticker, return_20d, return_60d, trend_60_score, one row a ticker.
    sectors: ticker, sector. benchmarks is a table of configuration, a sector a row.
    """
    spark = metrics.sparkSession
    own = [(s, t, 0) for s, t in benchmarks.items()]
    wanted = own + [(s, t, i) for s in [*benchmarks, None] for i, t in enumerate(market, 1)]
    wanted = spark.createDataFrame(wanted, "sector string, ticker string, place int")
    found = wanted.join(metrics.select("ticker", *[F.col(f"return_{k}d").alias(f"bench_{k}") for k in STRENGTH]), "ticker")
    first = found.groupBy("sector").agg(F.min_by(F.struct(F.col("ticker").alias("benchmark"), *[f"bench_{k}" for k in STRENGTH]), "place").alias("b"))
    # names whose sector has no row meet the one without a sector
    known = F.when(F.col("sector").isin(*benchmarks), F.col("sector"))
    rows = metrics.join(sectors, "ticker", "left").withColumn("_sector", known).join(first.withColumnRenamed("sector", "_first"), F.col("_sector").eqNullSafe(F.col("_first")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = F.lit(50.0)
    for k, by in STRENGTH.items():
        score = score + (zero(f"return_{k}d") - zero(f"b.bench_{k}")) * by
    score = F.when(F.col("b").isNull(), F.col("trend_60_score")).otherwise(clamp(score, 0, 100))
    return rows.select(*metrics.columns, "sector", F.col("b.benchmark").alias("benchmark"), score.alias("relative_strength_score"))


def breadth(metrics: DataFrame, sectors: DataFrame) -> DataFrame:
    """Mean breadth by sector, and in the row without a sector that of the market with its volatility, over names of enough confidence.

    metrics: ticker, breadth_score, realized_vol_score, data_confidence. A market without such names has 0.
    """
    by_sector = metrics.join(sectors.filter("sector is not null"), "ticker").groupBy("sector").agg(F.count("*").alias("names"), F.avg("breadth_score").alias("breadth"))
    sure = metrics.filter(F.col("data_confidence") >= LEAST_CONFIDENCE)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    whole = sure.agg(F.lit(None).cast("string").alias("sector"), F.count("*").alias("names"), mean("breadth_score").alias("breadth"), mean("realized_vol_score").alias("volatility"))
    return whole.unionByName(by_sector, allowMissingColumns=True)


def cohorts(rows: DataFrame, cluster: str, ticker: str, sector: str, strength: str, concentrated: float = 65.0) -> DataFrame:
    """Clusters of two or more names, with one row a cluster: its label, names in order, mean strength and whether it is concentrated.

    Rows without a cluster (null or empty) are in none. The tickers are one array a cluster, as a report shows them.
    """
    kept = rows.filter(F.coalesce(F.col(cluster), F.lit("")) != "")
    out = kept.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("names"), F.array_sort(F.collect_list(ticker)).alias("tickers"), F.avg(strength).alias("strength"), F.min(sector).alias("low"), F.max(sector).alias("high"), F.count(sector).alias("told")
    )
    same = (F.col("low") == F.col("high")) & (F.col("told") == F.col("names"))
    label = F.concat(F.when(same, F.lower("low")).otherwise("cross-sector"), F.lit(" cohort ("), "cluster", F.lit(")"))
    return out.filter("names >= 2").select("cluster", label.alias("label"), "names", "tickers", "strength", (F.col("strength") >= concentrated).alias("concentrated"))
