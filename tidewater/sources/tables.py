"""Tables of the market domain: daily bars from trades, facts from orders, and parsers of raw formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHART = (
    "chart STRUCT<result ARRAY<STRUCT<timestamp ARRAY<BIGINT>, indicators STRUCT<"
    "quote ARRAY<STRUCT<open ARRAY<DOUBLE>, high ARRAY<DOUBLE>, low ARRAY<DOUBLE>, close ARRAY<DOUBLE>, volume ARRAY<DOUBLE>>>,"
    "adjclose ARRAY<STRUCT<adjclose ARRAY<DOUBLE>>>>>>, error STRING>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, close (volume-weighted), high, low, volume: trades of a brand by ship date."""
    trades = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        trades.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"))
        .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), F.sum("l_quantity").alias("volume"))
    )


def chart_rows(raw: DataFrame) -> DataFrame:
    """Every row of chart JSON (ticker, json) with its status: unordered, invalid, unadjusted or ok.

    unordered: some time of the series is missing or not after the one before, which rejects all of it. invalid: a price
    missing, not positive or inconsistent, or the volume missing or negative. unadjusted: no positive adjusted close.
    """
    # exploded as an array of one, which keeps the parser from being run anew for each use
    parsed = raw.select("ticker", F.explode(F.array(F.get(F.from_json("json", CHART)["chart"]["result"], F.lit(0)))).alias("r"))
    times, quote, adjusted = F.col("r.timestamp"), F.get("r.indicators.quote", F.lit(0)), F.get("r.indicators.adjclose", F.lit(0))
    ascends = F.forall(F.sequence(F.lit(0), F.size(times) - 1), lambda i: F.coalesce((i == 0) & F.get(times, i).isNotNull() | (F.get(times, i) > F.get(times, i - 1)), F.lit(False)))
    none = F.array().cast("array<double>")
    parts = {"ts": times, "adj": F.coalesce(adjusted["adjclose"], none)} | {c: F.coalesce(quote[c], none) for c in ("open", "high", "low", "close", "volume")}
    rows = parsed.filter(quote.isNotNull() & (F.size(times) > 0)).select("ticker", ascends.alias("ascends"), F.size(times).alias("n"), *[v.alias(k) for k, v in parts.items()])
    rows = rows.select("ticker", "ascends", "n", F.posexplode(F.arrays_zip(*parts)).alias("i", "z")).filter("i < n").select("ticker", "ascends", "z.*")
    good = F.lit(True)
    for c in ("open", "high", "low", "close", "volume"):
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & ((F.col(c) >= 0) if c == "volume" else (F.col(c) > 0))
    good = good & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    has = F.col("adj").isNotNull() & ~F.isnan("adj") & (F.col("adj") > 0) & (F.col("adj") < float("inf"))
    return rows.withColumn("status", F.when(~F.col("ascends"), "unordered").when(~good, "invalid").when(~has, "unadjusted").otherwise("ok"))


def parse_chart(raw: DataFrame) -> DataFrame:
    """Adjusted bars from chart JSON. raw: ticker, json. Rows that are not ok are left out, and series whose times do not ascend."""
    factor = F.col("adj") / F.col("close")
    kept = chart_rows(raw).filter("status = 'ok'")
    return kept.select("ticker", F.to_date(F.timestamp_seconds("ts")).alias("date"), *[(F.col(c) * factor).alias(c) for c in ("open", "high", "low")], F.col("adj").alias("close"), "volume", *[F.col(c).alias(f"raw_{c}") for c in ("open", "high", "low", "close")], factor.alias("adj_factor"))


def chart_adjustment(raw: DataFrame) -> DataFrame:
    """Per ticker of chart JSON: rows of the source, invalid, eligible, adjusted, missing and rejected ones, and the share that is adjusted in percent."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    out = chart_rows(raw).groupBy("ticker").agg(F.count("*").alias("source_rows"), n("invalid", "unordered").alias("invalid"), n("unadjusted", "ok").alias("eligible"), n("ok").alias("adjusted"), n("unadjusted").alias("missing"))
    return out.withColumns({"rejected": F.col("source_rows") - F.col("adjusted"), "coverage_pct": F.col("adjusted") / F.col("source_rows") * 100})


def parse_csv_text(raw: DataFrame, newest: int = 320, least: int = 5) -> DataFrame:
    """Bars from CSV bodies (ticker, body): Date,Open,High,Low,Close,Volume below a header that names the date.

    Rows of fewer than six fields, or with one that cannot be read or a close that is not positive, are left out; the newest
    ones stay. A body without such a header or with fewer than ``least`` rows gives none.
    """
    lines = F.split(F.trim(F.regexp_replace("body", r"\A\s+|\s+\z", "")), r"\r\n|\n|\r")
    body = raw.filter(F.lower(F.get(lines, F.lit(0))).contains("date")).select("ticker", F.explode(F.slice(lines, F.lit(2), F.size(lines))).alias("line"))
    parts = body.select("ticker", F.split(F.trim("line"), ",").alias("p")).filter(F.size("p") >= 6)
    number = lambda k: F.trim(F.get("p", F.lit(k))).try_cast("double")
    rows = parts.select("ticker", F.get("p", F.lit(0)).try_cast("date").alias("date"), *[number(k).alias(c) for k, c in enumerate(("open", "high", "low", "close", "volume"), 1)]).dropna().filter("close > 0")
    w = Window.partitionBy("ticker")
    rows = rows.withColumns({"back": F.row_number().over(w.orderBy(F.desc("date"))), "n": F.count("*").over(w)})
    return rows.filter((F.col("n") >= least) & (F.col("back") <= newest)).drop("back", "n")


def daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV files Date, Open, High, Low, Close, Volume; malformed rows are left out."""
    schema = "Date DATE, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume DOUBLE"
    rows = spark.read.csv(path, header=True, schema=schema, mode="DROPMALFORMED")
    return rows.dropna(subset=["Date", "Open", "High", "Low", "Close"]).toDF("date", "open", "high", "low", "close", "volume")
