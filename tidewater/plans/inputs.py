"""Registered queries on raw inputs and what is estimated from them: facts and charts as JSON, CSV bodies, implied volatility, bootstraps.

The fixture has no such strings, so they are made of its bars and facts, with defects by turns.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import bsm
from ..operators import calibration, events, filings, options, panel
from ..sources import tables
from ..sources.facts import NAMES, TAXONOMY, UNITS, facts_from_json as read_facts
from .fundamentals import _TOLD, FACTS, SNAPSHOTS, facts
from .market import BARS, RETS, W, momentum_panel, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _told_facts(spark, sf_dir):
    """symbol, json. Symbols of an even number file under the second name, and a form that is no statement under the first; others file something else under the second."""
    rows = facts(spark, sf_dir)
    full = lambda n: n if ":" in n else f"{TAXONOMY}:{n}"
    name = lambda k: F.create_map(*[F.lit(x) for c, n in NAMES.items() for x in (c, full(n[min(k, len(n) - 1)]))])[F.col("concept")]
    several = F.col("concept").isin(*[c for c, n in NAMES.items() if len(n) > 1])
    even = F.right("symbol", F.lit(1)).cast("int") % 2 == 0
    form = F.when(F.col("span") == "annual", "10-K").otherwise("10-Q")
    as_ = lambda n, form, value: F.struct(n.alias("name"), form.alias("form"), value.alias("val"))
    own = as_(F.when(even, name(1)).otherwise(name(0)), form, F.col("value"))
    other = F.when(several, F.when(even, as_(name(0), F.lit("8-K"), F.col("value") * 9)).otherwise(as_(name(1), form, F.col("value") * 9)))
    rows = rows.withColumn("f", F.explode(F.filter(F.array(own, other), lambda x: x.isNotNull())))
    day = lambda c: F.col(c).cast("string")
    filed = F.struct(F.col("f.val"), day("since").alias("start"), day("until").alias("end"), day("filed").alias("filed"), F.col("f.form"))
    unit = F.coalesce(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])[F.col("concept")], F.lit("USD"))
    under = rows.groupBy("symbol", "f.name", unit.alias("unit")).agg(F.collect_list(filed).alias("filed"))
    part = lambda k: F.split("name", ":")[k]
    named = under.groupBy("symbol", part(0).alias("taxonomy")).agg(F.map_from_entries(F.collect_list(F.struct(part(1), F.struct(F.create_map("unit", "filed").alias("units"))))).alias("names"))
    whole = named.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "names"))).alias("facts"))
    return whole.select("symbol", F.explode(F.array(F.to_json(F.struct("facts")))).alias("json"))


@query(f"WITH {FACTS} SELECT symbol, concept, since, until, filed, round(value, 4) AS value, CASE WHEN span = 'annual' THEN '10-K' ELSE '10-Q' END AS form, span FROM facts")
def facts_from_json(spark, sf_dir):
    return rounded(read_facts(_told_facts(spark, sf_dir)), 4)


@query(f"WITH {SNAPSHOTS} SELECT symbol, known, {', '.join(f'round({c}, 4) AS {c}' for c in _TOLD)} FROM snaps")
def snapshots_from_json(spark, sf_dir):
    return rounded(filings.snapshots(read_facts(_told_facts(spark, sf_dir))).select("symbol", "known", *_TOLD), 4)


_CHART = BARS + f""", c AS (SELECT ticker, date, low AS o, close AS c, volume AS v, row_number() OVER ({W}) - 1 AS i, high, low, CASE WHEN year(date) < 1996 THEN 0.5 ELSE 1 END AS factor FROM bars),
t AS (SELECT *, CASE WHEN right(ticker, 1) = '4' THEN 'unordered' WHEN i % 13 = 5 OR i % 17 = 2 THEN 'invalid' WHEN i % 11 = 3 THEN 'unadjusted' ELSE 'ok' END AS status FROM c) """


def _charts(spark, sf_dir):
    rows = tables.bars(spark, sf_dir).withColumn("i", F.row_number().over(panel.by_ticker()) - 1)
    adj = F.when(F.col("i") % 11 != 3, F.col("close") * F.when(F.year("date") < 1996, 0.5).otherwise(1.0))
    still = F.when(F.right("ticker", F.lit(1)) == "4", F.lit(0)).otherwise(F.unix_date("date"))
    row = F.struct("i", (still.cast("long") * 86400).alias("t"), F.col("low").alias("o"), F.when(F.col("i") % 13 == 5, F.col("low") / 2).otherwise(F.col("high")).alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.when(F.col("i") % 17 != 2, F.col("volume")).alias("v"), adj.alias("a"))
    rows = rows.groupBy("ticker").agg(F.array_sort(F.collect_list(row)).alias("r"))
    of = lambda k: F.transform("r", lambda x: x[k])
    quote = F.struct(of("o").alias("open"), of("h").alias("high"), of("l").alias("low"), of("c").alias("close"), of("v").alias("volume"))
    result = F.struct(of("t").alias("timestamp"), F.struct(F.array(quote).alias("quote"), F.array(F.struct(of("a").alias("adjclose"))).alias("adjclose")).alias("indicators"))
    return rows.select("ticker", F.explode(F.array(F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))))).alias("json"))


@query(_CHART + "SELECT ticker, date, round(o * factor, 6) AS open, round(high * factor, 6) AS high, round(low * factor, 6) AS low, round(c * factor, 6) AS close, v AS volume, round(c, 6) AS raw_close, round(factor, 6) AS adj_factor FROM t WHERE status = 'ok'")
def chart_bars(spark, sf_dir):
    return rounded(tables.parse_chart(_charts(spark, sf_dir)).drop("raw_open", "raw_high", "raw_low"))


@query(_CHART + """SELECT ticker, count(*) AS source_rows, count(*) FILTER (status IN ('invalid', 'unordered')) AS invalid, count(*) FILTER (status IN ('ok', 'unadjusted')) AS eligible, count(*) FILTER (status = 'ok') AS adjusted,
  count(*) FILTER (status = 'unadjusted') AS missing, count(*) FILTER (status <> 'ok') AS rejected, round(count(*) FILTER (status = 'ok') / count(*) * 100, 6) AS coverage_pct FROM t GROUP BY ticker""")
def chart_adjustment(spark, sf_dir):
    return rounded(tables.chart_adjustment(_charts(spark, sf_dir)))


@query(BARS + f""", c AS (SELECT *, row_number() OVER ({W}) - 1 AS i FROM bars), u AS (SELECT * FROM c WHERE i % 19 <> 4 AND i % 23 <> 6 AND i % 29 <> 7 AND right(ticker, 1) <> '5')
SELECT ticker, date, round(low, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM u QUALIFY count(*) OVER (PARTITION BY ticker) >= 5 AND row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 320""")
def csv_bars(spark, sf_dir):
    rows = tables.bars(spark, sf_dir).withColumn("i", F.row_number().over(panel.by_ticker()) - 1)
    text = lambda c: F.col(c).cast("string")
    fields = F.array(text("date"), F.when(F.col("i") % 19 == 4, "n/a").otherwise(text("low")), text("high"), text("low"), F.when(F.col("i") % 29 == 7, "0").otherwise(text("close")), text("volume"))
    line = F.array_join(F.slice(fields, F.lit(1), F.when(F.col("i") % 23 == 6, 5).otherwise(6)), ",")
    rows = rows.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("r"))
    head = F.when(F.right("ticker", F.lit(1)) == "5", "no such symbol").otherwise("Date,Open,High,Low,Close,Volume")
    body = F.concat(head, F.lit("\r\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\r\n"), F.lit("\r\n"))
    return rounded(tables.parse_csv_text(rows.select("ticker", body.alias("body"))))


_OPTIONS = RETS + """, v AS (SELECT ticker, stddev_pop(ret) * sqrt(252) AS vol FROM rets GROUP BY ticker),
o AS (SELECT ticker, kind, moneyness, least(vol, 2) AS vol, 100.0 AS spot FROM v CROSS JOIN (VALUES ('call'), ('put')) AS k(kind) CROSS JOIN (VALUES (0.9), (1.0), (1.1)) AS m(moneyness)) """


def _quoted(spark, sf_dir):
    rets = tables.bars(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close").over(panel.by_ticker()) - 1)
    rows = rets.groupBy("ticker").agg(F.least(F.stddev_pop("ret") * F.sqrt(F.lit(252.0)), F.lit(2.0)).alias("vol"))
    return rows.select("ticker", "vol", F.lit(100.0).alias("spot"), F.explode(F.array(F.lit("call"), F.lit("put"))).alias("kind")).withColumn("moneyness", F.explode(F.array(*map(F.lit, (0.9, 1.0, 1.1)))))


@query(_OPTIONS + "SELECT ticker, kind, CAST(moneyness AS DOUBLE) AS moneyness, round(vol, 4) AS implied FROM o")
def implied_volatility(spark, sf_dir):
    """Prices are made with a known volatility, which must come back."""
    rows = _quoted(spark, sf_dir).withColumn("strike", F.col("spot") * F.col("moneyness"))
    at = bsm("spot", "strike", 0.5, 0.04, "vol", 0.01)
    rows = rows.withColumn("price", F.when(F.col("kind") == "call", at["call"]).otherwise(at["put"]))
    return rows.select("ticker", "kind", "moneyness", F.round(options.implied_volatility("price", "kind", "spot", "strike", 0.5, 0.04, 0.01), 4).alias("implied"))


@query(_OPTIONS + """SELECT DISTINCT ticker, CAST(q AS DOUBLE) AS quantile, round(100 * exp((0.04 - 0.01 - vol * vol / 2) * 0.5 + vol * sqrt(0.5) * z), 3) AS price
FROM o CROSS JOIN (VALUES (0.05, -1.6448536270), (0.25, -0.6744897502), (0.5, 0.0), (0.75, 0.6744897502), (0.95, 1.6448536270)) AS n(q, z)""")
def return_distribution(spark, sf_dir):
    rows = _quoted(spark, sf_dir).filter("kind = 'call' AND moneyness = 1.0").withColumn("years", F.lit(0.5))
    return options.return_distribution(rows, "spot", F.lit(0.04), F.lit(0.01), "vol", "years").select("ticker", "quantile", F.round("price", 3).alias("price"))


@query()
def transition_intervals(spark, sf_dir):
    """What follows each move between event types, with intervals by drawing days."""
    log = tables.table(spark, sf_dir, "events").withColumn("next", F.lead("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    moves = events.transitions(log, "user_id", ["ts", "event_id"], "event_type").withColumn("kind", F.concat_ws(">", "from_state", "event_type")).withColumn("day", F.to_date("ts"))
    return rounded(calibration.cluster_bootstrap(moves, ["kind"], "day", "next", iterations=500))


@query()
def feature_p_values(spark, sf_dir):
    """Mean coefficient of momentum and of its reversal by date, their intervals and p-values."""
    rows = momentum_panel(spark, sf_dir)
    each = [panel.information_coefficients(rows.withColumn("x", c), "x", "fwd_20d").select(F.lit(n).alias("feature"), "date", "ic") for n, c in (("momentum", F.col("momentum_20d")), ("reversal", -F.col("momentum_20d")), ("size", F.abs("momentum_20d")))]
    return rounded(calibration.block_bootstrap(each[0].unionByName(each[1]).unionByName(each[2]), "date", "ic", ["feature"]))


@query(BARS + f""", p AS (SELECT ticker, date, momentum AS predicted FROM (SELECT ticker, date, (close / lag(close, 5) OVER ({W}) - 1) * 100 AS momentum FROM bars) WHERE momentum IS NOT NULL AND date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'),
b AS (SELECT ticker, date, close, lead(close, 20) OVER ({W}) AS e, lead(date, 20) OVER ({W}) AS at_end FROM bars WHERE date <= DATE '1997-06-30'),
j AS (SELECT p.*, date_diff('day', p.date, DATE '1997-06-30') AS age, CASE WHEN date_diff('day', p.date, DATE '1997-06-30') BETWEEN 30 AND 370 THEN (e - close) / close * 100 END AS realized, at_end FROM p LEFT JOIN b USING (ticker, date))
SELECT ticker, date, round(predicted, 6) AS predicted, round(realized, 6) AS realized, CASE WHEN realized IS NOT NULL THEN at_end END AS realized_at, CASE WHEN realized IS NULL THEN 'pending' ELSE 'realized' END AS status FROM j WHERE realized IS NOT NULL OR age <= 370""")
def late_labels(spark, sf_dir):
    """Predictions of a year and a half as they stand at its end: old ones that were never realized are gone."""
    rows = tables.bars(spark, sf_dir)
    log = rows.select("ticker", "date", ((F.col("close") / F.lag("close", 5).over(panel.by_ticker()) - 1) * 100).alias("predicted")).filter("predicted is not null and date between '1996-01-01' and '1997-06-30'")
    return rounded(events.reconciled(log, rows, "1997-06-30"))
