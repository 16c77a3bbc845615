"""Registered decision, log-study, calibration and filing queries, each with its SQL.

The fixture has no signals, so a universe of one signal a part is made of its key and size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions import scalars
from ..operators import calibration, decisions, events, filings, options, panel, risk
from ..sources.tables import bars, table
from .market import BARS, PANEL, RETS, W, momentum_panel, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FIELDS = decisions.FIELDS


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [((F.col("p_partkey") * (2 * i + 3) + F.col("p_size") * (i + 1)) % 101).cast("double").alias(f) for i, f in enumerate(FIELDS)]
    sure = (F.col("p_partkey") % 90).cast("double").alias("dataConfidence")
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("sector"), *made, sure)


def scored(spark: SparkSession, sf_dir: str, scenario: str) -> DataFrame:
    rows = decisions.apply_scenario(signals(spark, sf_dir), scenario)
    return decisions.score_universe(rows, decisions.universe_stats(rows))


def _mean(terms: list[str]) -> str:
    return f"(({' + '.join(terms)}) / {len(terms)})"


def _cdf(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    upper = f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {t} * (0.31938153 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"CASE WHEN {z} >= 0 THEN 1 - {upper} ELSE {upper} END"


def _score(e: str) -> str:
    return f"CAST(floor(least(greatest({e}, 0), 100) + 0.5) AS BIGINT)"


def scored_sql(scenario: str) -> str:
    rows = f"SELECT p_partkey, p_brand AS sector, {', '.join(f'CAST((p_partkey * {2 * i + 3} + p_size * {i + 1}) % 101 AS DOUBLE) AS {f}' for i, f in enumerate(FIELDS))}, CAST(p_partkey % 90 AS DOUBLE) AS dataConfidence FROM part"
    for field, constant, sources, divisor in decisions.SCENARIOS[scenario]:
        by = f" {'+' if divisor > 0 else '-'} floor(({' + '.join(sources)}) / {abs(divisor)} + 0.5)" if sources else ""
        rows = f"SELECT * REPLACE (least(greatest({field} + {constant}{by}, 0), 100) AS {field}) FROM ({rows})"
    names = list(decisions.FACTORS)
    z = lambda f: f"(({f} - m_{f}) / s_{f})"
    factors = ", ".join(f"{'-' if n in decisions.INVERTED else ''}{_mean([z(f) for f in fs])} AS {n}_z" for n, fs in decisions.FACTORS.items())
    inverse = {n: f"({len(fs)} / ({' + '.join('s_' + f for f in fs)}))" for n, fs in decisions.FACTORS.items()}
    weigh = lambda some: f"(({' + '.join(f'{n}_z * {inverse[n]}' for n in some)}) / ({' + '.join(inverse.values())}))"
    zs = [f"{n}_z" for n in names]
    mean = _mean(zs)
    votes = " + ".join(f"CASE WHEN {x} > 0.2 THEN 1 WHEN {x} < -0.2 THEN -1 ELSE 0 END" for x in zs)
    actions = " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in decisions.ACTIONS)
    known = {"risk": "m_drawdownRisk", "credit": "m_creditSensitivity", "breadth": "m_breadth", "trend": "m_trend60", "growth": "m_growthSensitivity"}
    regimes = " ".join(f"WHEN {' AND '.join(f'{known[n]} {sign} {x}' for n, sign, x in rule)} THEN '{name}'" for name, rule in decisions.REGIMES)
    return f"""WITH rows AS ({rows}),
st AS (SELECT {', '.join(f'avg({f}) AS m_{f}, greatest(stddev_pop({f}), 1) AS s_{f}' for f in FIELDS)} FROM rows),
f AS (SELECT *, {factors}, {_mean([f'{z(f)} * {by}' for f, by in decisions.RISK.items()])} AS risk_z, greatest(0, 55 - dataConfidence) AS penalty FROM rows, st),
c AS (SELECT *, {weigh(names)} AS composite_z, {weigh(['momentum', 'quality', 'growth', 'lowVol'])} AS fit, sqrt({_mean([f'({x} - {mean}) ** 2' for x in zs])}) AS spread FROM f),
a AS (SELECT *, least(greatest(({_cdf('composite_z')}) * 100, 0), 100) AS alpha, least(greatest(50 + ({votes}) * 8 - spread * 8, 0), 100) AS agreement,
  {_score('50 - (momentum_z + growth_z + quality_z) / 3 * 18 + greatest(0, risk_z) * 12')} AS thesis_damage FROM c),
scored AS (SELECT p_partkey, sector, breadth, round(composite_z, 6) AS composite_z, round(risk_z, 6) AS risk_z, CASE {actions} ELSE 'Hold' END AS action,
  {_score('alpha')} AS opportunity, {_score('50 + risk_z * 18 + penalty * 0.12')} AS risk_score, {_score('50 - fragility_z * 18')} AS fragility_score, {_score('agreement * 0.78 + dataConfidence * 0.22')} AS confidence,
  {_score('50 + fit * 18')} AS regime_fit, {_score('50 + (composite_z - risk_z) * 18')} AS asymmetry, thesis_damage, {_score('100 - spread * 25 - penalty * 0.2')} AS stability,
  round(least(greatest(composite_z * 2.5, -12), 12), 6) AS forecast_20d, {_score(f'({_cdf("(composite_z - 0.1)")}) * 100')} AS outperform_pct, {_score(f'({_cdf("(risk_z - 0.4)")}) * 100')} AS drawdown_pct, CASE {regimes} ELSE 'mixed' END AS regime FROM a)"""


SCORES = "p_partkey composite_z risk_z action opportunity risk_score fragility_score confidence regime_fit asymmetry thesis_damage stability forecast_20d outperform_pct drawdown_pct regime".split()


@query(scored_sql("base") + f" SELECT {', '.join(SCORES)} FROM scored")
def decision_scores(spark, sf_dir):
    return rounded(scored(spark, sf_dir, "base").select(*SCORES))


def _scenario_query(scenario: str):
    def run(spark, sf_dir):
        return rounded(scored(spark, sf_dir, scenario).select(*SCORES))

    run.__name__ = "scenario_" + "".join("_" + c.lower() if c.isupper() else c for c in scenario)
    return query(scored_sql(scenario) + f" SELECT {', '.join(SCORES)} FROM scored")(run)


for _name in decisions.SCENARIOS:
    if _name != "base":
        _scenario_query(_name)


@query(scored_sql("base") + """ SELECT sector, CAST(floor(least(greatest(avg(regime_fit + opportunity - risk_score * 0.4), 0), 100) + 0.5) AS BIGINT) AS score,
  CASE WHEN count(*) FILTER (action IN ('Buy Now', 'Accumulate')) > count(*) FILTER (action IN ('Sell', 'Trim')) THEN 'Accumulation'
       WHEN count(*) FILTER (action IN ('Buy Now', 'Accumulate')) < count(*) FILTER (action IN ('Sell', 'Trim')) THEN 'Distribution' ELSE 'Mixed' END AS label,
  CAST(floor(avg(breadth) + 0.5) AS BIGINT) AS participation FROM scored GROUP BY sector""")
def sector_decisions(spark, sf_dir):
    return decisions.sector_scores(scored(spark, sf_dir, "base"))


#: Actions that the fixture's event types stand for; any other type is Hold.
STANDING = {"click": "Accumulate", "error": "Buy Now", "purchase": "Hold", "signup": "Sell", "view": "Trim"}
_KINDS = f"""WITH named AS (SELECT *, CASE {' '.join(f"WHEN event_type = '{t}' THEN '{a}'" for t, a in STANDING.items())} ELSE 'Hold' END AS action FROM events),
moves AS (SELECT user_id, event_id, value, action, lag(action) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
  lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value, CAST(ts AS DATE) AS day FROM named),
sides AS (SELECT *, CASE WHEN before = 'Hold' THEN 'neutral' WHEN before IN ('Buy Now', 'Accumulate') THEN 'bullish' ELSE 'bearish' END AS a,
  CASE WHEN action = 'Hold' THEN 'neutral' WHEN action IN ('Buy Now', 'Accumulate') THEN 'bullish' ELSE 'bearish' END AS b FROM moves WHERE before IS NOT NULL),
kinds AS (SELECT *, CASE WHEN a = b THEN 'stay-' || a WHEN b = 'bullish' THEN 'entry' WHEN a = 'bullish' AND b = 'bearish' THEN 'exit'
  WHEN a = 'bullish' THEN 'soften' WHEN b = 'bearish' THEN 'warn' ELSE 'other' END AS kind FROM sides)"""


def _kinds(spark, sf_dir) -> DataFrame:
    log = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    log = log.withColumn("action", F.coalesce(decisions.mapped("event_type", STANDING), F.lit("Hold")))
    log = log.withColumns({"before": F.lag("action").over(w), "next_value": F.lead("value").over(w), "day": F.to_date("ts")}).filter("before is not null")
    return log.withColumn("kind", decisions.transition_kind("before", "action"))


@query(_KINDS + " SELECT user_id, event_id, before, action, kind FROM kinds")
def transition_kinds(spark, sf_dir):
    return _kinds(spark, sf_dir).select("user_id", "event_id", "before", "action", "kind")


@query(_KINDS + " SELECT kind, count(*) AS n, count(DISTINCT day) AS n_days, round(avg(next_value), 6) AS mean, round(median(next_value), 6) AS median, round(avg(CASE WHEN next_value > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM kinds WHERE next_value IS NOT NULL GROUP BY kind")
def transition_study(spark, sf_dir):
    return rounded(events.outcome_study(_kinds(spark, sf_dir), "kind", "next_value", "day"))


_PROB = "least(greatest(n_chars / 4000.0, 0.01), 0.99)"


def _forecasts(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", fx.clamp(F.col("n_chars") / 4000.0, 0.01, 0.99).alias("p"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query(f"SELECT count(*) AS n, round(avg(({_PROB} - quality) ** 2), 6) AS brier, round(avg(quality), 6) AS base_rate FROM documents JOIN labels USING (doc_id)")
def brier_score(spark, sf_dir):
    return rounded(calibration.brier(_forecasts(spark, sf_dir), "p", "quality"))


@query(f"SELECT CAST(least(9, floor({_PROB} * 10)) AS BIGINT) AS bin, count(*) AS n, round(avg({_PROB}), 6) AS mean_p, round(avg(quality), 6) AS observed, round(avg({_PROB}) - avg(quality), 6) AS gap FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def reliability_bins(spark, sf_dir):
    return rounded(calibration.reliability(_forecasts(spark, sf_dir), "p", "quality"))


@query(RETS + " SELECT ticker, round(least(greatest(coalesce(0.5 * avg(ret) / nullif(var_pop(ret), 0), 0), -1), 1), 6) AS size FROM rets GROUP BY ticker")
def fractional_kelly(spark, sf_dir):
    sums = risk.simple_returns(bars(spark, sf_dir)).groupBy("ticker").agg(F.avg("ret").alias("mu"), F.var_pop("ret").alias("variance"))
    return rounded(sums.select("ticker", calibration.fractional_kelly("mu", "variance").alias("size")))


@query(PANEL + """, i AS (SELECT date, coalesce(covar_pop(momentum_20d, fwd_20d) / nullif(stddev_pop(momentum_20d) * stddev_pop(fwd_20d), 0), 0) AS ic FROM known GROUP BY date HAVING count(*) >= 5)
SELECT count(*) AS n, round(avg(ic), 6) AS mean_ic, round(stddev_pop(ic), 6) AS std_ic, round(avg(ic) / nullif(stddev_pop(ic), 0), 6) AS ir, round(avg(ic) / nullif(stddev_pop(ic), 0) * sqrt(count(*)), 6) AS t_stat, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM i""")
def ic_summary(spark, sf_dir):
    return rounded(calibration.ic_summary(panel.information_coefficients(momentum_panel(spark, sf_dir), "momentum_20d", "fwd_20d")))


@query(f"""WITH q AS (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
t AS (SELECT *, CASE WHEN count(*) OVER last4 = 4 THEN sum(value) OVER last4 END AS ttm, lag(value, 4) OVER (PARTITION BY o_custkey ORDER BY period) AS year_ago FROM q
  WINDOW last4 AS (PARTITION BY o_custkey ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT o_custkey, period, round(value, 2) AS value, round(ttm, 2) AS ttm, round((value / year_ago - 1) * 100, 6) AS yoy_pct FROM t""")
def trailing_twelve_months(spark, sf_dir):
    quarters = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period")).agg(F.sum("o_totalprice").alias("value"))
    rows = filings.trailing(quarters, "o_custkey", "period", "value")
    return rows.select("o_custkey", "period", F.round("value", 2).alias("value"), F.round("ttm", 2).alias("ttm"), F.round("yoy_pct", 6).alias("yoy_pct"))


@query("""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL (-12) MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)) AS DATE) AS year_back,
  CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)) AS DATE) AS month_on FROM orders""")
def shifted_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.shift_months("o_orderdate", -12).alias("year_back"), scalars.shift_months("o_orderdate", 1).alias("month_on"))


@query("""SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 1000 + p_size WHEN 2 THEN -p_size END AS DOUBLE) AS number,
  CASE p_partkey % 3 WHEN 0 THEN 'T' || p_size WHEN 1 THEN 'BRK.B' END AS ticker FROM part""")
def parsed_holdings(spark, sf_dir):
    """Numbers and symbols read back from the ways in which brokers write them."""
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 4
    number = F.when(kind == 0, F.concat(F.lit(" $"), size)).when(kind == 1, F.format_string("$%,d.00", 1000 + F.col("p_size"))).when(kind == 2, F.format_string("($%d)", "p_size")).otherwise("n/a")
    mark = F.col("p_partkey") % 3
    symbol = F.when(mark == 0, F.concat(F.lit("$t"), size, F.lit(" (lot 3)"))).when(mark == 1, "brk.b - Class B").otherwise("12 percent")
    rows = table(spark, sf_dir, "part").select("p_partkey", number.alias("raw_number"), symbol.alias("raw_symbol"))
    return rows.select("p_partkey", scalars.parse_number("raw_number").alias("number"), scalars.sanitize_ticker("raw_symbol").alias("ticker"))


@query("SELECT event_id, round(least(greatest(100 / (1 + exp(-(value / 100 - 0.5) * 3)), 0.5), 99.5), 6) AS exit_pct, round(exp(-(event_id % 30) / 7.0), 6) AS weight FROM events")
def decayed_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rounded(rows.select("event_id", scalars.logistic_percent(F.col("value") / 100).alias("exit_pct"), scalars.time_decay(F.col("event_id") % 30).alias("weight")))


@query()
def isotonic_calibration(spark, sf_dir):
    return rounded(calibration.isotonic(_forecasts(spark, sf_dir), "p", "quality"))


@query()
def ic_interval(spark, sf_dir):
    return rounded(calibration.bootstrap_mean(panel.information_coefficients(momentum_panel(spark, sf_dir), "momentum_20d", "fwd_20d"), "date", "ic"))


@query()
def deflated_sharpe(spark, sf_dir):
    summary = risk.risk_summary(risk.simple_returns(bars(spark, sf_dir)))
    return rounded(calibration.deflated_sharpe(summary.select("ticker", F.col("sharpe_daily").alias("sharpe"), "n", "skew", "kurt")))


_BACK20, _BACK60 = (f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (20, 60))


@query(BARS + f""", r AS (SELECT *, ln(close / lag(close) OVER ({W})) AS ret FROM bars),
v AS (SELECT ticker, date, stddev_pop(ret) OVER {_BACK20} AS short, stddev_pop(ret) OVER {_BACK60} AS long, row_number() OVER ({W}) - 1 AS n_before FROM r)
SELECT ticker, date, round(short / long, 6) AS iv_rv, CASE WHEN short / long > 1.3 THEN 'sell premium' ELSE 'buy premium' END AS side, round(least(100, abs(short / long - 1) * 100), 6) AS score
FROM v WHERE n_before > 60 AND short > 0 AND (short / long > 1.3 OR short / long < 0.85)""")
def premium_flags(spark, sf_dir):
    """Short volatility stands for the implied one, long volatility for the forecast."""
    rows = panel.price_features(bars(spark, sf_dir), least=61).select("ticker", "date", "volatility_20d", "volatility_60d")
    return rounded(options.premium_flags(rows, "volatility_20d", "volatility_60d").select("ticker", "date", "iv_rv", "side", "score"))


@query(PANEL + """, c AS (SELECT *, count(momentum_20d) OVER (PARTITION BY date) AS n FROM panel)
SELECT ticker, date, round(CASE WHEN momentum_20d IS NULL OR n < 20 THEN 50 ELSE
  (rank() OVER (PARTITION BY date, momentum_20d IS NULL ORDER BY momentum_20d) - 1 + (count(*) OVER (PARTITION BY date, momentum_20d) - 1) / 2.0) / (n - 1) * 100 END, 6) AS momentum_20d_rank FROM c""")
def neutral_ranks(spark, sf_dir):
    return rounded(panel.neutral_ranks(momentum_panel(spark, sf_dir), ["momentum_20d"], 20).select("ticker", "date", "momentum_20d_rank"))
