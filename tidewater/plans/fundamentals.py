"""Registered queries on filed facts, each with its SQL.

The fixture has no filings, so a brand's quarterly sales are made into facts: brands of an even number file three quarters
and a year, others four quarters; quarters that end in June are restated 300 days later; some brands tell no debt.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filings, panel
from ..sources.tables import bars, table
from .market import BARS, W, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_FLOWS = {"revenue": 1, "netIncome": 0.025, "operatingCashFlow": 0.12, "capex": -0.03, "operatingIncome": 0.08}
_INSTANTS = {"assets": 5, "liabilities": 3, "equity": 2, "shares": 1000, "currentAssets": 1.5, "currentLiabilities": 1, "retainedEarnings": 0.7, "shortTermDebt": 0.2, "longTermDebt": 0.9}
_rows = lambda of: ", ".join(f"('{c}', CAST({x} AS DOUBLE))" for c, x in of.items())
_QUARTER = "CAST(date_trunc('quarter', CAST(l_shipdate AS DATE)) AS DATE)"
_DIGIT = "CAST(right(symbol, 1) AS INT)"
_YEAR = "CAST(date_trunc('year', since) AS DATE)"
#: Reads the same in Spark and elsewhere.
FACTS = f"""sold AS (SELECT p_brand AS symbol, {_QUARTER} AS since, CAST(sum(l_extendedprice) AS DOUBLE) AS amount, CAST(sum(l_quantity) AS DOUBLE) AS pieces FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, {_QUARTER}),
quarters AS (SELECT *, CAST(since + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS until FROM sold),
flows AS (SELECT symbol, concept, since, until, amount * factor * CASE WHEN concept = 'netIncome' THEN pieces % 7 - 1 ELSE 1 END AS value FROM quarters CROSS JOIN (VALUES {_rows(_FLOWS)}) AS f(concept, factor)),
told AS (SELECT symbol, concept, since, until, value, CAST(until + INTERVAL 40 DAY AS DATE) AS filed, 'quarter' AS span FROM flows WHERE {_DIGIT} % 2 = 1 OR month(until) < 12
  UNION ALL SELECT symbol, concept, {_YEAR}, CAST({_YEAR} + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE), sum(value), CAST({_YEAR} + INTERVAL 14 MONTH AS DATE), 'annual' FROM flows WHERE {_DIGIT} % 2 = 0 GROUP BY symbol, concept, {_YEAR}
  UNION ALL SELECT symbol, concept, CAST(NULL AS DATE), until, factor * CASE WHEN concept = 'shares' THEN pieces ELSE amount END, CAST(until + INTERVAL 40 DAY AS DATE), 'instant' FROM quarters CROSS JOIN (VALUES {_rows(_INSTANTS)}) AS f(concept, factor)
    WHERE NOT (concept LIKE '%Debt' AND {_DIGIT} = 3)),
facts AS (SELECT * FROM told UNION ALL SELECT symbol, concept, since, until, value * 1.02, CAST(filed + INTERVAL 300 DAY AS DATE), span FROM told WHERE span = 'quarter' AND month(until) = 6)"""


def facts(spark, sf_dir):
    sql = FACTS.replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}")
    return spark.sql(f"WITH {sql} SELECT * FROM facts", lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))


def _shift(e: str, months: int) -> str:
    return f"CAST(date_trunc('month', {e}) - INTERVAL {months} MONTH + to_days(CAST(day({e}) - 1 AS INTEGER)) AS DATE)"


_K = "symbol, known, concept, tag"
_ASKED = [("revenue", "now", "DATE '9000-01-01'"), ("revenue", "year", "y"), ("revenue", "lag", "g"), ("revenue", "lag_year", _shift("g", 12)), ("netIncome", "now", "DATE '9000-01-01'"), ("netIncome", "year", "y")]
_ASKED += [(c, "now", "DATE '9000-01-01'") for c in ("operatingCashFlow", "capex", "operatingIncome")]
_t = lambda c, tag="now": f"max(total) FILTER (concept = '{c}' AND tag = '{tag}')"
_OUT = ["revenue_growth_yoy", "revenue_accel", "net_margin", "margin_trend", "fcf_margin", "leverage", "roe", "share_change_yoy"]
SNAPSHOTS = f"""{FACTS}, days AS (SELECT DISTINCT symbol, filed AS known FROM facts WHERE concept IN ({', '.join(f"'{c}'" for c in filings.DATED)})),
vis AS (SELECT symbol, known, concept, since, until, value, span FROM days JOIN facts USING (symbol) WHERE filed <= known QUALIFY row_number() OVER (PARTITION BY symbol, known, concept, since, until ORDER BY filed DESC) = 1),
ends AS (SELECT symbol, known, {_shift('e', 12)} AS y, {_shift('e', 3)} AS g FROM (SELECT symbol, known, max(until) FILTER (concept = 'revenue') AS e FROM vis GROUP BY ALL)),
asked AS ({' UNION ALL '.join(f"SELECT symbol, known, '{c}' AS concept, '{tag}' AS tag, {cut} AS cut FROM ends" for c, tag, cut in _ASKED)}),
el AS (SELECT {_K}, until, value, span FROM asked JOIN vis USING (symbol, known, concept) WHERE until <= cut),
fy AS (SELECT {_K}, arg_max(value, until) AS fv, max(until) AS fu FROM el WHERE span = 'annual' GROUP BY ALL), qs AS (SELECT * FROM el WHERE span = 'quarter'),
later AS (SELECT {_K}, until, value, {_shift('until', 12)} AS back FROM qs JOIN fy USING ({_K}) WHERE until > fu),
pairs AS (SELECT a.symbol, a.known, a.concept, a.tag, a.until, a.value, arg_min(p.value, (abs(date_diff('day', p.until, a.back)), p.until)) AS prior FROM later a
  LEFT JOIN qs p ON a.symbol = p.symbol AND a.known = p.known AND a.concept = p.concept AND a.tag = p.tag AND abs(date_diff('day', p.until, a.back)) <= 21 GROUP BY ALL),
roll AS (SELECT {_K}, CASE WHEN count(prior) = count(*) THEN sum(value) - sum(prior) END AS change, count(*) AS n FROM pairs GROUP BY ALL),
four AS (SELECT {_K}, CASE WHEN count(*) = 4 AND date_diff('day', min(until), max(until)) BETWEEN 240 AND 320 THEN sum(value) END AS four FROM (SELECT * FROM qs QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY until DESC) <= 4) GROUP BY {_K}),
ttm AS (SELECT {_K}, CASE WHEN fv IS NULL THEN four WHEN n IS NULL THEN fv ELSE coalesce(fv + change, four, fv) END AS total FROM asked LEFT JOIN fy USING ({_K}) LEFT JOIN roll USING ({_K}) LEFT JOIN four USING ({_K})),
wide AS (SELECT symbol, known, {_t('revenue')} AS r0, {_t('revenue', 'year')} AS r1, {_t('revenue', 'lag')} AS r2, {_t('revenue', 'lag_year')} AS r3, {_t('netIncome')} AS ttm_income, {_t('netIncome', 'year')} AS n1,
  {_t('operatingCashFlow')} AS cash, {_t('capex')} AS spent, {_t('operatingIncome')} AS ttm_operating FROM ttm GROUP BY symbol, known),
inst AS (SELECT symbol, known, {', '.join(f"arg_max(value, until) FILTER (concept = '{c}') AS {c}" for c in _INSTANTS)}, max(until) FILTER (concept = 'shares') AS su FROM vis GROUP BY symbol, known),
old AS (SELECT i.symbol, i.known, arg_min(v.value, (abs(date_diff('day', v.until, {_shift('i.su', 12)})), v.until)) AS earlier FROM inst i JOIN vis v ON v.symbol = i.symbol AND v.known = i.known AND v.concept = 'shares'
  AND abs(date_diff('day', v.until, {_shift('i.su', 12)})) <= 100 GROUP BY i.symbol, i.known),
snaps AS (SELECT *, r0 AS ttm_revenue, CASE WHEN r1 > 0 THEN (r0 / r1 - 1) * 100 END AS revenue_growth_yoy, CASE WHEN r1 > 0 AND r3 > 0 THEN (r0 / r1 - 1) * 100 - (r2 / r3 - 1) * 100 END AS revenue_accel,
  CASE WHEN r0 > 0 THEN ttm_income / r0 * 100 END AS net_margin, CASE WHEN r0 > 0 AND r1 > 0 THEN ttm_income / r0 * 100 - n1 / r1 * 100 END AS margin_trend,
  CASE WHEN r0 > 0 THEN (cash - abs(coalesce(spent, 0))) / r0 * 100 END AS fcf_margin, CASE WHEN assets > 0 THEN liabilities / assets * 100 END AS leverage, CASE WHEN equity > 0 THEN ttm_income / equity * 100 END AS roe,
  CASE WHEN shares > 0 AND earlier > 0 THEN (shares / earlier - 1) * 100 END AS share_change_yoy FROM wide JOIN inst USING (symbol, known) LEFT JOIN old USING (symbol, known))"""
_TOLD = ["ttm_revenue", "ttm_income", "ttm_operating", *_INSTANTS, *_OUT]


@query(f"WITH {SNAPSHOTS} SELECT symbol, known, {', '.join(f'round({c}, 4) AS {c}' for c in _TOLD)} FROM snaps")
def fundamental_snapshots(spark, sf_dir):
    return rounded(filings.snapshots(facts(spark, sf_dir)).select("symbol", "known", *_TOLD), 4)


_cut = lambda e, low, high: f"CASE WHEN {e} IS NOT NULL THEN least(greatest({e}, {low}), {high}) END"
_VALUES = {f"fund_{c}": c for c in _OUT} | {
    "fund_earnings_yield": "(ttm_income / cap * 100)",
    "fund_filing_age": "coalesce(date_diff('day', known, date), 400)",
    "fund_log_market_cap": "ln(cap)",
    "fund_altman_z": "(CASE WHEN assets > 0 AND liabilities > 0 THEN 6.56 * (currentAssets - currentLiabilities) / assets + 3.26 * retainedEarnings / assets + 6.72 * ttm_operating / assets + 1.05 * equity / liabilities END)",
    "fund_naive_dd": "(CASE WHEN owed > 0 THEN (ln((cap + owed) / owed) + change / 100 - sigma * sigma / 2) / sigma WHEN owed IS NOT NULL AND cap IS NOT NULL THEN 15 END)",
}


@query(f"""{BARS}, {SNAPSHOTS}, r AS (SELECT *, ln(close / lag(close) OVER ({W})) AS ret FROM bars),
p AS (SELECT ticker, date, row_number() OVER ({W}) - 1 AS n, lag(close) OVER ({W}) AS last_close, coalesce((lag(close) OVER ({W}) / lag(close, 253) OVER ({W}) - 1) * 100, 0) AS change,
  stddev_pop(ret) OVER ({W} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) * sqrt(252) AS vol FROM r),
a AS (SELECT *, CASE WHEN shares > 0 AND last_close > 0 THEN shares * last_close END AS cap, CASE WHEN shortTermDebt IS NOT NULL OR longTermDebt IS NOT NULL THEN coalesce(shortTermDebt, 0) + 0.5 * coalesce(longTermDebt, 0) END AS owed,
  greatest(0.05, vol) AS own FROM p ASOF LEFT JOIN snaps ON p.ticker = snaps.symbol AND p.date > snaps.known WHERE n >= 252),
b AS (SELECT *, cap / (cap + owed) * own + owed / (cap + owed) * (0.05 + 0.25 * own) AS sigma FROM a)
SELECT ticker, date, {', '.join(f'round({_cut(e, *filings.BOUNDS[n])}, 4) AS {n}' for n, e in _VALUES.items())} FROM b""")
def fund_features(spark, sf_dir):
    w = panel.by_ticker()
    rows = bars(spark, sf_dir).withColumn("ret", F.log(F.col("close") / F.lag("close").over(w)))
    change = F.coalesce((F.lag("close").over(w) / F.lag("close", 253).over(w) - 1) * 100, F.lit(0.0))
    rows = rows.select("ticker", "date", (F.row_number().over(w) - 1).alias("n"), F.lag("close").over(w).alias("last_close"), change.alias("change"), (F.stddev_pop("ret").over(panel.before(252)) * panel.YEAR).alias("volatility"))
    return rounded(filings.fund_features(rows.filter("n >= 252").drop("n"), filings.snapshots(facts(spark, sf_dir))), 4)
