"""Registered queries on brokers' files, option strategies, groups of names, simulated paths, the ledger and late labels, each with its SQL.

The fixture has no files and no chains, so files are made of customers' purchases, with defects by turns, and chains of
parts, whose retail price is the spot price.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import groups, panel, paths
from ..operators import strategies as st
from ..operators.prices import price_metrics as metrics_of
from ..sources import archive, brokers, tables
from ..sources.staging import shared_folder
from ..streaming import labels, logs
from .decisions import scored, scored_sql
from .features import _TAIL, _clamp
from .market import BARS, RETS, W, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_HELD = """WITH h AS (SELECT o_custkey AS owner, 'P' || l_partkey AS ticker, sum(l_quantity) AS shares, floor(min(l_extendedprice)) + 0.25 AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ticker) - 1 AS i, owner % 5 AS kind FROM h),
b AS (SELECT *, i % 7 = 3 AS unread, i % 5 = 2 AND i % 7 <> 3 AS twice, CASE kind WHEN 0 THEN 'fidelity' WHEN 1 THEN 'schwab' WHEN 2 THEN 'etrade' WHEN 3 THEN 'robinhood' ELSE 'paste' END AS format FROM r) """


def _held(spark, sf_dir):
    """file, ticker, shares, cost, i, kind: what a customer's file tells."""
    rows = tables.table(spark, sf_dir, "lineitem").join(tables.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.groupBy(F.col("o_custkey").alias("owner"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker")).agg(F.sum("l_quantity").alias("shares"), (F.floor(F.min("l_extendedprice")) + 0.25).alias("cost"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("owner").orderBy("ticker")) - 1)
    return rows.withColumns({"kind": F.col("owner") % 5, "unread": F.col("i") % 7 == 3, "twice": (F.col("i") % 5 == 2) & (F.col("i") % 7 != 3)})


def _bodies(rows, line, again, head, foot, line_end: str):
    """file, body: the lines of a file in order, a repeated one behind its own."""
    told = F.struct("i", F.when(F.col("twice"), F.concat(line, F.lit(line_end), again)).otherwise(line).alias("line"))
    rows = rows.groupBy("owner", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["line"]), line_end).alias("lines"))
    return rows.select(F.col("owner").cast("string").alias("file"), F.concat(head, "lines", foot).alias("body"))


def _money(x):
    return F.concat(F.lit('"$'), F.format_number(x, 2), F.lit('"'))


def _files(spark, sf_dir):
    rows = _held(spark, sf_dir)
    kind, ticker, cost = F.col("kind"), F.col("ticker"), F.col("cost")

    def line(shares):
        n = F.when(F.col("unread"), "n/a").otherwise(shares)
        name = F.concat(F.lit('"Acme ""'), ticker, F.lit('"", Inc"'))
        join = lambda *x: F.concat_ws(",", *x)
        schwab = join(F.concat(F.lit("$"), ticker), name, n, F.lit(""), F.lit("-"), _money(cost * F.col("shares")))
        return (F.when(kind == 0, join(F.lit("X1"), F.lit("Own"), F.concat(ticker, F.lit(" (new)")), name, n, F.lit("--"), _money(cost)))
            .when(kind == 1, schwab).when(kind == 2, join(F.lower(ticker), n, _money(cost))).when(kind == 3, join(ticker, n, F.lit("0"), _money(cost * F.col("shares"))))
            .otherwise(F.concat_ws(" ", ticker, n, F.concat(F.lit("$"), cost.cast("decimal(18,2)").cast("string")))))

    heads = {0: "Account Number,Account Name,Symbol,Description,Quantity,Last Price,Average Cost Basis\n", 1: '"Positions, all"\n\nSymbol,Description,Quantity,Price,Day Change $,Cost Basis\n', 2: "Symbol,Quantity #,Price Paid $\n", 3: "Instrument,Shares,Average Cost,Total Cost\n"}
    head, foot = F.lit(""), F.lit("\r\n!!")
    for k, text in heads.items():
        head = F.when(kind == k, text).otherwise(head)
    foot = F.when(kind == 4, foot).when(kind == 0, "\r\n,,SPAXX**,,1,1,1\r\n").otherwise("\r\ncash,1,1\r\n")
    # the parts of a file depend on its kind alone, which the grouping keeps
    return _bodies(rows, line(F.col("shares").cast("int").cast("string")), line(F.lit("1")), head, foot, "\r\n")


@query(_HELD + """SELECT CAST(owner AS VARCHAR) AS file, format, ticker, CAST(CASE WHEN unread THEN 0 ELSE shares END AS DOUBLE) AS shares, CAST(cost AS DOUBLE) AS average_cost FROM b WHERE kind = 4 OR NOT unread""")
def broker_holdings(spark, sf_dir):
    """Holdings read from files of five formats; of a pasted list unread numbers are 0."""
    return rounded(brokers.broker_holdings(_files(spark, sf_dir)).drop("place"))


@query(_HELD + """SELECT CAST(owner AS VARCHAR) AS file, format, CASE kind WHEN 0 THEN 7 WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 3 THEN 4 END AS columns, count(*) FILTER (kind = 4 OR NOT unread) AS kept,
  count(*) FILTER (kind <> 4 AND unread) + 1 AS skipped, count(*) FILTER (twice) AS duplicates FROM b GROUP BY owner, format, kind""")
def broker_reports(spark, sf_dir):
    return brokers.broker_report(_files(spark, sf_dir)).drop("warning")


def _exports(spark, sf_dir):
    rows = _held(spark, sf_dir)
    headed = F.col("kind") != 0
    name = F.concat(F.lit('"Acme\n""'), "ticker", F.lit('"", Inc"'))

    def line(shares):
        n = F.when(F.col("unread"), "--").otherwise(shares)
        cost = F.col("cost") * F.col("shares")
        return F.when(headed, F.concat_ws(",", F.concat(F.lower("ticker"), F.lit(" x")), name, n, F.lit("$1.5"), F.lit(""), _money(cost), F.lit("Equity"))).otherwise(F.concat_ws(",", "ticker", n, _money(F.col("cost"))))

    head = F.when(headed, "Symbol,Description,Quantity,Last Price,Current Value,Cost Basis Total,Type\r").otherwise("")
    foot = F.when(headed, '\rSPAXX**,HELD IN MONEY MARKET,,,"$286,850.51",,Cash\r,,,,,,\r').otherwise("\r\r")
    return _bodies(rows, line(F.col("shares").cast("int").cast("string")), line(F.lit("1")), head, foot, "\r")


@query(_HELD + """SELECT CAST(owner AS VARCHAR) AS file, ticker, CAST(CASE WHEN twice THEN 1 ELSE shares END AS DOUBLE) AS shares, round(CAST(CASE WHEN kind = 0 OR NOT twice THEN cost ELSE cost * shares END AS DOUBLE), 4) AS average_cost,
  CASE WHEN kind > 0 THEN 1.5::DOUBLE END AS current_price FROM b WHERE NOT unread""")
def position_holdings(spark, sf_dir):
    """Holdings of exports with line breaks in their fields; later rows of a name replace earlier ones."""
    return rounded(brokers.positions(_exports(spark, sf_dir)).drop("current_value"), 4)


@query(_HELD + """SELECT CAST(owner AS VARCHAR) AS file, count(*) FILTER (NOT unread) + count(*) FILTER (twice) AS imported, count(*) FILTER (unread) AS skipped, CASE WHEN kind > 0 THEN 286850.51::DOUBLE END AS cash FROM b GROUP BY owner, kind""")
def position_reports(spark, sf_dir):
    return rounded(brokers.position_report(_exports(spark, sf_dir)), 2)


_DAYS, _STEPS = (7, 28, 33, 58, 91), tuple(round(0.7 + 0.05 * i, 2) for i in range(13))
_CHAINS = scored_sql("base") + f""", s AS (SELECT c.p_partkey AS k, p_retailprice AS spot, action, risk_score, composite_z, 0.2 + 0.05 * (c.p_partkey % 5) AS implied, 0.6 + 0.2 * ((c.p_partkey // 5) % 5) AS ratio,
  c.p_partkey % 100 AS ivr, 0.05 * (c.p_partkey % 6) AS down, CASE WHEN c.p_partkey % 4 > 0 THEN (c.p_partkey % 4) * 100 - 50 END AS shares FROM scored c JOIN part p ON c.p_partkey = p.p_partkey),
o AS (SELECT k, spot, d, spot * m AS strike, kind, 1 / (1 + exp(1.7 * ln(m) / (implied * sqrt(d / 365.0)))) AS cd, greatest(CASE kind WHEN 'call' THEN spot - spot * m ELSE spot * m - spot END, 0) + 0.4 * spot * implied * sqrt(d / 365.0) * exp(-pow(ln(m) / (implied * sqrt(d / 365.0)), 2) / 2) AS p, m
  FROM s CROSS JOIN (VALUES {', '.join(f'({d})' for d in _DAYS)}) AS e(d) CROSS JOIN (VALUES {', '.join(f'({m}::DOUBLE)' for m in _STEPS)}) AS n(m) CROSS JOIN (VALUES ('call'), ('put')) AS t(kind) WHERE k % 10 <> 9),
q AS (SELECT k, d, kind, strike, CASE kind WHEN 'call' THEN cd ELSE cd - 1 END AS delta, CASE WHEN m > 0.99 AND m < 1.01 THEN p * 0.9 ELSE p + 0.25 END AS premium FROM o WHERE NOT (k % 3 = 1 AND m > 0.84 AND m < 0.86)),
g AS (SELECT k, d, {', '.join(f"min(struct_pack(gap := abs(delta - ({x})), strike := strike, premium := premium, delta := delta)) FILTER (kind = '{kind}') AS {n}" for n, (kind, x) in st.LEGS.items())} FROM q GROUP BY k, d),
w AS (SELECT s.*, i.d AS di, h.d AS dh, {', '.join(f'i.{n} AS i_{n}, h.{n} AS h_{n}' for n in st.LEGS)} FROM s LEFT JOIN (SELECT * FROM g WHERE d = 28) i USING (k) LEFT JOIN (SELECT * FROM g WHERE d = 58) h USING (k)),
z AS (SELECT *, 100 * implied / ratio * sqrt(20 / 252.0) AS sigma, i_call_20.premium - i_call_10.premium + i_put_20.premium - i_put_10.premium AS credit, greatest(i_call_10.strike - i_call_20.strike, i_put_20.strike - i_put_10.strike) AS wide,
  greatest(0, 1 - abs(i_call_20.delta) - abs(i_put_20.delta)) AS likely FROM w),
u AS (SELECT k, 1 AS turn, 'Covered Call' AS name, di AS days, i_call_25.strike AS first_strike, -i_call_25.premium * 100 AS net_cost, (i_call_25.strike - spot + i_call_25.premium) * 100 AS max_profit, -(spot - i_call_25.premium) * 100 AS max_loss,
    spot - i_call_25.premium AS breakeven_low, i_call_25.premium / spot * 100 AS yield_or_cost, i_call_25.premium / spot * 100 * 365 / di * 5 + CASE action WHEN 'Hold' THEN 20 WHEN 'Trim' THEN 10 ELSE 0 END + CASE WHEN ivr >= 50 THEN 15 ELSE 0 END AS score FROM z WHERE shares >= 100 AND action <> 'Buy Now' AND di IS NOT NULL
  UNION ALL SELECT k, 2, 'Protective Put', dh, h_put_25.strike, h_put_25.premium * 100, NULL, -(spot - h_put_25.strike + h_put_25.premium) * 100, spot + h_put_25.premium, -h_put_25.premium / spot * 100,
    (risk_score - 50) * 1.2 + down * 100 + CASE WHEN action = 'Hold' AND risk_score >= 60 THEN 20 ELSE 0 END + greatest(0, 30 - h_put_25.premium / spot * 100 * 365 / dh) FROM z WHERE shares > 0 AND (risk_score >= 55 OR down >= 0.18) AND dh IS NOT NULL
  UNION ALL SELECT k, 3, 'Long Call', dh, h_call_60.strike, h_call_60.premium * 100, NULL, -h_call_60.premium * 100, h_call_60.strike + h_call_60.premium, -h_call_60.premium / spot * 100,
    composite_z * 25 + (1.15 - ratio) * 50 + CASE action WHEN 'Buy Now' THEN 20 ELSE 5 END + least(20, h_call_60.delta / (h_call_60.premium / spot * 100) * 100 / 5) FROM z WHERE action IN ('Buy Now', 'Accumulate') AND ratio < 1.1 AND dh IS NOT NULL
  UNION ALL SELECT k, 4, CASE WHEN ratio > 1.3 THEN 'Vol Arb: Sell Premium' ELSE 'Vol Arb: Buy Premium' END, 0, NULL, 0, 0, 0, 0, 0, abs(ratio - 1) * 100 FROM z WHERE ratio > 1.3 OR ratio < 0.85
  UNION ALL SELECT k, 5, 'Iron Condor', di, i_put_20.strike, -credit * 100, credit * 100, -(wide - credit) * 100, i_put_20.strike - credit, credit / spot * 100, likely * 60 + (5 - sigma) * 4 + (ratio - 1) * 30
    FROM z WHERE sigma <= 5 AND ratio >= 1.1 AND i_call_10.strike > i_call_20.strike AND i_put_10.strike < i_put_20.strike AND credit > 0 AND wide > credit)
SELECT k AS ticker, row_number() OVER (PARTITION BY k ORDER BY least(score, 100) DESC, turn) AS rank, name, days, round(first_strike, 4) AS first_strike, round(net_cost, 4) AS net_cost, round(max_profit, 4) AS max_profit, round(max_loss, 4) AS max_loss,
  round(breakeven_low, 4) AS breakeven_low, round(yield_or_cost, 4) AS yield_or_cost, round(least(score, 100), 4) AS score FROM u"""


@query(_CHAINS)
def option_strategies(spark, sf_dir):
    """Strategies on each part's chain for what is held of it; a tenth of the parts has no chain."""
    k = F.col("p_partkey")
    prices = tables.table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("spot"))
    ratio = 0.6 + 0.2 * (F.floor(k / 5) % 5)
    names = scored(spark, sf_dir, "base").select("p_partkey", "action", "risk_score", F.round("composite_z", 6).alias("composite_z")).join(prices, "p_partkey")
    names = names.withColumns({"ticker": k, "implied": 0.2 + 0.05 * (k % 5), "ratio": ratio, "implied_vol_rank": k % 100, "down_8pct": 0.05 * (k % 6)}).withColumn("forecast", F.col("implied") / F.col("ratio"))
    names = names.withColumn("sigma_20d", F.col("forecast") * 100 * (20 / 252.0) ** 0.5)
    held = names.filter(k % 4 > 0).select("ticker", ((k % 4) * 100 - 50).cast("double").alias("shares"))

    listed = prices.filter(k % 10 != 9).select(k.alias("ticker"), "spot", (0.2 + 0.05 * (k % 5)).alias("implied"), F.explode(F.array(*map(F.lit, _DAYS))).alias("days"))
    listed = listed.withColumn("m", F.explode(F.array(*map(F.lit, _STEPS)))).withColumn("kind", F.explode(F.array(F.lit("call"), F.lit("put"))))
    spread = F.col("implied") * F.sqrt(F.col("days") / 365.0)
    call, m = F.col("kind") == "call", F.col("m")
    up = 1 / (1 + F.exp(1.7 * F.log(m) / spread))
    strike = F.col("spot") * m
    price = F.greatest(F.when(call, F.col("spot") - strike).otherwise(strike - F.col("spot")), F.lit(0.0)) + 0.4 * F.col("spot") * spread * F.exp(-F.pow(F.log(m) / spread, 2.0) / 2)
    at = lambda x: (m > x - 0.01) & (m < x + 0.01)
    unread = (F.col("ticker") % 3 == 1) & at(0.85)  # no price at all
    quotes = F.when(at(1.0) | unread, None)
    chain = listed.select("ticker", F.date_add(F.lit("2024-01-01").cast("date"), F.col("days")).alias("expiration"), "days", "kind", strike.alias("strike"), quotes.otherwise(price).alias("bid"), quotes.otherwise(price + 0.5).alias("ask"), F.when(~unread, price * 0.9).alias("last"), F.when(call, up).otherwise(up - 1).alias("delta"))
    out = st.strategies(names, st.chains(chain), held)
    return rounded(out.select("ticker", "rank", "name", "days", F.get("legs", F.lit(0))["strike"].alias("first_strike"), "net_cost", "max_profit", "max_loss", "breakeven_low", "yield_or_cost", "score"), 4)


@query("""WITH v AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 13 <> 0 THEN p_type ELSE 'Unknown' END AS sector, CASE WHEN p_partkey % 11 <> 0 THEN floor(p_retailprice / 20) END AS x FROM part),
r AS (SELECT *, count(x) OVER m AS n, count(x) OVER s AS ns, rank() OVER (m ORDER BY x) - 1 + (count(*) OVER (PARTITION BY p_size, x) - 1) / 2.0 AS g, rank() OVER (s ORDER BY x) - 1 + (count(*) OVER (PARTITION BY p_size, sector, x) - 1) / 2.0 AS l
  FROM v WHERE x IS NOT NULL WINDOW m AS (PARTITION BY p_size), s AS (PARTITION BY p_size, sector)),
t AS (SELECT *, CASE WHEN n <= 1 THEN 50 ELSE g / (n - 1) * 100 END AS gr, CASE WHEN ns <= 1 THEN 50 ELSE l / (ns - 1) * 100 END AS lr FROM r)
SELECT v.p_partkey, round(CAST(CASE WHEN ns >= 8 THEN (gr + lr) / 2 ELSE gr END AS DOUBLE), 6) AS rank FROM v LEFT JOIN t USING (p_partkey)""")
def sector_adjusted_ranks(spark, sf_dir):
    """Ranks of parts among those of their size, blended with those of their type where it has eight of them."""
    rows = tables.table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 13 != 0, F.col("p_type")).alias("sector"), F.when(F.col("p_partkey") % 11 != 0, F.floor(F.col("p_retailprice") / 20).cast("double")).alias("x"))
    return rounded(groups.sector_adjusted_ranks(rows, "x", "sector", ["p_size"]).select("p_partkey", "rank"))


#: Benchmarks of the fixture's sectors (the first digit of a brand): one without bars, and none for most.
BENCHMARKS, MARKET = {"Brand#1": "Brand#13", "Brand#2": "Brand#99", "Brand#3": "Brand#3"}, ("Brand#98", "Brand#5")


_METRICS = _TAIL + f""", mm AS (SELECT ticker, r20 AS return_20d, r60 AS return_60d, CAST({_clamp('35 + (last > ma50)::INT * 25 + (last > ma200)::INT * 20 + coalesce(r60 > 0, false)::INT * 20')} AS DOUBLE) AS breadth_score,
  {_clamp('vol * 1.25')} AS realized_vol_score, CASE WHEN age > 6 THEN least(sure, 40) WHEN age > 4 THEN least(sure, 60) ELSE sure END AS data_confidence FROM y)"""


def _metrics(spark, sf_dir):
    rows = tables.bars(spark, sf_dir)
    metrics = metrics_of(rows, F.lit("2001-01-03").cast("date"))
    return metrics, metrics.select("ticker", F.when(F.col("ticker") != "Brand#4", F.left("ticker", F.lit(7))).alias("sector"))


@query(_METRICS + """, s AS (SELECT *, CASE WHEN ticker <> 'Brand#4' THEN left(ticker, 7) END AS sector FROM mm), b AS (SELECT *, CASE sector WHEN 'Brand#1' THEN 'Brand#13' WHEN 'Brand#3' THEN 'Brand#3' ELSE 'Brand#5' END AS benchmark FROM s)
SELECT b.ticker, b.sector, benchmark, round(least(greatest(50 + (coalesce(b.return_60d, 0) - coalesce(o.return_60d, 0)) * 1.65 + (coalesce(b.return_20d, 0) - coalesce(o.return_20d, 0)) * 1.05, 0), 100), 6) AS relative_strength_score FROM b JOIN mm o ON o.ticker = benchmark""")
def relative_strength(spark, sf_dir):
    metrics, sectors = _metrics(spark, sf_dir)
    return rounded(groups.relative_strength(metrics, sectors, BENCHMARKS, MARKET).select("ticker", "sector", "benchmark", "relative_strength_score"))


@query(_METRICS + """SELECT left(ticker, 7) AS sector, count(*) AS names, round(avg(breadth_score), 6) AS breadth, NULL::DOUBLE AS volatility FROM mm WHERE ticker <> 'Brand#4' GROUP BY ALL
UNION ALL SELECT NULL, count(*), round(coalesce(avg(breadth_score), 0), 6), round(coalesce(avg(realized_vol_score), 0), 6) FROM mm WHERE data_confidence >= 45""")
def sector_breadth(spark, sf_dir):
    return rounded(groups.breadth(*_metrics(spark, sf_dir)))


@query("""WITH s AS (SELECT CASE WHEN s_suppkey % 7 > 0 THEN 'c' || (s_suppkey % 40) END AS c, CASE WHEN s_suppkey % 40 < 20 THEN 'Nation ' || (s_suppkey % 20) ELSE 'Nation ' || s_nationkey END AS sector, s_name, abs(s_acctbal) / 80 AS strength FROM supplier)
SELECT c AS cluster, CASE WHEN min(sector) = max(sector) THEN lower(min(sector)) ELSE 'cross-sector' END || ' cohort (' || c || ')' AS label, count(*) AS names, array_to_string(list_sort(list(s_name)), ',') AS tickers, round(avg(strength), 6) AS strength, avg(strength) >= 65 AS concentrated
FROM s WHERE c IS NOT NULL GROUP BY c HAVING count(*) >= 2""")
def correlation_cohorts(spark, sf_dir):
    k = F.col("s_suppkey")
    number = F.when(k % 40 < 20, k % 20).otherwise(F.col("s_nationkey")).cast("string")
    rows = tables.table(spark, sf_dir, "supplier").select(F.when(k % 7 > 0, F.concat(F.lit("c"), (k % 40).cast("string"))).alias("c"), F.concat(F.lit("Nation "), number).alias("sector"), "s_name", (F.abs("s_acctbal") / 80).alias("strength"))
    return rounded(groups.cohorts(rows, "c", "s_name", "sector", "strength").withColumn("tickers", F.array_join("tickers", ",")))


_PATHS, _HORIZON = 300, 20


def _horner(x: str, coefficients) -> str:
    out = str(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out}) * {x} + {c}"
    return f"({out})"


def _inverse_sql(u: str) -> str:
    p = f"greatest(1e-9, least(1 - 1e-9, {u}))"
    tail = lambda q: f"{_horner(q, fx.INV_C)} / {_horner(q, fx.INV_D)}"
    low, high, mid = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    return f"CASE WHEN {p} < {fx.INV_LOW} THEN {tail(low)} WHEN {p} > {1 - fx.INV_LOW} THEN -({tail(high)}) ELSE {_horner(f'({mid} * {mid})', fx.INV_A)} * {mid} / {_horner(f'({mid} * {mid})', fx.INV_B)} END"


def _draw_sql(n: str, k: int) -> str:
    """The generator once more, in whole numbers of 128 bits."""
    low = lambda e: f"CAST(({e}) % 4294967296 AS HUGEINT)"
    state = low(f"12345 + (CAST({n} AS HUGEINT) + 1) * {0x6D2B79F5}")
    return f""", s{k} AS (SELECT *, {state} AS a FROM {f't{k - 1}' if k else 'steps'}), m{k} AS (SELECT * EXCLUDE (a), {low('xor(a, a >> 15) * (a | 1)')} AS b FROM s{k}),
n{k} AS (SELECT * EXCLUDE (b), xor(b, {low(f"b + {low('xor(b, b >> 7) * (b | 61)')}")}) AS c FROM m{k}), t{k} AS (SELECT * EXCLUDE (c), CAST(xor(c, c >> 14) AS DOUBLE) / 4294967296 AS u{k} FROM n{k})"""


def _forecast_sql(jumps: bool) -> str:
    draws = 3 if jumps else 1
    drift = "drift - volatility * volatility / 2" + (" - 24 * (exp(-0.02 + 0.5 * 0.05 * 0.05) - 1)" if jumps else "")
    jump = f" + CASE WHEN u1 < 24 / 252.0 THEN -0.02 + 0.05 * ({_inverse_sql('u2')}) ELSE 0 END" if jumps else ""
    return (
        RETS + f""", v AS (SELECT ticker AS key, avg(ret) AS drift, least(stddev_pop(ret) * sqrt(252), 0.6) AS volatility FROM rets GROUP BY ticker),
steps AS (SELECT *, path * {_HORIZON} + day AS n FROM v CROSS JOIN range({_PATHS}) AS p(path) CROSS JOIN range({_HORIZON}) AS d(day))"""
        + "".join(_draw_sql(f"n * {draws} + {k}", k) for k in range(draws))
        + f""", e AS (SELECT key, path, (exp(sum(({drift}) / 252 + volatility / sqrt(252) * ({_inverse_sql('u0')}){jump})) - 1) * 100 AS r FROM t{draws - 1} GROUP BY key, path)
SELECT key, round(avg(r), 5) AS mean_return_pct, round(stddev_pop(r), 5) AS sigma_return_pct, {', '.join(f"round(list_sort(list(r))[{int(q * _PATHS) + 1}], 5) AS p{round(q * 100):02d}" for q in paths.QUANTILES)},
  round(avg((r > 0)::INT), 5) AS prob_up, round(avg((r < -5)::INT), 5) AS prob_down_5pct, round(avg((r < -8)::INT), 5) AS prob_down_8pct, round(avg((r > 5)::INT), 5) AS prob_up_5pct FROM e GROUP BY key"""
    )


def _motions(spark, sf_dir):
    rets = tables.bars(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close").over(panel.by_ticker()) - 1).filter("ret is not null")
    return rets.groupBy(F.col("ticker").alias("key")).agg(F.avg("ret").alias("drift"), F.least(F.stddev_pop("ret") * F.sqrt(F.lit(252.0)), F.lit(0.6)).alias("volatility"))


@query(_forecast_sql(False))
def simulated_paths(spark, sf_dir):
    return rounded(paths.forecast(paths.path_ends(_motions(spark, sf_dir), _PATHS, _HORIZON)), 5)


@query(_forecast_sql(True))
def simulated_jumps(spark, sf_dir):
    """The same with two jumps a month."""
    rows = _motions(spark, sf_dir).withColumns({"intensity": F.lit(24.0), "jump_mean": F.lit(-0.02), "jump_vol": F.lit(0.05)})
    return rounded(paths.forecast(paths.path_ends(rows, _PATHS, _HORIZON)), 5)


_LEDGER = BARS + """, s AS (SELECT date AS as_of, ticker, CASE WHEN date_diff('day', DATE '1970-01-01', date) % 70 = 0 AND right(ticker, 1) = '3' THEN 0 ELSE close END AS price, volume % 100 AS opportunity FROM bars WHERE date_diff('day', DATE '1970-01-01', date) % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY opportunity DESC, ticker) AS place FROM s),
k AS (SELECT * FROM r WHERE place <= 10 ORDER BY as_of DESC, place, ticker LIMIT 1000)"""


def _snapshots(spark, sf_dir):
    """Every tenth day's bars, some without a price."""
    day, bars = F.unix_date("date"), tables.bars(spark, sf_dir)
    missing = (day % 70 == 0) & (F.right("ticker", F.lit(1)) == "3")
    return archive.ranked(bars.filter(day % 10 == 0).select(F.col("date").alias("as_of"), "ticker", F.when(missing, 0.0).otherwise(F.col("close")).alias("price"), (F.col("volume") % 100).alias("opportunity")))


def _outcome_sql(name: str) -> str:
    measured = f"o{name}.price > 0 AND k.price > 0"
    return f"""o{name}.as_of AS measured_at_{name}, round(CASE WHEN o{name}.as_of IS NULL THEN NULL WHEN {measured} THEN (o{name}.price / k.price - 1) * 100 ELSE 0 END, 6) AS return_pct_{name},
  round(o{name}.opportunity - k.opportunity, 6) AS opportunity_delta_{name}, CASE WHEN o{name}.as_of IS NULL THEN 'pending' WHEN {measured} THEN 'measured' ELSE 'priceMissing' END AS status_{name}"""


@query(_LEDGER + f" SELECT k.as_of || ':' || k.ticker AS id, k.as_of, k.ticker, CAST(k.place AS INT) AS place, round(k.price, 6) AS price, k.opportunity, {', '.join(map(_outcome_sql, archive.HORIZONS))} FROM k "
    + " ".join(f"ASOF LEFT JOIN r o{n} ON k.ticker = o{n}.ticker AND k.as_of + {d} <= o{n}.as_of" for n, d in archive.HORIZONS.items()))
def recommendation_ledger(spark, sf_dir):
    """What the first ten names of the newest snapshots came to."""
    return rounded(archive.ledger(_snapshots(spark, sf_dir), 10, 1000))


@query(BARS + f""", n AS (SELECT *, close / lag(close, 5) OVER w - 1 AS predicted, lead(close, 20) OVER w AS e, lead(date, 20) OVER w AS at_end FROM bars WINDOW w AS ({W}))
SELECT ticker, date, round(predicted, 6) AS predicted, round((e - close) / close * 100, 6) AS realized, at_end AS realized_at, 'realized' AS status FROM n
WHERE predicted IS NOT NULL AND e IS NOT NULL AND date_diff('day', date, at_end) <= 370
UNION ALL SELECT ticker, date, round(predicted, 6), NULL, NULL, 'expired' FROM n WHERE predicted IS NOT NULL AND (e IS NULL OR date_diff('day', date, at_end) > 370) AND date + 370 < (SELECT max(date) FROM bars)""")
def late_label_stream(spark, sf_dir):
    """All predictions as a stream that is stopped and started again twice, a third of the days each time."""
    rows = tables.bars(spark, sf_dir).withColumns({"bar": F.row_number().over(panel.by_ticker()), "predicted": F.col("close") / F.lag("close", 5).over(panel.by_ticker()) - 1})
    rows = rows.select("ticker", "bar", F.col("date").cast("timestamp").alias("time"), "close", "predicted", F.when(F.year("date") < 1995, 0).when(F.year("date") < 1997, 1).otherwise(2).alias("part"))
    out = f"{shared_folder(spark)}/tidewater/late-{uuid.uuid4().hex}"
    rows.write.partitionBy("part").parquet(f"{out}/staged")
    staged = spark.read.parquet(f"{out}/staged")
    for part in range(3):
        staged.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{out}/source")
        stream = lambda: spark.readStream.schema(staged.drop("part").schema).parquet(f"{out}/source")
        told = labels.realized_labels(stream(), stream().select("ticker", "bar", "time", "close"))
        done = logs.run_to_end(told, spark, out)
    return rounded(done.select("ticker", F.to_date("time").alias("date"), "predicted", "realized", F.to_date("realized_at").alias("realized_at"), "status"))
