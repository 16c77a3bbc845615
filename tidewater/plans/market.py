"""Registered market queries over the fixture tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import events, joins, panel, risk
from ..sources.tables import bars, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


BARS = """WITH bars AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
W = "PARTITION BY ticker ORDER BY date"
RETS = BARS + f""", rets AS (
  SELECT * FROM (SELECT ticker, date, close / lag(close) OVER ({W}) - 1 AS ret FROM bars) WHERE ret IS NOT NULL)"""
PANEL = BARS + f""", panel AS (
  SELECT ticker, date, (lag(close, 1) OVER w / lag(close, 21) OVER w - 1) * 100 AS momentum_20d,
         (lead(close, 20) OVER w / close - 1) * 100 AS fwd_20d FROM bars WINDOW w AS ({W})),
known AS (SELECT * FROM panel WHERE momentum_20d IS NOT NULL AND fwd_20d IS NOT NULL)"""


def momentum_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = panel.by_ticker()
    momentum = (F.lag("close", 1).over(w) / F.lag("close", 21).over(w) - 1) * 100
    label = (F.lead("close", 20).over(w) / F.col("close") - 1) * 100
    return bars(spark, sf_dir).select("ticker", "date", momentum.alias("momentum_20d"), label.alias("fwd_20d"))


@query(BARS + " SELECT ticker, date, round(close, 6) AS close, round(high, 6) AS high, round(low, 6) AS low, volume FROM bars")
def daily_bars(spark, sf_dir):
    return rounded(bars(spark, sf_dir))


@query(PANEL + """, r AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY momentum_20d) + (count(*) OVER (PARTITION BY date, momentum_20d) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY date ORDER BY fwd_20d) + (count(*) OVER (PARTITION BY date, fwd_20d) - 1) / 2.0 AS b FROM known)
SELECT date, count(*) AS n, round(coalesce(covar_pop(momentum_20d, fwd_20d) / nullif(stddev_pop(momentum_20d) * stddev_pop(fwd_20d), 0), 0), 6) AS ic,
  round(coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 0), 6) AS rank_ic
FROM r GROUP BY date HAVING count(*) >= 5""")
def momentum_ic(spark, sf_dir):
    return rounded(panel.information_coefficients(momentum_panel(spark, sf_dir), "momentum_20d", "fwd_20d"))


_BACK = lambda k: f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
_F20, _F60 = _BACK(20), _BACK(60)


@query(BARS + f""", r AS (SELECT *, ln(close / lag(close) OVER ({W})) AS ret, close / lag(close) OVER ({W}) - 1 AS simple FROM bars)
SELECT ticker, date, row_number() OVER ({W}) - 1 AS n_before,
  {', '.join(f"round((lag(close, 1) OVER ({W}) / lag(close, {k + 1}) OVER ({W}) - 1) * 100, 6) AS {n}" for n, k in (('momentum_5d', 5), ('momentum_20d', 20), ('momentum_60d', 60), ('momentum_120d', 120), ('reversal_1d', 1)))},
  round(stddev_pop(ret) OVER {_F20} * sqrt(252), 6) AS volatility_20d, round(stddev_pop(ret) OVER {_F60} * sqrt(252), 6) AS volatility_60d,
  round(avg(volume) OVER {_F20} / avg(volume) OVER {_F60}, 6) AS volume_trend_20_60,
  round(lag(close, 1) OVER ({W}) / max(close) OVER {_F60}, 6) AS price_to_high_60d, round(lag(close, 1) OVER ({W}) / min(close) OVER {_F60}, 6) AS price_to_low_60d,
  round(lag(close, 1) OVER ({W}) / avg(close) OVER {_F20} - 1, 6) AS sma_20_distance,
  round((lag(close, 1) OVER ({W}) - max(close) OVER {_F60}) / max(close) OVER {_F60}, 6) AS drawdown_60d,
  round(avg((high - low) / close) OVER {_F20}, 6) AS range_compression_20d,
  round(avg(CASE WHEN volume * close > 0 THEN abs(ret) / (volume * close) END) OVER {_F20} * 1e8, 4) AS amihud_illiquidity_20d,
  round(greatest(0, max(simple * 100) OVER {_BACK(21)}), 6) AS max_daily_ret_21d,
  round(sqrt(coalesce(avg(CASE WHEN ret < 0 THEN ret * ret END) OVER {_F60}, 0)) * sqrt(252), 6) AS downside_vol_60d,
  round(ln(greatest(0.01, lag(close, 1) OVER ({W}))), 6) AS log_price_level
FROM r QUALIFY row_number() OVER ({W}) > 252""")
def price_features(spark, sf_dir):
    names = "ticker date n_before momentum_5d momentum_20d momentum_60d momentum_120d reversal_1d volatility_20d volatility_60d volume_trend_20_60 price_to_high_60d price_to_low_60d sma_20_distance drawdown_60d range_compression_20d max_daily_ret_21d downside_vol_60d log_price_level".split()
    rows = panel.price_features(bars(spark, sf_dir)).withColumnRenamed("last_close_over_sma_20", "sma_20_distance")
    return rounded(rows.select(*names, F.round("amihud_illiquidity_20d", 4).alias("amihud_illiquidity_20d")))


@query(BARS + f""" SELECT ticker, date, {', '.join(f"round((lead(close, {k}) OVER ({W}) / close - 1) * 100, 6) AS fwd_{k}d, lead(date, {k}) OVER ({W}) AS label_end_{k}d" for k in (5, 20, 60, 120))} FROM bars""")
def forward_labels(spark, sf_dir):
    return rounded(panel.forward_labels(bars(spark, sf_dir)))


@query(PANEL + """ SELECT ticker, date, round(CASE WHEN count(*) OVER d >= 5 THEN fwd_20d - avg(fwd_20d) OVER d ELSE fwd_20d END, 6) AS fwd_20d_rel FROM known WINDOW d AS (PARTITION BY date)""")
def relative_labels(spark, sf_dir):
    rows = momentum_panel(spark, sf_dir).filter("momentum_20d is not null and fwd_20d is not null")
    return rounded(panel.demeaned(rows, "fwd_20d", "fwd_20d_rel").select("ticker", "date", "fwd_20d_rel"))


@query(PANEL + """, s AS (SELECT date, count(*) n, sum(momentum_20d) s, sum(momentum_20d * momentum_20d) ss, avg(momentum_20d) mu, stddev_pop(momentum_20d) sd FROM known GROUP BY date),
e AS (SELECT *, sum(n) OVER u N2, sum(s) OVER u S2, sum(ss) OVER u SS2 FROM s WINDOW u AS (ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT ticker, date, round((momentum_20d - CASE WHEN n >= 5 THEN mu ELSE S2 / N2 END) / greatest(CASE WHEN n >= 5 THEN sd ELSE sqrt(greatest(SS2 / N2 - (S2 / N2) ** 2, 0)) END, 1e-6), 6) AS z
FROM known JOIN e USING (date)""")
def cross_section_z(spark, sf_dir):
    rows = momentum_panel(spark, sf_dir).filter("momentum_20d is not null and fwd_20d is not null")
    return rounded(panel.zscored(rows, "momentum_20d", "z").select("ticker", "date", "z"))


@query(PANEL + """ SELECT ticker, date, round(CASE WHEN count(*) OVER d <= 1 THEN 50 ELSE (rank() OVER (PARTITION BY date ORDER BY momentum_20d) - 1 + (count(*) OVER (PARTITION BY date, momentum_20d) - 1) / 2.0) / (count(*) OVER d - 1) * 100 END, 6) AS percentile
FROM panel WHERE momentum_20d IS NOT NULL WINDOW d AS (PARTITION BY date)""")
def momentum_percentiles(spark, sf_dir):
    return rounded(panel.percentiles(momentum_panel(spark, sf_dir), "momentum_20d").select("ticker", "date", "percentile"))


@query(PANEL + """, p AS (SELECT *, count(*) OVER (PARTITION BY date) n, row_number() OVER (PARTITION BY date ORDER BY momentum_20d, ticker) place FROM known),
k AS (SELECT *, greatest(1, n // 5) k FROM p WHERE n >= 5)
SELECT date, round(avg(fwd_20d) FILTER (place > n - k), 6) AS top, round(avg(fwd_20d) FILTER (place <= k), 6) AS bottom, round(avg(fwd_20d) FILTER (place > n - k) - avg(fwd_20d) FILTER (place <= k), 6) AS spread FROM k GROUP BY date""")
def quintile_spread(spark, sf_dir):
    return rounded(panel.quintile_spreads(momentum_panel(spark, sf_dir), "momentum_20d", "fwd_20d"))


@query(RETS + """, m AS (SELECT ticker, count(*) n, avg(ret) mean, stddev_pop(ret) sd, sqrt(coalesce(avg(ret * ret) FILTER (ret < 0), 0)) down FROM rets GROUP BY ticker),
o AS (SELECT ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY ret, date) - 1 AS place FROM rets)
SELECT ticker, n, round(max(-ret) FILTER (place = floor((1 - 0.95::DOUBLE) * n)), 6) AS var, round(avg(-ret) FILTER (place < floor((1 - 0.95::DOUBLE) * n)), 6) AS cvar,
  round(any_value(mean / sd) * sqrt(252), 6) AS sharpe, round(any_value(mean / down) * sqrt(252), 6) AS sortino FROM o JOIN m USING (ticker) GROUP BY ticker, n""")
def tail_risk(spark, sf_dir):
    return rounded(risk.risk_summary(risk.simple_returns(bars(spark, sf_dir))).select("ticker", "n", "var", "cvar", "sharpe", "sortino"))


@query()
def risk_moments(spark, sf_dir):
    summary = risk.risk_summary(risk.simple_returns(bars(spark, sf_dir)))
    psr = fx.probabilistic_sharpe("sharpe_daily", "n", "skew", "kurt")
    return rounded(summary.select("ticker", "skew", "kurt", "cornish_fisher_var", psr.alias("psr")))


@query(BARS + f""", f AS (SELECT ticker, (close / max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1) * 100 AS fall FROM bars) SELECT ticker, round(min(fall), 6) AS max_drawdown FROM f GROUP BY ticker""")
def max_drawdown(spark, sf_dir):
    return rounded(risk.drawdowns(bars(spark, sf_dir)))


@query(RETS + """, mk AS (SELECT date, avg(ret) AS market FROM rets GROUP BY date)
SELECT ticker, round(coalesce(covar_pop(ret, market) / nullif(var_pop(market), 0), 1), 6) AS beta, count(*) AS n FROM rets JOIN mk USING (date) GROUP BY ticker""")
def market_beta(spark, sf_dir):
    rets = risk.simple_returns(bars(spark, sf_dir))
    return rounded(risk.betas(rets, rets.groupBy("date").agg(F.avg("ret").alias("ret"))))


_ASOF = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS back FROM orders)
SELECT l.o_orderkey, l.o_custkey, r.o_orderkey AS asof_orderkey, round(r.o_totalprice, 6) AS asof_totalprice
FROM orders l ASOF LEFT JOIN (SELECT * FROM o WHERE back = 1) r ON l.o_custkey = r.o_custkey AND l.o_orderdate {} r.o_orderdate"""


def _asof(spark, sf_dir, strict):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = joins.asof_join(orders, orders, "o_custkey", "o_orderdate", "o_orderdate", ["o_orderkey", "o_totalprice"], strict)
    return rounded(out.select("o_orderkey", "o_custkey", F.col("asof.o_orderkey").alias("asof_orderkey"), F.col("asof.o_totalprice").alias("asof_totalprice")))


@query(_ASOF.format(">"))
def asof_strict(spark, sf_dir):
    return _asof(spark, sf_dir, True)


@query(_ASOF.format(">="))
def asof_inclusive(spark, sf_dir):
    return _asof(spark, sf_dir, False)


@query("SELECT c_nationkey, c_custkey, round(abs(c_acctbal - 5000), 6) AS gap FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal - 5000), c_custkey) = 1")
def nearest_balance(spark, sf_dir):
    return rounded(joins.nearest(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", 5000.0, ["c_custkey"]))


@query("""SELECT user_id, event_id, from_state, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events) WHERE from_state <> event_type""")
def action_transitions(spark, sf_dir):
    return events.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "from_state", "event_type")


@query("""SELECT from_state, event_type AS to_state, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events) WHERE from_state <> event_type GROUP BY ALL""")
def transition_matrix(spark, sf_dir):
    moves = events.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return rounded(events.pair_matrix(moves, "event_type", "value"))


@query("""WITH c AS (SELECT user_id, event_id, ts, event_type FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type)
SELECT user_id, event_id, event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 60""")
def decision_log(spark, sf_dir):
    return events.change_log(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def holdings_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return rounded(events.newest_per_key(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts"))


@query("""WITH v AS (SELECT p_type AS sector, sum(l_extendedprice) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT sector, round(value, 2) AS value, round(value / sum(value) OVER () * 100, 6) AS weight_pct, round(value / sum(value) OVER () * 100 - 100.0 / count(*) OVER (), 6) AS drift_pct FROM v""")
def sector_weights(spark, sf_dir):
    trades = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    v = trades.groupBy(F.col("p_type").alias("sector")).agg(F.sum("l_extendedprice").alias("value"))
    total = Window.partitionBy(F.lit(1))
    share = F.col("value") / F.sum("value").over(total) * 100
    return v.select("sector", F.round("value", 2).alias("value"), F.round(share, 6).alias("weight_pct"), F.round(share - 100.0 / F.count(F.lit(1)).over(total), 6).alias("drift_pct"))


@query(RETS + """, s AS (SELECT ticker, avg(ret) / stddev_pop(ret) * sqrt(count(*)) AS t FROM rets GROUP BY ticker), p AS (SELECT ticker AS name, round(exp(-abs(t)), 9) AS p FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM p)
SELECT name, p, coalesce(k <= max(CASE WHEN p <= k / m * 0.1 THEN k END) OVER (), false) AS kept FROM r""")
def false_discoveries(spark, sf_dir):
    t = risk.simple_returns(bars(spark, sf_dir)).groupBy("ticker").agg((F.avg("ret") / F.stddev_pop("ret") * F.sqrt(F.count(F.lit(1)))).alias("t"))
    return risk.benjamini_hochberg(t.select(F.col("ticker").alias("name"), F.round(F.exp(-F.abs("t")), 9).alias("p")))


def _erf_sql(z: str) -> str:
    t = f"(1 / (1 + {fx.ERF_P} * abs({z})))"
    poly = "0"
    for a in fx.ERF_A[::-1]:
        poly = f"(({poly}) * {t} + {a})"
    return f"(sign({z}) * (1 - {poly} * {t} * exp(-({z}) * ({z}))))"


_N = lambda z: f"(0.5 * (1 + {_erf_sql(f'(({z}) / sqrt(2.0))')}))"
_F = lambda z: f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()))"
_OPTION = {
    "call": f"s * {_N('d1')} - k * fall * {_N('d2')}", "put": f"k * fall * {_N('-d2')} - s * {_N('-d1')}", "call_delta": _N("d1"), "put_delta": f"{_N('d1')} - 1",
    "gamma": f"{_F('d1')} / (s * v * sqrt(t))", "vega": f"s * {_F('d1')} * sqrt(t) / 100", "call_theta": f"(decay - r * k * fall * {_N('d2')}) / 365", "put_theta": f"(decay + r * k * fall * {_N('-d2')}) / 365",
    "call_rho": f"k * t * fall * {_N('d2')} / 100", "put_rho": f"-k * t * fall * {_N('-d2')} / 100", "prob_above": _N("d2"), "prob_below": f"1 - {_N('d2')}",
}


@query(f"""WITH o AS (SELECT p_partkey, p_retailprice AS s, p_retailprice * 0.95::DOUBLE AS k, 0.5::DOUBLE AS t, 0.045::DOUBLE AS r, 0.25::DOUBLE AS v FROM part),
d AS (SELECT *, (ln(s / k) + (r + v * v / 2) * t) / (v * sqrt(t)) AS d1, exp(-r * t) AS fall FROM o), e AS (SELECT *, d1 - v * sqrt(t) AS d2, -s * {_F('d1')} * v / (2 * sqrt(t)) AS decay FROM d)
SELECT p_partkey, {', '.join(f'round({e}, 6) AS {n}' for n, e in _OPTION.items())} FROM e""")
def option_prices(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("spot"))
    cols = fx.bsm(F.col("spot"), F.col("spot") * 0.95, 0.5, 0.045, 0.25)
    return rounded(rows.select("p_partkey", *[c.alias(n) for n, c in cols.items()]))


_WORDS = ", ".join(f"'{w}'" for w in events.NEGATIVE_WORDS)


@query(f"SELECT doc_id, len(list_filter([{_WORDS}], lambda k: contains(lower(coalesce(text, '')), k))) AS hits FROM documents")
def keyword_risk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", events.negative_words("text").cast("long").alias("hits"))


@query(f"""WITH a AS (SELECT source AS symbol, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 21 - 10) / 2.0 END AS tone, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS seen, len(list_filter([{_WORDS}], lambda k: contains(lower(coalesce(text, '')), k))) > 0 AS bad FROM documents),
s AS (SELECT symbol, count(*) AS articles, count(*) FILTER (bad) AS negative_articles, coalesce(avg(tone), 0) AS tone, max(seen) AS latest FROM a GROUP BY symbol),
p AS (SELECT *, CAST(least(greatest(34 + articles * 2.2 + negative_articles * 8, 0), 100) AS DOUBLE) AS pressure_score FROM s)
SELECT symbol, articles, negative_articles, round(tone, 6) AS tone, latest, pressure_score, round((pressure_score + least(greatest(50 - tone * 5 + negative_articles * 6, 0), 100)) / 2, 6) AS event_risk_score FROM p""")
def event_risk(spark, sf_dir):
    """Documents as articles on their source."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("symbol"), "text", F.when(k % 3 > 0, (k % 21 - 10) / 2).alias("tone"), F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + k * 3600).alias("seen_at"))
    return rounded(events.event_risk(docs, "symbol", "text", "tone", "seen_at"))
