"""Registered queries on models of return series: volatility, roughness, beta over time, regimes, tails, sizes and jumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import models, risk
from ..sources.tables import bars
from .market import RETS, W, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def returns(spark, sf_dir):
    return risk.simple_returns(bars(spark, sf_dir))


def with_market(spark, sf_dir):
    rets = returns(spark, sf_dir)
    return rets.join(rets.groupBy("date").agg(F.avg("ret").alias("market")), "date")


@query()
def volatility_models(spark, sf_dir):
    return models.volatility_models(with_market(spark, sf_dir))


_BEFORE = lambda a, b: f"avg(size) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {a} PRECEDING AND {b})"
_C = lambda a, b: f"count(d) * covar_pop({a}, {b}) FILTER (d IS NOT NULL)"
HAR = RETS + f""", s AS (SELECT ticker, date, abs(ret) AS size FROM rets),
l AS (SELECT *, row_number() OVER ({W}) AS place, lag(size) OVER ({W}) AS d0, {_BEFORE(5, '1 PRECEDING')} AS w0, {_BEFORE(22, '1 PRECEDING')} AS m0, {_BEFORE(4, 'CURRENT ROW')} AS w1, {_BEFORE(21, 'CURRENT ROW')} AS m1 FROM s),
f AS (SELECT *, CASE WHEN place > 22 THEN d0 END AS d, CASE WHEN place > 22 THEN w0 END AS w, CASE WHEN place > 22 THEN m0 END AS m, CASE WHEN place > 22 THEN size END AS y FROM l),
g AS (SELECT ticker, count(*) AS n, {_C('d', 'd')} AS dd, {_C('d', 'w')} AS dw, {_C('d', 'm')} AS dm, {_C('w', 'w')} AS ww, {_C('w', 'm')} AS wm, {_C('m', 'm')} AS mm, {_C('y', 'd')} AS yd, {_C('y', 'w')} AS yw, {_C('y', 'm')} AS ym,
  avg(y) AS my, avg(d) AS md, avg(w) AS mw, avg(m) AS mmo, max_by(size, date) AS ld, max_by(w1, date) AS lw, max_by(m1, date) AS lm FROM f GROUP BY ticker),
t AS (SELECT *, dd * (ww * mm - wm * wm) - dw * (dw * mm - wm * dm) + dm * (dw * wm - ww * dm) AS det FROM g),
b AS (SELECT *, n >= 50 AND abs(det) >= 1e-12 AS ok FROM t),
k AS (SELECT *, CASE WHEN ok THEN (yd * (ww * mm - wm * wm) - dw * (yw * mm - wm * ym) + dm * (yw * wm - ww * ym)) / det ELSE 0.36 END AS bd,
  CASE WHEN ok THEN (dd * (yw * mm - wm * ym) - yd * (dw * mm - wm * dm) + dm * (dw * ym - yw * dm)) / det ELSE 0.28 END AS bw,
  CASE WHEN ok THEN (dd * (ww * ym - yw * wm) - dw * (dw * ym - yw * dm) + yd * (dw * wm - ww * dm)) / det ELSE 0.36 END AS bm FROM b),
o AS (SELECT *, CASE WHEN n < 50 THEN 0 WHEN NOT ok THEN my ELSE my - bd * md - bw * mw - bm * mmo END AS b0 FROM k)
SELECT ticker, n, round(b0, 6) AS har_level, round(bd, 6) AS har_day, round(bw, 6) AS har_week, round(bm, 6) AS har_month, round(CASE WHEN n < 22 THEN 0.2 ELSE greatest(0, (b0 + bd * ld + bw * lw + bm * lm) * sqrt(252)) END, 6) AS har_vol FROM o"""


@query(HAR)
def har_forecasts(spark, sf_dir):
    return rounded(models.har_models(returns(spark, sf_dir)))


@query(RETS + f""", s AS (SELECT ticker, date, ln(greatest(abs(ret), 1e-8)) AS v FROM rets),
j AS (SELECT ticker, unnest({list(models.LAGS)}) AS k, unnest([{', '.join(f'v - lag(v, {k}) OVER ({W})' for k in models.LAGS)}]) AS d FROM s),
m AS (SELECT ticker, k, count(*) AS n, ln(greatest(avg(d * d), 1e-24)) AS y FROM j GROUP BY ALL)
SELECT ticker, max(n) AS n, round(CASE WHEN max(n) < 100 THEN 0.1 ELSE least(greatest(regr_slope(y, ln(k)) / 2, 0.05), 0.5) END, 6) AS hurst FROM m GROUP BY ticker""")
def hurst_exponents(spark, sf_dir):
    return rounded(models.hurst_exponents(returns(spark, sf_dir)))


@query(RETS + """, mk AS (SELECT date, avg(ret) AS market FROM rets GROUP BY date),
s AS (SELECT ticker, count(*) AS n, list({'y': ret, 'm': market, 'b': 0::DOUBLE, 'p': 0::DOUBLE} ORDER BY date) AS xs FROM rets JOIN mk USING (date) GROUP BY ticker),
k AS (SELECT ticker, n, list_reduce(xs, lambda a, x: {'y': x.y, 'm': x.m,
  'b': a.b + (a.p + 1e-5) * x.m / greatest(1e-12, x.m * x.m * (a.p + 1e-5) + 1e-3) * (x.y - a.b * x.m),
  'p': (1 - (a.p + 1e-5) * x.m / greatest(1e-12, x.m * x.m * (a.p + 1e-5) + 1e-3) * x.m) * (a.p + 1e-5)}, {'y': 0::DOUBLE, 'm': 0::DOUBLE, 'b': 1::DOUBLE, 'p': 1::DOUBLE}) AS z FROM s)
SELECT ticker, n, round(z.b, 6) AS beta, round(z.p, 6) AS variance FROM k""")
def kalman_betas(spark, sf_dir):
    return rounded(models.kalman_betas(with_market(spark, sf_dir)))


def _garch_sql(omega: float, alpha: float, gamma: float, beta: float) -> str:
    return RETS + f""", s AS (SELECT ticker, count(*) AS n, var_pop(ret) AS v, list(ret ORDER BY date) AS xs, avg(ret) AS mu FROM rets GROUP BY ticker),
e AS (SELECT ticker, n, v, list_transform(xs[:-2], lambda x: {{'a': {omega} + ({alpha} + CASE WHEN x < mu THEN {gamma} ELSE 0 END) * (x - mu) * (x - mu), 'h': 0::DOUBLE}}) AS es FROM s)
SELECT ticker, n, round(CASE WHEN n < 5 THEN 0.2 ELSE sqrt(252 * (list_reduce(es, lambda s, x: {{'a': x.a, 'h': x.a + {beta} * s.h}}, {{'a': 0::DOUBLE, 'h': v}})).h) END, 6) AS garch_vol FROM e"""


@query(_garch_sql(*models.RISK_METRICS))
def garch_forecasts(spark, sf_dir):
    return rounded(models.garch_forecasts(returns(spark, sf_dir)))


@query(_garch_sql(*models.GJR_DEFAULT))
def gjr_forecasts(spark, sf_dir):
    return rounded(models.garch_forecasts(returns(spark, sf_dir), models.GJR_DEFAULT))


@query()
def return_regimes(spark, sf_dir):
    return models.return_regimes(returns(spark, sf_dir))


@query(RETS + """, l AS (SELECT ticker, date, -100 * ret AS loss FROM rets),
s AS (SELECT ticker, count(*) AS n, list_sort(list(loss)) AS xs FROM l GROUP BY ticker),
u AS (SELECT *, xs[CAST(floor(n * 0.9) AS BIGINT) + 1] AS threshold FROM s),
b AS (SELECT *, list_reverse(list_filter(xs, lambda x: x > threshold)) AS top FROM u),
k AS (SELECT *, len(top) AS exceedances, least(50, len(top) - 1) AS k FROM b),
h AS (SELECT *, CASE WHEN exceedances >= 10 AND top[k + 1] > 0 THEN list_avg(list_transform(top[1:k], lambda x: ln(x / top[k + 1]))) END AS hill FROM k),
p AS (SELECT *, CASE WHEN hill IS NULL THEN 0.2 ELSE least(greatest(hill, -0.5), 0.99) END AS shape,
  CASE WHEN hill IS NULL THEN 1 ELSE greatest(0.001, (list_avg(top) - threshold) * (1 - hill)) END AS scale FROM h),
v AS (SELECT *, CASE WHEN exceedances = 0 THEN 0 WHEN abs(shape) < 1e-8 THEN threshold - scale * ln(n / exceedances * (1 - 0.95))
  ELSE threshold + scale / shape * (pow(n / exceedances * (1 - 0.95), -shape) - 1) END AS q FROM p)
SELECT ticker, n, exceedances, round(threshold, 6) AS threshold, round(shape, 6) AS shape, round(scale, 6) AS scale, round(q, 6) AS evt_var,
  round(CASE WHEN exceedances = 0 THEN 0 ELSE (q + scale - shape * threshold) / (1 - shape) END, 6) AS evt_cvar FROM v""")
def extreme_tails(spark, sf_dir):
    return rounded(models.extreme_tails(returns(spark, sf_dir)))


@query(RETS + """, s AS (SELECT ticker, count(*) AS n, avg(ret) * 252 AS mu, var_pop(ret) * 252 AS v, avg(ret) AS day, list_sort(list(ret)) AS xs FROM rets GROUP BY ticker),
c AS (SELECT *, CAST(floor((1 - 0.95) * n) AS BIGINT) AS cut FROM s),
t AS (SELECT *, CASE WHEN cut = 0 THEN -xs[1] ELSE -list_avg(xs[1:cut]) END AS cvar, CASE WHEN v > 0 THEN greatest(0, least(1, (mu - 0.045) / v)) ELSE 0 END AS kelly FROM c)
SELECT ticker, round(kelly, 6) AS kelly, round(kelly * 0.5, 6) AS half_kelly, CASE WHEN day > 1.5 * cvar THEN 0.3 ELSE 0 END::DOUBLE AS cvar_fraction FROM t""")
def position_sizes(spark, sf_dir):
    told = risk.risk_summary(returns(spark, sf_dir))
    kelly = fx.kelly(F.col("mean") * 252, F.col("std") * F.col("std") * 252)
    return rounded(told.select("ticker", kelly.alias("kelly"), (kelly * 0.5).alias("half_kelly"), models.cvar_fraction(F.col("mean"), F.col("cvar")).alias("cvar_fraction")))


@query(RETS + f""", b AS (SELECT ticker, ret, row_number() OVER ({W}) - 1 AS day, avg(ret) OVER r AS mu, stddev_pop(ret) OVER r AS sd FROM rets WINDOW r AS ({W} ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING))
SELECT ticker, day, round(ret, 6) AS ret FROM b WHERE day >= 22 AND sd > 0 AND abs(ret - mu) > 3 * sd""")
def jump_days(spark, sf_dir):
    return rounded(models.jump_days(returns(spark, sf_dir)).filter("jumped").select("ticker", F.col("day").cast("long"), "ret"))


@query()
def hawkes_jumps(spark, sf_dir):
    return models.hawkes_jumps(returns(spark, sf_dir))
