"""Models of return series against plain versions of their definitions, and their edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import models
from tidewater.plans import volatility

SCHEMA = "ticker string, date int, ret double, market double"


def wild(n, seed=8, ticker="a"):
    rng, rows, vol = random.Random(seed), [], 0.01
    for d in range(n):
        vol = 0.002 + 0.8 * vol + 0.1 * abs(rng.gauss(0, vol)) if d > n // 6 else 0.04  # the oldest returns are the wildest
        market = rng.gauss(0, vol)
        rows.append((ticker, d, 1.3 * market + rng.gauss(0, vol), market))
    return rows


def plain_path(r, omega, alpha, gamma, beta):
    """Variances before each return."""
    e = r - r.mean()
    h = [r.var()]
    for x in e[:-1]:
        h.append(omega + (alpha + (gamma if x < 0 else 0)) * x * x + beta * h[-1])
    return np.array(h), e


def plain_regimes(r):
    by_size = sorted(range(len(r)), key=lambda i: (abs(r[i]), i))
    cut = math.floor(len(r) * 0.7)
    groups = [np.array([r[i] for i in by_size[:cut]]), np.array([r[i] for i in by_size[cut:]])]
    mu, var, stay = [g.mean() for g in groups], [g.var() for g in groups], [0.95, 0.85]
    for _ in range(30):
        p, told = [0.7, 0.3], []
        for x in r:
            ahead = [p[0] * stay[0] + p[1] * (1 - stay[1]), p[0] * (1 - stay[0]) + p[1] * stay[1]]
            like = [ahead[k] * math.exp(-((x - mu[k]) ** 2) / (2 * var[k])) / math.sqrt(2 * math.pi * var[k]) for k in (0, 1)]
            p = [v / sum(like) for v in like] if sum(like) > 0 else [0.5, 0.5]
            told.append(p)
        t = np.array(told)
        for k in (0, 1):
            mu[k] = (t[:, k] * r).sum() / t[:, k].sum()
            var[k] = (t[:, k] * (r - mu[k]) ** 2).sum() / t[:, k].sum()
            stay[k] = (t[:-1, k] * t[1:, k]).sum() / t[:-1, k].sum()
        if var[1] < var[0]:
            mu, var, stay = mu[::-1], var[::-1], stay[::-1]
    return (mu[0], var[0], mu[1], var[1], stay[0], stay[1], t[-1, 1])


def test_models_read_whole_series(spark):
    n = 3000
    rows = wild(n)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = models.volatility_models(frame).collect()
    assert len(got) == 1 and got[0]["n"] == n
    got = got[0]
    r = np.array([x[2] for x in rows])
    for names, vol, falls in ((("omega", "alpha", None, "beta"), "garch_vol", False), (("gjr_omega", "gjr_alpha", "gjr_gamma", "gjr_beta"), "gjr_vol", True)):
        told = [got[k] if k else 0.0 for k in names]
        assert told[0] > 0 and told[3] > 0 and told[1] + told[3] + told[2] / 2 < 0.999
        h, e = plain_path(r, *told)
        assert got[vol] == pytest.approx(math.sqrt(h[-1] * 252))
        cost = lambda p: 0.5 * sum(math.log(2 * math.pi * v) + x * x / v for v, x in zip(*[a[1:] for a in plain_path(r, *p)], strict=True))
        start = (r.var() * (1 - 0.04 - 0.035 - 0.92), 0.04, 0.07, 0.92) if falls else (r.var() * 0.02, 0.06, 0.0, 0.92)
        assert cost(told) < cost(start) and np.isfinite(h).all()
    beta, spread = 1.0, 1.0
    for _, _, y, x in rows:
        spread += 1e-5
        gain = spread * x / (x * x * spread + 1e-3)
        beta, spread = beta + gain * (y - beta * x), (1 - gain * x) * spread
    assert (got["kalman_beta"], got["kalman_variance"]) == pytest.approx((beta, spread))
    size = np.abs(r)
    x = np.array([[1, size[t - 1], size[t - 5 : t].mean(), size[t - 22 : t].mean()] for t in range(22, n + 1)])
    b = np.linalg.solve(x[:-1].T @ x[:-1], x[:-1].T @ size[22:])
    assert got["har_vol"] == pytest.approx(max(0.0, x[-1] @ b) * math.sqrt(252))
    y = np.log(np.maximum(size, 1e-8))
    slope = np.polyfit(np.log(models.LAGS), [math.log(((y[k:] - y[:-k]) ** 2).mean()) for k in models.LAGS], 1)[0]
    assert got["hurst"] == pytest.approx(min(max(slope / 2, 0.05), 0.5))
    want = plain_regimes(r)
    assert (got["calm_vol"], got["wild_vol"], got["wild_probability"]) == pytest.approx((math.sqrt(want[1] * 252), math.sqrt(want[3] * 252), want[6]), rel=1e-6)
    assert got["calm_vol"] < got["wild_vol"]


def test_regimes(spark):
    rng = random.Random(3)
    rows = [(t, d, rng.gauss(0, 0.004 if (d // 60) % 3 else 0.03), None) for t in ("a", "b") for d in range(400)] + [("short", d, 0.01 * d, None) for d in range(49)] + [("flat", d, 0.0, None) for d in range(80)]
    got = {r["ticker"]: r for r in models.return_regimes(spark.createDataFrame(rows, SCHEMA)).collect()}
    for t in ("a", "b"):
        want = plain_regimes(np.array([x[2] for x in rows if x[0] == t]))
        assert tuple(got[t])[2:] == pytest.approx(want, rel=1e-6, abs=1e-12)
    assert tuple(got["short"])[2:] == (0.0, 0.0001, 0.0, 0.001, 0.95, 0.85, 0.0)
    assert got["flat"]["n"] == 80 and not math.isnan(got["flat"]["wild_probability"])


def test_variance_path_over_blocks():
    added = np.random.default_rng(1).random(1000)
    for n in (1, 63, 64, 65, 1000):
        h, want = 0.7, []
        for a in added[:n]:
            h = a + 0.93 * h
            want.append(h)
        assert models.variance_path(added[:n], 0.93, 0.7) == pytest.approx(want)


def test_fits_are_stationary_and_short_series_have_defaults():
    rng = random.Random(5)
    r = np.array([(rng.random() - 0.5) * 0.04 for _ in range(300)])
    omega, alpha, gamma, beta = models.fit_garch(r[:250])
    assert omega > 0 and alpha > 0 and beta > 0 and gamma == 0 and alpha + beta < 1
    omega, alpha, gamma, beta = models.fit_garch(r, True)
    assert alpha >= 0 and gamma >= 0 and beta > 0 and alpha + beta + gamma / 2 < 1
    assert models.fit_garch(r[:49]) == models.RISK_METRICS and models.fit_garch(r[:99], True) == models.GJR_DEFAULT
    omega, alpha, gamma, beta = models.fit_garch(np.zeros(200))  # no variance: the search goes on from the nudged omega
    assert 0 < omega < 1e-6 and alpha > 0 and beta > 0 and alpha + beta < 1


def test_simplex_finds_a_minimum():
    found = models.simplex_minimum(lambda p: (p[0] - 3) ** 2 + 2 * (p[1] + 1) ** 2 + 1, (1.0, 0.0), 200, 1e-12)
    assert found == pytest.approx((3, -1), abs=1e-4)


def test_hawkes(spark):
    days = np.array([30, 31, 33, 34, 120, 121, 122, 300, 301, 303, 304, 305])
    base, more, decay = models.fit_hawkes(days, 400)
    assert base > 0 and decay > 0 and 0 <= more < decay

    def cost(base, more, decay):  # each jump by all before it
        t, end = days / 252, 400 / 252
        logs = sum(math.log(base + more * sum(math.exp(-decay * (t[i] - t[j])) for j in range(i))) for i in range(len(t)))
        return base * end + sum(more / decay * (1 - math.exp(-decay * (end - x))) for x in t) - logs

    assert cost(base, more, decay) <= cost(len(days) / (400 / 252) / 2, 0.5, 1.0)
    assert models.fit_hawkes(days[:2], 400) == (0.0, 0.0, 0.5)
    rng = random.Random(2)
    rows = [("a", d, rng.gauss(0, 0.01) + (0.2 if d in (50, 51, 90, 140) else 0), None) for d in range(200)] + [("b", d, 0.01, None) for d in range(3)]
    got = {r["ticker"]: r for r in models.hawkes_jumps(spark.createDataFrame(rows, SCHEMA)).collect()}
    jumps = [r["day"] for r in models.jump_days(spark.createDataFrame(rows, SCHEMA)).filter("jumped").orderBy("day").collect()]
    a = got["a"]
    assert a["jumps"] == len(jumps) >= 3 and set(jumps) >= {50, 90, 140}
    assert a["next_intensity"] == pytest.approx(a["baseline"] + sum(a["excitation"] * math.exp(-a["decay"] * (201 - d) / 252) for d in jumps[-30:]))
    assert (got["b"]["jumps"], got["b"]["next_intensity"]) == (0, 0.0)


def test_tails(spark):
    rng = random.Random(4)
    rows = [("a", d, rng.paretovariate(3) / -100, None) for d in range(800)] + [("few", d, d / 100 - 0.2, None) for d in range(40)] + [("one", 0, 0.01, None), ("gains", 0, 0.5, None)] + [("gains", d, 0.1 + d / 1000, None) for d in range(1, 200)]
    got = {r["ticker"]: r for r in models.extreme_tails(spark.createDataFrame(rows, SCHEMA)).collect()}
    losses = sorted(-100 * x[2] for x in rows if x[0] == "a")
    u = losses[720]
    top = sorted((x for x in losses if x > u), reverse=True)
    k = min(50, len(top) - 1)
    shape = sum(math.log(x / top[k]) for x in top[:k]) / k
    scale = (sum(top) / len(top) - u) * (1 - shape)
    q = u + scale / shape * ((800 / len(top) * 0.05) ** -shape - 1)
    assert tuple(got["a"])[1:] == pytest.approx((800, len(top), u, shape, scale, q, (q + scale - shape * u) / (1 - shape)))
    assert got["a"]["evt_cvar"] > got["a"]["evt_var"] > 0
    assert (got["few"]["exceedances"], got["few"]["shape"], got["few"]["scale"]) == (3, 0.2, 1.0)
    assert tuple(got["one"])[2:] == (0, -1.0, 0.2, 1.0, 0.0, 0.0)
    assert (got["gains"]["shape"], got["gains"]["scale"]) == (0.2, 1.0)


def test_cvar_fraction_is_the_best_of_a_grid(spark):
    def best(mean, cvar):
        grid = [f / 100 for f in range(31)]
        return max(grid, key=lambda f: (f * mean - 1.5 * f * cvar, -f))

    cases = [(0.1, 0.05), (0.1, 0.2), (-0.1, 0.0), (0.0, 0.0), (0.1, -0.3)]
    got = [r[0] for r in spark.createDataFrame(cases, "m double, c double").select(models.cvar_fraction(F.col("m"), F.col("c"))).collect()]
    assert got == [best(*c) for c in cases]


def test_edges(spark):
    """Null and not-a-number returns are left out; short series have the named defaults; an empty table has no rows."""
    rows = [("x", d, 0.01, 0.01) for d in range(4)] + [("x", 9, None, 0.0), ("x", 10, float("nan"), 0.0), (None, 1, 0.02, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["ticker"]: r for r in models.volatility_models(frame).collect()}
    assert got["x"]["n"] == 4 and (got["x"]["garch_vol"], got["x"]["har_vol"], got["x"]["hurst"], got["x"]["alpha"]) == (0.2, 0.2, 0.1, 0.06)
    assert got[None]["n"] == 1 and got[None]["kalman_beta"] == 1.0
    for f in (models.volatility_models, models.har_models, models.hurst_exponents, models.kalman_betas, models.garch_forecasts, models.return_regimes, models.extreme_tails, models.hawkes_jumps):
        assert f(frame.limit(0)).count() == 0


@pytest.mark.parametrize("parameters", [models.RISK_METRICS, models.GJR_DEFAULT])
def test_garch_sum_is_the_recursion(spark, parameters):
    rows = wild(500)
    h, _ = plain_path(np.array([x[2] for x in rows]), *parameters)
    got = models.garch_forecasts(spark.createDataFrame(rows, SCHEMA), parameters).first()
    assert got["garch_vol"] == pytest.approx(math.sqrt(h[-1] * 252))


def test_queries_without_sql(spark):
    for name in set(volatility.QUERIES) - set(volatility.ORACLE_SQL):
        assert volatility.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_hurst_by_mean_squares(spark):
    rng = random.Random(3)
    level, r = 0.0, []
    for _ in range(400):
        level = 0.97 * level + rng.gauss(0, 1)
        r.append(0.01 * math.exp(level) * rng.choice((-1, 1)))
    r[5] = 0.0
    y = [math.log(max(1e-8, abs(x))) for x in r]
    points = [(math.log(k), math.log(sum((y[i] - y[i - k]) ** 2 for i in range(k, 400)) / (400 - k))) for k in (1, 2, 3, 5, 8, 13, 21)]
    mx, my = (sum(p[i] for p in points) / 7 for i in (0, 1))
    slope = sum((a - mx) * (b - my) for a, b in points) / sum((a - mx) ** 2 for a, _ in points)
    frame = spark.createDataFrame([("a", i, x) for i, x in enumerate(r)] + [("b", i, x) for i, x in enumerate(r[:99])], "ticker string, date int, ret double")
    got = {x["ticker"]: x["hurst"] for x in models.hurst_exponents(frame).collect()}
    assert 0.05 < slope / 2 < 0.5 and got == {"a": pytest.approx(slope / 2), "b": 0.1}
