"""Models of each ticker's returns: volatility, roughness, regimes, time-varying beta, tails and jumps.

returns: ticker, date, ret, and market where a beta is asked for. Rows without a return are left out; a ticker has one
row a date, so its series in one row stays small. Sums and lags are windows and grouped aggregates, filters run over
the ordered series in the JVM; only the searches for the parameters of GARCH and Hawkes models are numpy, a series at
a time. Short series have the defaults that each function names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import by_ticker

YEAR = math.sqrt(252)
#: What stands for the parameters of a series that is too short or finds none.
RISK_METRICS = (1e-6, 0.06, 0.0, 0.94)
GJR_DEFAULT = (1e-6, 0.04, 0.07, 0.92)
HAR_DEFAULT = (0.36, 0.28, 0.36)
SHORT_VOLATILITY, SHORT_HURST = 0.2, 0.1
#: Lags of the roughness, and start and defaults of the regimes.
LAGS = (1, 2, 3, 5, 8, 13, 21)
CALM_SHARE, STAY_CALM, STAY_WILD, FIRST_CALM, PASSES = 0.7, 0.95, 0.85, 0.7, 30
SHORT_CALM, SHORT_WILD = 0.0001, 0.001
#: Rows that the recursion of a variance is solved for at once.
BLOCK = 64


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _known(returns: DataFrame) -> DataFrame:
    return returns.filter(F.col("ret").isNotNull() & ~F.isnan("ret"))


# --- sums over lags


def _lagged(returns: DataFrame, spread: bool = False) -> DataFrame:
    """Lags and means of sizes. spread: an own shuffle into a number of partitions that no other has, so that the adaptive plan does not put series that are small in bytes but slow to fit into one task."""
    if spread:
        returns = returns.repartition(2 * int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, "ticker")
    w = by_ticker()
    sizes = _known(returns).withColumns({"size": F.abs("ret"), "place": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("ticker"))})
    of = lambda first, last: F.avg("size").over(w.rowsBetween(first, last))
    log = F.log(F.greatest(F.col("size"), F.lit(1e-8)))
    full = F.col("place") > 22
    return sizes.withColumns({
        "day": F.when(full, F.lag("size").over(w)), "week": F.when(full, of(-5, -1)), "month": F.when(full, of(-22, -1)), "next_week": of(-4, 0), "next_month": of(-21, 0),
        **{f"step_{k}": F.pow(log - F.lag(log, k).over(w), 2) for k in LAGS},
        "by_size": F.row_number().over(Window.partitionBy("ticker").orderBy("size", "place")),
    })


def _har_sums() -> dict[str, Column]:
    x = ["day", "week", "month"]
    pairs = [(a, b) for i, a in enumerate(x) for b in x[i:]] + [("size", a) for a in x]
    known = F.count("day")
    return {f"c_{a}_{b}": known * F.covar_pop(a, b) for a, b in pairs} | {f"m_{a}": F.avg(a) for a in x} | {"m_size": F.avg(F.when(F.col("day").isNotNull(), F.col("size")))} | {f"last_{a}": F.max_by(b, "date") for a, b in zip(x, ("size", "next_week", "next_month"), strict=True)}


def _har(n: Column) -> dict[str, Column]:
    """Least squares of a day's size on the day, week and month before it, and the forecast of the next day's."""
    x = ["day", "week", "month"]
    c = lambda a, b: F.col(f"c_{a}_{b}") if x.index(a) <= x.index(b) else F.col(f"c_{b}_{a}")
    rows = [[c(a, b) for b in x] for a in x]
    told = [F.col(f"c_size_{a}") for a in x]

    def det(m):
        (a, b, c), (d, e, f), (g, h, i) = m
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = det(rows)
    solvable = (n >= 50) & (F.abs(whole) >= 1e-12)
    slopes = [F.when(solvable, det([[told[r] if k == j else rows[r][k] for k in range(3)] for r in range(3)]) / whole).otherwise(HAR_DEFAULT[j]) for j in range(3)]
    level = F.when(n < 50, 0.0).when(~solvable, F.col("m_size")).otherwise(F.col("m_size") - sum(s * F.col(f"m_{a}") for s, a in zip(slopes, x, strict=True)))
    out = {"har_level": level} | {f"har_{a}": s for a, s in zip(x, slopes, strict=True)}
    ahead = out["har_level"] + sum(out[f"har_{a}"] * F.col(f"last_{a}") for a in x)
    return out | {"har_vol": F.when(n < 22, SHORT_VOLATILITY).otherwise(F.greatest(F.lit(0.0), ahead * YEAR))}


def _hurst(n: Column) -> Column:
    """Half the slope of the log mean squared increments of log sizes against log lags, within 0.05 and 0.5."""
    x = [math.log(k) for k in LAGS]
    mean = sum(x) / len(x)
    spread = sum((v - mean) ** 2 for v in x)
    slope = sum(F.log(F.greatest(F.col(f"mean_{k}"), F.lit(1e-24))) * ((v - mean) / spread) for k, v in zip(LAGS, x, strict=True))
    return F.when(n < 100, SHORT_HURST).otherwise(F.least(F.greatest(slope / 2, F.lit(0.05)), F.lit(0.5)))


def har_models(returns: DataFrame) -> DataFrame:
    """Per ticker n, the level and slopes of the HAR model of sizes and its annual forecast; defaults below 50 and 22 returns."""
    sums = _lagged(returns).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in _har_sums().items()])
    return sums.select("ticker", "n", *[v.alias(k) for k, v in _har(F.col("n")).items()])


def hurst_exponents(returns: DataFrame) -> DataFrame:
    """Per ticker n and the roughness of its volatility; 0.1 below 100 returns."""
    sums = _lagged(returns).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"step_{k}").alias(f"mean_{k}") for k in LAGS])
    return sums.select("ticker", "n", _hurst(F.col("n")).alias("hurst"))


# --- filters over a series in order


def _series(*columns: str) -> Column:
    """A group's rows in order of date as structs."""
    return F.array_sort(F.collect_list(F.struct("date", *columns)))


def kalman_beta(series: Column, drift: float = 1e-5, noise: float = 1e-3) -> Column:
    """beta, variance: a beta that walks at random, filtered over structs of ret and market."""

    def step(acc: Column, x: Column) -> Column:
        spread, m = acc["variance"] + drift, x["market"]
        gain = spread * m / F.greatest(F.lit(1e-12), m * m * spread + noise)
        return let(F.struct(spread.alias("spread"), gain.alias("gain")), lambda s: F.struct((acc["beta"] + s["gain"] * (x["ret"] - acc["beta"] * m)).alias("beta"), ((1 - s["gain"] * m) * s["spread"]).alias("variance")))

    return F.aggregate(series, F.struct(F.lit(1.0).alias("beta"), F.lit(1.0).alias("variance")), step)


def kalman_betas(returns: DataFrame) -> DataFrame:
    """Per ticker n, beta, variance: the last estimate of a time-varying beta to market."""
    sums = _known(returns).filter(F.col("market").isNotNull()).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), _series("ret", "market").alias("series"))
    return sums.withColumn("state", kalman_beta(F.col("series"))).select("ticker", "n", "state.beta", "state.variance")


def garch_volatility(series: Column, n: Column, mean: Column, variance: Column, omega: Column, alpha: Column, gamma: Column, beta: Column) -> Column:
    """Annual volatility after the recursion over all returns but the last; 0.2 below five of them."""

    def step(h: Column, x: Column) -> Column:
        e = x["ret"] - mean
        return omega + (alpha + F.when(e < 0, gamma).otherwise(0.0)) * e * e + beta * h

    return F.when(n < 5, SHORT_VOLATILITY).otherwise(F.sqrt(F.aggregate(F.slice(series, 1, F.greatest(n - 1, F.lit(0)).cast("int")), variance, step) * 252))


def garch_forecasts(returns: DataFrame, parameters: tuple[float, float, float, float] = RISK_METRICS) -> DataFrame:
    """Per ticker n and the annual volatility by given omega, alpha, gamma (of falls only) and beta.

    The recursion from the sample variance is a sum with powers of beta as weights, so no series is put in one row.
    """
    omega, alpha, gamma, beta = parameters
    every = Window.partitionBy("ticker")
    rows = _known(returns).withColumns({"n": F.count(F.lit(1)).over(every), "mean": F.avg("ret").over(every), "back": F.row_number().over(every.orderBy(F.col("date").desc()))})
    e = F.col("ret") - F.col("mean")
    added = omega + (alpha + F.when(e < 0, gamma).otherwise(0.0)) * e * e
    sums = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.var_pop("ret").alias("variance"), F.sum(F.when(F.col("back") > 1, added * F.pow(F.lit(beta), F.col("back") - 2))).alias("added"))
    return sums.select("ticker", "n", F.when(F.col("n") < 5, SHORT_VOLATILITY).otherwise(F.sqrt((F.col("added") + F.col("variance") * F.pow(F.lit(beta), F.col("n") - 1)) * 252)).alias("garch_vol"))


_REGIME = ("calm_mean", "calm_variance", "wild_mean", "wild_variance", "stay_calm", "stay_wild", "wild_probability")


def _pass(series: Column, told: Column) -> Column:
    """One pass of the filter under the parameters told, and the parameters that follow from its sums.

    The probabilities of both regimes add to one, so what the calm one and its moves sum to tells the wild one's.
    """

    def constants(side: str) -> list[Column]:
        v = told[f"{side}_variance"]
        return [F.when(v > 0, 1 / (2 * v)).otherwise(0.0).alias(f"{side}_by"), F.when(v > 0, 1 / F.sqrt(2 * math.pi * v)).otherwise(0.0).alias(f"{side}_top")]

    names = ("p", "first", "n", "calm", "calm_r", "calm_rr", "all_r", "all_rr", "cc")

    def filtered(k: Column) -> Column:
        start = F.struct(*[F.lit(v).alias(name) for name, v in zip(names, (FIRST_CALM, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), strict=True)])

        def step(acc: Column, row: Column) -> Column:
            x, p = row["ret"], acc["p"]
            near = lambda side: k[f"{side}_top"] * F.exp(-(x - told[f"{side}_mean"]) * (x - told[f"{side}_mean"]) * k[f"{side}_by"])
            ahead = p * told["stay_calm"] + (1 - p) * (1 - told["stay_wild"])
            after = lambda q: F.struct(
                q.alias("p"), F.when(acc["n"] == 0, q).otherwise(acc["first"]).alias("first"), (acc["n"] + 1).alias("n"), (acc["calm"] + q).alias("calm"), (acc["calm_r"] + q * x).alias("calm_r"),
                (acc["calm_rr"] + q * x * x).alias("calm_rr"), (acc["all_r"] + x).alias("all_r"), (acc["all_rr"] + x * x).alias("all_rr"), F.when(acc["n"] == 0, 0.0).otherwise(acc["cc"] + p * q).alias("cc"),
            )
            share = lambda d: let(F.when(d["a"] + d["b"] > 0, d["a"] / (d["a"] + d["b"])).otherwise(0.5), after)
            return let(F.struct((ahead * near("calm")).alias("a"), ((1 - ahead) * near("wild")).alias("b")), share)

        return F.aggregate(series, start, step)

    def moves(s: Column) -> Column:
        """Rows, sums and sums of squares of either regime, and how often each stays or is left."""
        before, after = s["calm"] - s["p"], s["calm"] - s["first"]
        return F.struct(
            s["calm"].alias("calm"), s["calm_r"].alias("calm_r"), s["calm_rr"].alias("calm_rr"), (s["n"] - s["calm"]).alias("wild"), (s["all_r"] - s["calm_r"]).alias("wild_r"), (s["all_rr"] - s["calm_rr"]).alias("wild_rr"),
            s["cc"].alias("cc"), before.alias("c"), (s["n"] - 1 - before - after + s["cc"]).alias("ww"), (s["n"] - 1 - before).alias("w"), (1 - s["p"]).alias("last"),
        )

    def follows(s: Column) -> Column:
        mean = lambda k: F.when(s[k] > 0, s[f"{k}_r"] / s[k]).otherwise(told[f"{k}_mean"])
        variance = lambda k: F.when(s[k] > 0, F.greatest(F.lit(0.0), s[f"{k}_rr"] / s[k] - F.pow(s[f"{k}_r"] / s[k], 2))).otherwise(told[f"{k}_variance"])
        stay = lambda kept, of, old: F.when(s[of] > 0, s[kept] / s[of]).otherwise(told[old])
        return F.struct(*[v.alias(k) for k, v in zip(_REGIME, (mean("calm"), variance("calm"), mean("wild"), variance("wild"), stay("cc", "c", "stay_calm"), stay("ww", "w", "stay_wild"), s["last"]), strict=True)])

    def ordered(t: Column) -> Column:
        swap = lambda a, b: F.when(t["wild_variance"] < t["calm_variance"], t[b]).otherwise(t[a])
        pairs = (("calm_mean", "wild_mean"), ("calm_variance", "wild_variance"), ("wild_mean", "calm_mean"), ("wild_variance", "calm_variance"), ("stay_calm", "stay_wild"), ("stay_wild", "stay_calm"))
        return F.struct(*[swap(a, b).alias(a) for a, b in pairs], t["wild_probability"].alias("wild_probability"))

    return let(let(F.struct(*constants("calm"), *constants("wild")), filtered), lambda s: let(moves(s), lambda m: let(follows(m), ordered)))


def _regime_sums() -> dict[str, Column]:
    calm = F.col("by_size") <= F.floor(F.col("n") * CALM_SHARE)
    of = lambda f, side: F.coalesce(f(F.when(side, F.col("ret"))), F.lit(0.0))
    return {"calm_mean": of(F.avg, calm), "calm_variance": of(F.var_pop, calm), "wild_mean": of(F.avg, ~calm), "wild_variance": of(F.var_pop, ~calm)}


def regimes(series: Column, n: Column, passes: int = PASSES) -> Column:
    """Two regimes by passes of a filter, begun from the smaller returns (calm) and the others; columns of _regime_sums."""
    first = F.struct(*[F.col(k).alias(k) for k in _REGIME[:4]], F.lit(STAY_CALM).alias("stay_calm"), F.lit(STAY_WILD).alias("stay_wild"), F.lit(0.0).alias("wild_probability"))
    short = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(_REGIME, (0, SHORT_CALM, 0, SHORT_WILD, STAY_CALM, STAY_WILD, 0), strict=True)])
    return F.when(n < 50, short).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(passes)), first, lambda told, _: _pass(series, told)))


def return_regimes(returns: DataFrame) -> DataFrame:
    """Per ticker n, means, variances and stay probabilities of a calm and a wild regime, and the last day's probability of the wild one."""
    sums = _lagged(returns, spread=True).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), _series("ret").alias("series"), *[v.alias(k) for k, v in _regime_sums().items()])
    return sums.withColumn("told", regimes(F.col("series"), F.col("n"))).select("ticker", "n", "told.*")


# --- searches


def simplex_minimum(f, start, steps: int, tolerance: float, nudge: float = 1.05, zero: float = 0.025, expand: bool = True) -> np.ndarray:
    """Nelder and Mead's simplex search; points outside the domain cost infinity."""
    points = [np.array(start, float)]
    for i in range(len(start)):
        p = points[0].copy()
        p[i] = p[i] * nudge if p[i] else zero
        points.append(p)
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if np.isfinite(values[-1]) and values[-1] - values[0] < tolerance:
            return points[0]
        middle = np.mean(points[:-1], axis=0)
        mirrored = 2 * middle - points[-1]
        v = f(mirrored)
        if expand and v < values[0]:
            far = 3 * middle - 2 * points[-1]
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (mirrored, v)
        elif v < values[-2]:
            points[-1], values[-1] = mirrored, v
        else:
            near = (middle + points[-1]) / 2
            w = f(near)
            if w < values[-1]:
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [(points[0] + p) / 2 for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


_AHEAD = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]


def variance_path(added: np.ndarray, beta: float, start: float) -> np.ndarray:
    """h[i] = added[i] + beta * h[i - 1], h[-1] = start: within blocks by a matrix of powers, the rest carried over."""
    blocks = -(-len(added) // BLOCK)
    rows = np.zeros(blocks * BLOCK)
    rows[: len(added)] = added
    powers = np.where(_AHEAD >= 0, beta ** np.maximum(_AHEAD, 0), 0.0)
    out = rows.reshape(blocks, BLOCK) @ powers.T
    carry = beta ** np.arange(1, BLOCK + 1)
    for row in out:
        row += start * carry
        start = row[-1]
    return out.ravel()[: len(added)]


def fit_garch(returns: np.ndarray, falls: bool = False) -> tuple[float, float, float, float]:
    """omega, alpha, gamma, beta of the largest Gaussian likelihood; gamma, the weight of falls, is 0 unless asked for."""
    default = GJR_DEFAULT if falls else RISK_METRICS
    if len(returns) < (100 if falls else 50):
        return default
    r = returns - returns.mean()
    square, variance = r * r, r.var()
    fallen = np.where(r < 0, square, 0.0)

    def whole(p):
        return p if falls else (p[0], p[1], 0.0, p[2])

    def allowed(omega, alpha, gamma, beta) -> bool:
        return omega > 0 and beta > 0 and (alpha >= 0 and gamma >= 0 if falls else alpha > 0) and alpha + beta + gamma / 2 < 0.999

    def cost(p):
        omega, alpha, gamma, beta = whole(p)
        if not allowed(omega, alpha, gamma, beta):
            return np.inf
        h = variance_path(omega + alpha * square[:-1] + gamma * fallen[:-1], beta, variance)
        return float(0.5 * (np.log(2 * np.pi * h) + square[1:] / h).sum()) if (h > 0).all() else np.inf

    start = (variance * (1 - 0.04 - 0.07 / 2 - 0.92), 0.04, 0.07, 0.92) if falls else (variance * (1 - 0.06 - 0.92), 0.06, 0.92)
    found = tuple(map(float, whole(simplex_minimum(cost, start, 300 if falls else 200, 1e-6))))
    return found if all(map(math.isfinite, found)) and allowed(*found) else default


def fit_hawkes(days: np.ndarray, n: int) -> tuple[float, float, float]:
    """Yearly baseline, excitation and decay of jumps at days 0 to n - 1; no jumps are told by fewer than three."""
    if len(days) < 3 or n <= 0:
        return 0.0, 0.0, 0.5
    times, end = np.asarray(days, float) / 252, n / 252
    gaps = np.diff(times)

    def cost(p):
        base, more, decay = p
        if base <= 0 or more < 0 or decay <= 0 or more >= decay:
            return np.inf
        carried, logs = 0.0, math.log(max(1e-12, base))
        for fall in np.exp(-decay * gaps):
            carried = fall * (1 + carried)
            logs += math.log(max(1e-12, base + more * carried))
        return base * end + more / decay * float((1 - np.exp(-decay * (end - times))).sum()) - logs

    base, more, decay = map(float, simplex_minimum(cost, (max(0.1, len(times) / end / 2), 0.5, 1.0), 200, 1e-5, 1.1, 0.05, False))
    return (base, more, decay) if base > 0 and decay > 0 and more < decay else (len(times) / end, 0.0, 1.0)


_FITTED = "omega double, alpha double, gamma double, beta double"


def _fitted(falls: bool):
    @F.pandas_udf(_FITTED)
    def fitted(series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fit_garch(np.asarray(r, float), falls) for r in series], columns=["omega", "alpha", "gamma", "beta"])

    return fitted


def volatility_models(returns: DataFrame) -> DataFrame:
    """All volatility models and the time-varying beta of each ticker, from one shuffle of returns."""
    n = F.col("n")
    sums = _lagged(returns, spread=True).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.var_pop("ret").alias("variance"), _series("ret", "market").alias("series"),
        *[F.avg(f"step_{k}").alias(f"mean_{k}") for k in LAGS], *[v.alias(k) for k, v in (_har_sums() | _regime_sums()).items()],
    )
    r = F.transform("series", lambda x: x["ret"])
    told = sums.withColumns({"garch": _fitted(False)(r), "gjr": _fitted(True)(r), "regime": regimes(F.col("series"), n), "kalman": kalman_beta(F.filter("series", lambda x: x["market"].isNotNull()))})
    vol = lambda of: garch_volatility(F.col("series"), n, F.col("mean"), F.col("variance"), *[F.col(f"{of}.{k}") for k in ("omega", "alpha", "gamma", "beta")])
    har = _har(n)
    return told.select(
        "ticker", "n", "garch.omega", "garch.alpha", "garch.beta", vol("garch").alias("garch_vol"),
        *[F.col(f"gjr.{k}").alias(f"gjr_{k}") for k in ("omega", "alpha", "gamma", "beta")], vol("gjr").alias("gjr_vol"), har["har_vol"].alias("har_vol"), _hurst(n).alias("hurst"),
        (F.sqrt("regime.calm_variance") * YEAR).alias("calm_vol"), (F.sqrt("regime.wild_variance") * YEAR).alias("wild_vol"), "regime.wild_probability",
        F.col("kalman.beta").alias("kalman_beta"), F.col("kalman.variance").alias("kalman_variance"),
    )


# --- tails, sizes, jumps


def extreme_tails(returns: DataFrame, from_share: float = 0.9, alpha: float = 0.95, top: int = 50) -> DataFrame:
    """Per ticker the generalised Pareto tail of its losses in percent, and value at risk and shortfall by it.

    The shape is Hill's over the ``top`` largest losses beyond the threshold, the loss at ``from_share`` of them. Below
    ten such losses, or if one of the top is no loss, shape and scale are 0.2 and 1; without any, both figures are 0.
    """
    each = Window.partitionBy("ticker")
    rows = _known(returns).select("ticker", "date", (F.col("ret") * -100).alias("loss"))
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(each), "at": F.row_number().over(each.orderBy("loss", "date")) - 1})
    rows = rows.withColumn("threshold", F.max(F.when(F.col("at") == F.floor(F.col("n") * from_share), F.col("loss"))).over(each))
    beyond = F.col("loss") > F.col("threshold")
    rows = rows.withColumn("m", F.count(F.when(beyond, 1)).over(each)).withColumn("k", F.least(F.lit(top), F.col("m") - 1)).withColumn("down", F.col("n") - 1 - F.col("at"))
    log = F.when(F.col("loss") > 0, F.log("loss"))
    sums = rows.groupBy("ticker").agg(
        F.max("n").alias("n"), F.max("m").alias("exceedances"), F.max("threshold").alias("threshold"), F.avg(F.when(beyond, F.col("loss") - F.col("threshold"))).alias("mean"),
        (F.avg(F.when(F.col("down") < F.col("k"), log)) - F.max(F.when(F.col("down") == F.col("k"), log))).alias("hill"),
    )
    enough = (F.col("exceedances") >= 10) & F.col("hill").isNotNull()
    told = sums.withColumns({
        "shape": F.when(enough, F.least(F.greatest(F.col("hill"), F.lit(-0.5)), F.lit(0.99))).otherwise(0.2),
        "scale": F.when(enough, F.greatest(F.lit(0.001), F.col("mean") * (1 - F.col("hill")))).otherwise(1.0),
        "tail": F.when(F.col("exceedances") > 0, F.col("n") / F.col("exceedances") * (1 - alpha)),
    })
    shape, scale, u = F.col("shape"), F.col("scale"), F.col("threshold")
    told = told.withColumn("evt_var", F.coalesce(u + F.when(F.abs(shape) < 1e-8, scale * -F.log("tail")).otherwise(scale / F.when(shape != 0, shape) * (F.pow("tail", -shape) - 1)), F.lit(0.0)))
    shortfall = F.when(F.col("exceedances") > 0, (F.col("evt_var") + scale - shape * u) / (1 - shape)).otherwise(0.0)
    return told.select("ticker", "n", "exceedances", "threshold", "shape", "scale", "evt_var", shortfall.alias("evt_cvar"))


def cvar_fraction(mean: Column, cvar: Column, aversion: float = 1.5, most: float = 0.3) -> Column:
    """The share up to ``most`` that maximises mean - aversion * cvar: both grow with the share alike, so it is all or nothing."""
    return F.when(mean > aversion * cvar, most).otherwise(0.0)


def jump_days(returns: DataFrame, sigmas: float = 3.0, window: int = 22) -> DataFrame:
    """ticker, day, ret, n: returns beyond the band of the ``window`` ones before; day counts from 0."""
    trailing = by_ticker().rowsBetween(-window, -1)
    rows = _known(returns).withColumns({"day": F.row_number().over(by_ticker()) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("ticker")), "mu": F.avg("ret").over(trailing), "sd": F.stddev_pop("ret").over(trailing)})
    jumped = (F.col("day") >= window) & (F.col("sd") > 0) & (F.abs(F.col("ret") - F.col("mu")) > sigmas * F.col("sd"))
    return rows.withColumn("jumped", jumped).select("ticker", "day", "ret", "n", "jumped")


def hawkes_jumps(returns: DataFrame, recent: int = 30) -> DataFrame:
    """Per ticker its jumps, the yearly baseline, excitation and decay of a self-exciting process, and the next day's intensity by the ``recent`` last ones."""

    @F.pandas_udf("baseline double, excitation double, decay double")
    def fitted(days: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fit_hawkes(d, int(k)) for d, k in zip(days, n, strict=True)], columns=["baseline", "excitation", "decay"])

    sums = jump_days(returns).groupBy("ticker").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("jumped"), F.col("day")))).alias("days"))
    told = sums.withColumn("told", fitted("days", "n")).select("ticker", "n", F.size("days").alias("jumps"), "days", "told.*")
    return told.withColumn("next_intensity", hawkes_intensity(F.slice("days", F.greatest(F.size("days") - recent + 1, F.lit(1)), F.lit(recent)), F.col("n") + 1)).drop("days")


def hawkes_intensity(days: Column, at: Column) -> Column:
    """Intensity at a day after jumps at days, by columns baseline, excitation and decay."""
    return F.aggregate(days, F.col("baseline"), lambda acc, d: acc + F.when(at > d, F.col("excitation") * F.exp(-F.col("decay") * (at - d) / 252)).otherwise(0.0))
