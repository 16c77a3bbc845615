"""Cross-sectional decision scores: scenarios, factor composites, ordered action rules, sectors, transitions.

A universe is scored in two steps, as a model is: universe_stats reads it once and gives one row of means and
deviations; score_universe is a projection with these as constants, so it has no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.columns import clamp, js_round, scorer_cdf

# The inputs of each factor; the last two factors are better when low.
FACTORS = {
    "momentum": ("trend20", "trend60", "trend120", "relativeStrength", "residualStrength"),
    "quality": ("quality", "marginTrend", "freeCashFlowTrend"),
    "value": ("valuationSupport",),
    "growth": ("revenueAcceleration", "revisionTrend", "surpriseMomentum", "growthSensitivity"),
    "lowVol": ("realizedVol", "impliedVolRank", "drawdownRisk"),
    "fragility": ("skewRisk", "crowding", "eventRisk", "impliedVolRank"),
}
INVERTED = {"lowVol", "fragility"}
# The inputs of the risk score and their factors.
RISK = {"drawdownRisk": 1.0, "skewRisk": 1.0, "eventRisk": 1.0, "realizedVol": 1.0, "creditSensitivity": 0.4, "rateSensitivity": 0.3, "liquidity": -0.5}
FIELDS = tuple(dict.fromkeys([f for fields in FACTORS.values() for f in fields] + [*RISK, "breadth", "defensiveScore"]))
# Shocks in order, as field, constant, fields whose sum is divided, divisor (negative: a fall).
SCENARIOS = {
    "base": (),
    "volJump": (("impliedVolRank", 18, (), 1), ("skewRisk", 14, (), 1), ("drawdownRisk", 0, ("growthSensitivity",), 8), ("relativeStrength", 0, ("crowding",), -12)),
    "creditStress": (("creditSensitivity", 18, (), 1), ("drawdownRisk", 0, ("creditSensitivity",), 7), ("breadth", 0, ("creditSensitivity",), -8), ("relativeStrength", 0, ("creditSensitivity",), -10)),
    "growthBreak": (("relativeStrength", 0, ("growthSensitivity",), -7), ("residualStrength", 0, ("growthSensitivity",), -8), ("revisionTrend", 0, ("growthSensitivity",), -12), ("defensiveScore", 10, (), 1)),
    "ratesFall": (("rateSensitivity", 8, (), 1), ("relativeStrength", 0, ("rateSensitivity", "growthSensitivity"), 18), ("drawdownRisk", 0, ("defensiveScore",), -18), ("valuationSupport", 0, ("rateSensitivity",), 12)),
}
# The first condition that holds names the regime, the action; the rank is the action's place in lists.
REGIMES = (
    ("credit-stress", (("risk", ">", 65), ("credit", ">", 60))),
    ("late-cycle", (("risk", ">", 60), ("breadth", "<", 45))),
    ("growth-favorable", (("trend", ">", 60), ("growth", ">", 55), ("breadth", ">", 55))),
    ("risk-on-broad", (("trend", ">", 55), ("breadth", ">", 60))),
    ("defensive", (("risk", "<", 50), ("breadth", "<", 55))),
)
ACTIONS = (
    ("Sell", "thesis_damage >= 60 AND risk_z >= 1"),
    ("Trim", "thesis_damage >= 56 OR (risk_z >= 1 AND alpha < 50)"),
    ("Avoid", "alpha < 10 OR (alpha < 20 AND risk_z >= 1)"),
    ("Buy Now", "alpha >= 80 AND composite_z >= 1.645 AND agreement >= 60 AND risk_z <= 1"),
    ("Accumulate", "alpha >= 67 AND composite_z >= 0.5 AND agreement >= 50 AND risk_z <= 1"),
)
ACTION_RANKS = {"Buy Now": 1, "Accumulate": 2, "Hold": 3, "Trim": 4, "Sell": 5, "Avoid": 6}
SIDES = {"Buy Now": "bullish", "Accumulate": "bullish", "Hold": "neutral", "Trim": "bearish", "Sell": "bearish", "Avoid": "bearish"}


def first_of(rules, otherwise: str) -> Column:
    """The name of the first rule that holds."""
    return reduce(lambda late, rule: F.when(F.expr(rule[1]), rule[0]).otherwise(late), reversed(rules), F.lit(otherwise))


def mapped(column: str, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(column)]


def apply_scenario(signals: DataFrame, scenario: str = "base") -> DataFrame:
    """The shocks one after the other: a later one sees the fields that earlier ones moved. Fields stay within 0 and 100."""
    for field, constant, sources, divisor in SCENARIOS[scenario]:
        moved = F.col(field) + float(constant)
        if sources:
            size = js_round(reduce(lambda a, b: a + b, map(F.col, sources)) / abs(divisor))
            moved = moved + size if divisor > 0 else moved - size
        signals = signals.withColumn(field, clamp(moved, 0, 100))
    return signals


def universe_stats(signals: DataFrame) -> Row:
    """One row of field means and population deviations (1 at least); an input without values counts as 50 and 1."""
    means = [F.coalesce(F.avg(f), F.lit(50.0)).alias(f"mean_{f}") for f in FIELDS]
    spreads = [F.greatest(F.coalesce(F.stddev_pop(f), F.lit(1.0)), F.lit(1.0)).alias(f"std_{f}") for f in FIELDS]
    return signals.agg(*means, *spreads).first()


def risk_parity(stats: Row) -> dict[str, float]:
    """Weights in inverse proportion to each factor's dispersion."""
    inverse = {name: len(fields) / sum(stats[f"std_{f}"] for f in fields) for name, fields in FACTORS.items()}
    return {name: x / sum(inverse.values()) for name, x in inverse.items()}


def market_regime(stats: Row) -> Column:
    """The regime that the universe's means name; a constant, which Spark folds."""
    means = {"risk": "drawdownRisk", "credit": "creditSensitivity", "breadth": "breadth", "trend": "trend60", "growth": "growthSensitivity"}

    def holds(limits) -> Column:
        tests = [F.lit(stats[f"mean_{means[name]}"]) > F.lit(float(x)) if sign == ">" else F.lit(stats[f"mean_{means[name]}"]) < F.lit(float(x)) for name, sign, x in limits]
        return reduce(lambda a, b: a & b, tests)

    return reduce(lambda late, rule: F.when(holds(rule[1]), rule[0]).otherwise(late), reversed(REGIMES), F.lit("mixed"))


def mean_known(values: list[Column]) -> Column:
    """The mean of the values that are not null; 0 without any."""
    known = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), 1).otherwise(0) for v in values])
    return F.coalesce(F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values]), known), F.lit(0.0))


def score_universe(signals: DataFrame, stats: Row) -> DataFrame:
    """Factor z's, composite, scores and action of each signal. A null input is left out of its factor's mean."""
    z = lambda f: (F.col(f) - F.lit(stats[f"mean_{f}"])) / F.lit(stats[f"std_{f}"])
    weights, names = risk_parity(stats), [f"{name}_z" for name in FACTORS]
    signed = {f"{name}_z": (-1 if name in INVERTED else 1) * mean_known([z(f) for f in fields]) for name, fields in FACTORS.items()}
    df = signals.withColumns(signed | {"risk_z": mean_known([z(f) * by for f, by in RISK.items()])})
    weighed = lambda some: reduce(lambda a, b: a + b, [F.col(f"{n}_z") * F.lit(weights[n]) for n in some])
    count = lambda test: reduce(lambda a, b: a + b, [F.when(test(F.col(n)), 1).otherwise(0) for n in names])
    df = df.withColumns({"composite_z": weighed(FACTORS), "factor_mean": mean_known([F.col(n) for n in names]), "confidence_in": F.coalesce("dataConfidence", F.lit(65.0))})
    spread = F.sqrt(mean_known([(F.col(n) - F.col("factor_mean")) * (F.col(n) - F.col("factor_mean")) for n in names]))
    df = df.withColumns({"factor_spread": spread, "alpha": clamp(scorer_cdf("composite_z") * 100, 0, 100), "penalty": F.greatest(F.lit(0.0), 55 - F.col("confidence_in"))})
    score = lambda e: js_round(clamp(e, 0, 100))
    main = mean_known([F.col("momentum_z"), F.col("growth_z"), F.col("quality_z")])
    df = df.withColumns(
        {
            "agreement": clamp(50 + (count(lambda c: c > 0.2) - count(lambda c: c < -0.2)) * 8 - F.col("factor_spread") * 8, 0, 100),
            "thesis_damage": score(50 - main * 18 + F.greatest(F.lit(0.0), F.col("risk_z")) * 12),
        }
    )
    out = {
        "action": first_of(ACTIONS, "Hold"),
        "opportunity": js_round("alpha"),
        "risk_score": score(50 + F.col("risk_z") * 18 + F.col("penalty") * 0.12),
        "fragility_score": score(50 - F.col("fragility_z") * 18),
        "confidence": score(F.col("agreement") * 0.78 + F.col("confidence_in") * 0.22),
        "regime_fit": score(50 + weighed(("momentum", "quality", "growth", "lowVol")) * 18),
        "asymmetry": score(50 + (F.col("composite_z") - F.col("risk_z")) * 18),
        "stability": score(100 - F.col("factor_spread") * 25 - F.col("penalty") * 0.2),
        "forecast_20d": clamp(F.col("composite_z") * 2.5, -12, 12),
        "outperform_pct": score(scorer_cdf(F.col("composite_z") - 0.1) * 100),
        "drawdown_pct": score(scorer_cdf(F.col("risk_z") - 0.4) * 100),
        "regime": market_regime(stats),
    }
    return df.withColumns(out).withColumn("action_rank", mapped("action", ACTION_RANKS)).drop("factor_mean", "confidence_in", "factor_spread", "penalty")


def sector_scores(scored: DataFrame) -> DataFrame:
    buys, sells = F.count_if(F.col("action").isin("Buy Now", "Accumulate")), F.count_if(F.col("action").isin("Sell", "Trim"))
    score = F.avg(F.col("regime_fit") + F.col("opportunity") - F.col("risk_score") * 0.4)
    label = F.when(buys > sells, "Accumulation").when(sells > buys, "Distribution").otherwise("Mixed")
    return scored.groupBy("sector").agg(js_round(clamp(score, 0, 100)).alias("score"), label.alias("label"), js_round(F.avg("breadth")).alias("participation"))


def transition_kind(before: str, after: str) -> Column:
    """The kind of a move between two actions, by their sides."""
    a, b = mapped(before, SIDES), mapped(after, SIDES)
    moves = {"bullish>bearish": "exit", "bullish>neutral": "soften", "neutral>bullish": "entry", "bearish>bullish": "entry", "neutral>bearish": "warn"}
    path = F.create_map(*[F.lit(x) for pair in moves.items() for x in pair])[F.concat(a, F.lit(">"), b)]
    return F.when(a == b, F.concat(F.lit("stay-"), a)).otherwise(F.coalesce(path, F.lit("other")))


# The percentile of the top fifth, and a year's equity premium over 20 of 252 days, in percent.
TOP_FIFTH = 80
PACE = 0.055 * 20 / 252 * 100


def conviction(rows: DataFrame) -> DataFrame:
    """How many independent layers agree on a name: one column ``layer_*`` each (null: not measured), passed, available, score, label.

    rows: alpha and skew_percentile (0 to 100), ml and monte_carlo (20-day percent), gated (regime), horizons (forecasts of
    several horizons; three at least count, and three quarters of them must be positive). Anything but alpha may be null;
    null forecasts within horizons count as not positive. Under three layers there is no score to speak of.
    """
    positive = F.size(F.filter("horizons", lambda h: h > 0))
    layers = {
        "rules": F.col("alpha") >= TOP_FIFTH,
        "ml": F.col("ml") > 0,
        "monte_carlo": F.col("monte_carlo") > PACE,
        "options": F.col("skew_percentile") < TOP_FIFTH,
        "regime": ~F.col("gated"),
        "horizons": F.when(F.size("horizons") >= 3, positive >= F.ceil(F.size("horizons") * 0.75)),
    }
    rows = rows.withColumns({f"layer_{n}": e for n, e in layers.items()})
    count = lambda e: sum((e(F.col(f"layer_{n}")).cast("int") for n in layers), F.lit(0))
    rows = rows.withColumns({"passed": count(lambda c: F.coalesce(c, F.lit(False))), "available": count(lambda c: c.isNotNull())})
    rows = rows.withColumn("score", F.when(F.col("available") >= 3, F.col("passed") / F.col("available")).otherwise(0.0))
    label = F.when(F.col("available") < 3, "Insufficient evidence").when(F.col("passed") >= 5, "High conviction")
    return rows.withColumn("label", label.when(F.col("score") >= 2 / 3, "Solid").when(F.col("score") >= 1 / 3, "Mixed").otherwise("Weak"))
