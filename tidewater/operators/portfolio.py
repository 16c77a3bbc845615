"""Holdings against a scored universe: filters, overlays, ranked lists, tax-loss candidates and verdicts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import midrank
from .decisions import ACTION_RANKS

OWNABLE = ("Buy Now", "Accumulate", "Hold")
BULLISH, BEARISH = ("Buy Now", "Accumulate"), ("Trim", "Sell", "Avoid")
#: Points of an action in the order of risk.
PENALTIES = {"Sell": 28, "Trim": 18, "Avoid": 12}
#: Names of a batch that ranks need, the least data confidence and the highest risk of a bullish call.
MIN_BREADTH, SURE, RISK_VETO = 25, 80, 80
#: One-way trading cost (basis points) and yearly borrow fee from each market value on.
TRADING_COST = ((50e9, 3), (10e9, 6), (2e9, 12), (300e6, 30), (0.0, 60))
BORROW_FEE = ((10e9, 30), (2e9, 100), (0.0, 350))
#: Least mean return (percent over 20 days), least half Kelly share, and share of paths down 8 %.
BUY_RETURN, KELLY_GATE, DRAWDOWN_GATE = 0.055 * 20 / 252 * 100 * 1.5, 0.03, 0.25


def tiered(value: Column, tiers) -> Column:
    """The price of the first tier that a market value reaches; the last one for others and missing ones."""
    out = F.lit(tiers[-1][1])
    for least, price in reversed(tiers):
        out = F.when(value >= least, price).otherwise(out)
    return out


def rule(field: str, op: str, value: str, kind: str) -> Column:
    """One filter rule. kind: number, flag or text. A number rule without a number holds; texts match as a part, case aside."""
    if kind == "flag":
        same = F.col(field) == (value == "true")
        return ~same if op == "!=" else same
    if kind == "number":
        try:
            wanted = float(value)
        except ValueError:
            return F.lit(True)
        actual = F.coalesce(F.col(field).cast("double"), F.lit(0.0))
        near = F.abs(actual - wanted) < 0.001
        return {">=": actual >= wanted, "<=": actual <= wanted, "=": near}.get(op, ~near)
    actual = F.lower(F.coalesce(F.col(field).cast("string"), F.lit("")))
    return actual != value.lower() if op == "!=" else actual.contains(value.lower())


def predicate(rules) -> Column:
    """All rules together; true without any."""
    return functools.reduce(lambda a, b: a & b, [rule(*r) for r in rules], F.lit(True))


def risk_priority() -> Column:
    action = F.lit(0)
    for name, points in PENALTIES.items():
        action = F.when(F.col("action") == name, points).otherwise(action)
    return F.col("thesis_damage") * 0.45 + F.col("risk_score") * 0.3 + F.col("fragility_score") * 0.18 + action


def action_rank() -> Column:
    out = F.lit(len(ACTION_RANKS) + 1)
    for name, rank in ACTION_RANKS.items():
        out = F.when(F.col("action") == name, rank).otherwise(out)
    return out


def sort_orders() -> dict[str, list[Column]]:
    down = lambda c: [F.col(c).desc()]
    return {
        "action": [action_rank().asc(), F.col("opportunity").desc()], "opportunity": down("opportunity"), "confidence": down("confidence"), "risk": down("risk_score"),
        "data": [F.coalesce("dataConfidence", F.lit(0.0)).desc()], "regime": down("regime_fit"), "risk_priority": [risk_priority().desc()],
    }


def top_lists(rows: DataFrame, key: str, k: int) -> DataFrame:
    """list, place, key: the first k rows in each order; ties by key. Each list is a distributed top-k."""
    parts = []
    for name, order in sort_orders().items():
        first = rows.orderBy(*order, key).limit(k)
        place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order, key))  # of k rows
        parts.append(first.select(F.lit(name).alias("list"), place.alias("place"), key))
    return functools.reduce(DataFrame.unionByName, parts)


def tax_loss(holdings: DataFrame, universe: DataFrame, threshold: float = -3.0) -> DataFrame:
    """Holdings that lost ``threshold`` percent or more, with the best name of the same sector that the owner does not hold.

    holdings: owner, ticker, shares, average_cost. universe: ticker, sector, action, opportunity, last_price. An owner of
    n names of a sector finds the best other one among its first n + 1, so only so many are joined.
    """
    priced = holdings.filter((F.col("shares") != 0) & (F.col("average_cost") > 0)).join(universe.filter(F.col("last_price") != 0), "ticker")
    loss = F.col("shares") * (F.col("last_price") - F.col("average_cost"))
    lost = priced.withColumn("loss", loss).withColumn("loss_pct", loss / (F.col("shares") * F.col("average_cost")) * 100).filter(F.col("loss_pct") <= threshold)
    lost = lost.select("owner", "ticker", "sector", "shares", "loss", "loss_pct")
    best = universe.filter(F.col("action").isin(*OWNABLE)).withColumn("place", F.row_number().over(Window.partitionBy("sector").orderBy(F.col("opportunity").desc(), "ticker")))
    best = best.select("sector", "place", F.col("ticker").alias("other"), F.col("opportunity").alias("other_score"))
    held = holdings.select("owner", F.col("ticker").alias("other")).distinct()
    owned = held.join(universe.select(F.col("ticker").alias("other"), "sector"), "other").groupBy("owner", "sector").agg(F.count(F.lit(1)).alias("n"))
    asked = lost.select("owner", "sector").distinct().join(owned, ["owner", "sector"]).select("owner", "sector", F.explode(F.sequence(F.lit(1), F.col("n").cast("int") + 1)).alias("place"))
    found = asked.join(best, ["sector", "place"]).join(held, ["owner", "other"], "left_anti").groupBy("owner", "sector").agg(F.min_by(F.struct("other", "other_score"), "place").alias("r"))
    return lost.join(found, ["owner", "sector"], "left").select("owner", "ticker", "shares", "loss", "loss_pct", F.col("r.other").alias("replacement"), F.col("r.other_score").alias("replacement_score"))


def ml_verdicts(rows: DataFrame, batch: str, regime_gated: bool = False, evidence_gated: bool = False) -> DataFrame:
    """verdict and verdict_source from rules' actions and a model's ranks within a batch of names.

    rows: action, predicted (null: not ranked), risk_score, dataConfidence, real_fundamentals, and bullish_evidence
    and bearish_evidence (whether the model's direction has earned trust). Bearish rules stand; a closed gate or a
    missing rank takes bullish actions back; else the rank decides, and vetoes hold.
    """
    of = Window.partitionBy(batch, F.col("predicted").isNull())
    n = F.count("predicted").over(Window.partitionBy(batch))
    pct = F.when(F.col("predicted").isNotNull() & (n >= MIN_BREADTH), midrank("predicted", of))
    rows = rows.withColumn("pct", pct)
    bullish, p = F.col("action").isin(*BULLISH), F.col("pct")
    say = lambda action, source: F.struct(F.lit(action).alias("verdict") if isinstance(action, str) else action.alias("verdict"), F.lit(source).alias("verdict_source"))
    same = F.col("action")
    back = lambda source: F.when(bullish, say("Hold", source)).otherwise(say(same, "rules"))
    if evidence_gated:
        ranked = F.when(p >= 67, say("Hold", "demoted-evidence")).when(p <= 25, say("Hold", "demoted-evidence-bearish")).otherwise(back("demoted-no-ml"))
    elif regime_gated:
        ranked = back("demoted-gated")
    else:
        sure = (F.col("risk_score") < RISK_VETO) & F.col("real_fundamentals") & (F.coalesce("dataConfidence", F.lit(0.0)) >= SURE) & F.col("bullish_evidence")
        earned = lambda test, action, veto: F.when(test, say(action, "ml")).otherwise(say("Hold", veto))
        ranked = (
            F.when(p.isNull(), back("demoted-no-ml"))
            .when(p >= 80, earned(sure, "Buy Now", "ml-veto")).when(p >= 67, earned(sure, "Accumulate", "ml-veto"))
            .when(p <= 10, earned(F.col("bearish_evidence"), "Avoid", "ml-veto-bearish")).when(p <= 25, earned(F.col("bearish_evidence"), "Trim", "ml-veto-bearish"))
            .otherwise(say("Hold", "ml"))
        )
    return rows.withColumn("v", F.when(same.isin(*BEARISH), say(same, "rules-exit")).otherwise(ranked)).select("*", "v.*").drop("v")


def refined_action(mean: Column, half_kelly: Column, down: Column) -> Column:
    """The action after what simulated paths say; each step starts from the one before."""
    a = F.col("action")
    a = F.when((a == "Buy Now") & ((mean < BUY_RETURN) | (half_kelly < KELLY_GATE) | (down > DRAWDOWN_GATE)), "Accumulate").otherwise(a)
    a = F.when((a == "Accumulate") & ((mean < 0) | (down > DRAWDOWN_GATE + 0.05)), "Hold").otherwise(a)
    a = F.when((a == "Hold") & (mean < -BUY_RETURN) & (down > DRAWDOWN_GATE + 0.10), "Trim").otherwise(a)
    return F.when((a == "Trim") & (mean < -3 * BUY_RETURN) & (down > DRAWDOWN_GATE + 0.20), "Sell").otherwise(a)


def position_plan(action: Column, crowding: Column) -> Column:
    starter = F.when((F.col("opportunity") >= 84) & (F.col("risk_score") <= 55) & (crowding < 65), "Starter position").otherwise("Small starter")
    named = {"Accumulate": "Scale on pullbacks", "Hold": "No fresh add", "Trim": "Reduce exposure", "Sell": "Exit candidate"}
    out = F.lit("Avoid for now")
    for name, plan in named.items():
        out = F.when(action == name, plan).otherwise(out)
    return F.when(action == "Buy Now", starter).otherwise(out)


def next_check(action: Column, event_risk: Column) -> Column:
    close = F.when(action.isin("Sell", "Trim"), "Review before the next close.").when(event_risk >= 65, "Review before the next scheduled event.")
    return close.when(F.col("risk_score") >= 64, "Review after the next market refresh.").otherwise("Review on the next daily refresh.")


def ordered_union(*lists: DataFrame) -> DataFrame:
    """name, place: the distinct names of several lists (name, ord), in the order of their first mention."""
    tagged = [d.select("name", F.lit(i).alias("list"), "ord") for i, d in enumerate(lists)]
    first = functools.reduce(DataFrame.unionByName, tagged).groupBy("name").agg(F.min(F.struct("list", "ord")).alias("first"))
    return first.select("name", F.col("first.list").alias("list"), F.col("first.ord").alias("ord"))
