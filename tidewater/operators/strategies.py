"""Option strategies: chains cut to the legs nearest a delta at the expiry nearest a term, and rules on them ranked by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms in days of income and of hedges, and the legs by kind and delta.
INCOME, HEDGE = 30, 60
LEGS = {"call_10": ("call", 0.1), "call_20": ("call", 0.2), "call_25": ("call", 0.25), "call_60": ("call", 0.6), "put_10": ("put", -0.1), "put_20": ("put", -0.2), "put_25": ("put", -0.25)}
SHARE = "struct<name:string,expiration:date,days:int,legs:array<struct<side:string,kind:string,strike:double,premium:double,delta:double,quantity:int>>,net_cost:double,max_profit:double,max_loss:double,breakeven_low:double,breakeven_high:double,probability:double,yield_or_cost:double,score:double>"


def mid_price(bid: str, ask: str, last: str) -> Column:
    """Between a positive bid and ask, else a positive last price, else null."""
    return F.when((F.col(bid) > 0) & (F.col(ask) > 0), (F.col(bid) + F.col(ask)) / 2).when(F.col(last) > 0, F.col(last))


def chains(options: DataFrame) -> DataFrame:
    """Per ticker the chains nearest INCOME and HEDGE days, as structs ``income`` and ``hedge`` of expiration, days and legs.

    options: ticker, expiration, days, kind, strike, bid, ask, last, delta. Of equal distances the earlier expiry and the
    lower strike count; options without a price or a delta are no legs. Options are reduced to legs by expiry before these
    are compared, so no ticker's chain is held in one row.
    """
    rows = options.withColumn("premium", mid_price("bid", "ask", "last"))
    usable = F.col("premium").isNotNull() & F.col("delta").isNotNull() & F.col("strike").isNotNull()

    def leg(kind: str, delta: float) -> Column:
        near = F.struct(F.abs(F.col("delta") - delta).alias("gap"), "strike", "premium", "delta")
        return F.min(F.when(usable & (F.col("kind") == kind), near))

    by_expiry = rows.groupBy("ticker", "expiration", "days").agg(*[leg(*of).alias(name) for name, of in LEGS.items()])
    one = F.struct("expiration", F.greatest(F.col("days"), F.lit(1)).alias("days"), *LEGS)
    near = lambda days: F.min_by(one, F.struct(F.abs(F.col("days") - days), "expiration"))
    return by_expiry.groupBy("ticker").agg(near(INCOME).alias("income"), near(HEDGE).alias("hedge"))


def strategies(signals: DataFrame, chained: DataFrame, holdings: DataFrame) -> DataFrame:
    """Each signal's strategies, ranked by score (ties in the order of the rules): the signal's ticker, rank, and what SHARE names.

    signals: ticker, spot, action, risk_score, implied_vol_rank, composite_z, implied and forecast volatility, sigma_20d
    (percent) and down_8pct of simulated prices; those of the last four may be null. holdings: ticker, shares, one row a
    ticker. A profit without bound is null. A ticker without a chain has only the rule on volatilities.
    """
    rows = signals.join(chained, "ticker", "left").join(holdings.select("ticker", "shares"), "ticker", "left")
    spot, action, risk, down = F.col("spot"), F.col("action"), F.col("risk_score"), F.coalesce("down_8pct", F.lit(0.0))
    shares = F.coalesce("shares", F.lit(0.0))
    ratio = F.when((F.col("implied") > 0) & (F.col("forecast") > 0), F.col("implied") / F.col("forecast"))
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)

    def leg(side: str, chain: str, name: str, quantity=None) -> Column:
        of = F.col(f"{chain}.{name}")
        return F.struct(F.lit(side).alias("side"), F.lit(LEGS[name][0]).alias("kind"), of["strike"].alias("strike"), of["premium"].alias("premium"), of["delta"].alias("delta"), (F.lit(None) if quantity is None else quantity).cast("int").alias("quantity"))

    def rule(name, chain, test, legs, net_cost, profit, loss, low, high, probability, yields, score) -> Column:
        none, day, days = F.lit(None).cast("double"), F.lit(None).cast("date"), F.lit(0)
        if chain:
            day, days = F.col(f"{chain}.expiration"), F.col(f"{chain}.days")
        values = [none if x is None else x for x in (net_cost, profit, loss, low, high, probability, yields)]
        all_legs = F.array(*legs) if legs else F.array()
        return F.when(test, F.struct(name, day, days, all_legs, *values, F.least(F.lit(100.0), score)).cast(SHARE))

    prem = lambda chain, name: F.col(f"{chain}.{name}.premium")
    strike = lambda chain, name: F.col(f"{chain}.{name}.strike")
    delta = lambda chain, name: F.col(f"{chain}.{name}.delta")

    p, k = prem("income", "call_25"), strike("income", "call_25")
    pct = p / spot * 100
    yearly = pct * 365 / F.col("income.days")
    covered = rule(F.lit("Covered Call"), "income", p.isNotNull() & (shares >= 100) & ~F.coalesce(action == "Buy Now", F.lit(False)), [leg("sell", "income", "call_25", F.floor(shares / 100))],
        -p * 100, (k - spot + p) * 100, -(spot - p) * 100, spot - p, spot - p, 1 - delta("income", "call_25") * 0.5, pct,
        yearly * 5 + points(action == "Hold", 20) + points(action == "Trim", 10) + points(F.col("implied_vol_rank") >= 50, 15))

    p, k = prem("hedge", "put_25"), strike("hedge", "put_25")
    pct = p / spot * 100
    protective = rule(F.lit("Protective Put"), "hedge", p.isNotNull() & (shares > 0) & ((risk >= 55) | (down >= 0.18)), [leg("buy", "hedge", "put_25", F.ceil(shares / 100))],
        p * 100, None, -(spot - k + p) * 100, spot + p, spot + p, None, -pct,
        (risk - 50) * 1.2 + down * 100 + points((action == "Hold") & (risk >= 60), 20) + F.greatest(F.lit(0.0), 30 - pct * 365 / F.col("hedge.days")))

    p, k = prem("hedge", "call_60"), strike("hedge", "call_60")
    pct = p / spot * 100
    long_call = rule(F.lit("Long Call"), "hedge", p.isNotNull() & action.isin("Buy Now", "Accumulate") & (ratio <= 1.15), [leg("buy", "hedge", "call_60", F.lit(1))],
        p * 100, None, -p * 100, k + p, k + p, None, -pct,
        F.col("composite_z") * 25 + (1.15 - ratio) * 50 + F.when(action == "Buy Now", 20).otherwise(5) + F.least(F.lit(20.0), delta("hedge", "call_60") / pct * 100 / 5))

    zero = F.lit(0.0)
    rich = ratio > 1.3
    premium = rule(F.when(rich, "Vol Arb: Sell Premium").otherwise("Vol Arb: Buy Premium"), None, rich | (ratio < 0.85), None, *[zero] * 5, None, zero, F.abs(ratio - 1) * 100)

    c = "income"
    credit = prem(c, "call_20") - prem(c, "call_10") + prem(c, "put_20") - prem(c, "put_10")
    widest = F.greatest(strike(c, "call_10") - strike(c, "call_20"), strike(c, "put_20") - strike(c, "put_10"))
    likely = F.greatest(zero, 1 - F.abs(delta(c, "call_20")) - F.abs(delta(c, "put_20")))
    ordered = (strike(c, "call_10") > strike(c, "call_20")) & (strike(c, "put_10") < strike(c, "put_20"))
    condor = rule(F.lit("Iron Condor"), c, (F.col("sigma_20d") <= 5) & (ratio >= 1.1) & ordered & (credit > 0) & (widest - credit > 0),
        [leg(side, c, name) for side, name in (("sell", "put_20"), ("buy", "put_10"), ("sell", "call_20"), ("buy", "call_10"))],
        -credit * 100, credit * 100, -(widest - credit) * 100, strike(c, "put_20") - credit, strike(c, "call_20") + credit, likely, credit / spot * 100,
        likely * 60 + (5 - F.col("sigma_20d")) * 4 + (ratio - 1) * 30)

    found = F.filter(F.array(covered, protective, long_call, premium, condor), lambda s: s.isNotNull())
    ordered = F.array_sort(F.transform(found, lambda s, i: F.struct((-s["score"]).alias("by"), i.alias("i"), s.alias("s"))))
    return rows.select("ticker", F.posexplode(ordered).alias("rank", "o")).select("ticker", (F.col("rank") + 1).alias("rank"), "o.s.*")
