"""Registered portfolio queries over scored parts and customers' purchases, each with its SQL.

A customer's purchases of a part are a holding; a part is a name of the universe, its brand the sector, its retail
price the last price. What the fixture lacks (predictions, evidence, simulated paths) is made of the part's key.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decisions
from ..operators import portfolio as pf
from ..sources.tables import table
from .decisions import scored, scored_sql
from .market import rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def holdings(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_custkey").alias("owner"), F.col("l_partkey").alias("ticker")).agg(F.sum("l_quantity").alias("shares"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("average_cost"))


def universe(spark, sf_dir):
    """Scored parts with price, sector and data confidence."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_brand").alias("sector"), F.col("p_retailprice").alias("last_price"), (F.col("p_partkey") % 90).cast("double").alias("dataConfidence"))
    rows = scored(spark, sf_dir, "base").select(F.col("p_partkey").alias("ticker"), "action", "opportunity", "risk_score", "fragility_score", "thesis_damage", "confidence", "regime_fit")
    joined = rows.join(parts, "ticker")
    # one row a key: the aggregate keeps the long score expressions from being copied into every later filter and rule
    return joined.groupBy("ticker").agg(*[F.first(c).alias(c) for c in joined.columns if c != "ticker"])


UNIVERSE = scored_sql("base") + """, u AS (SELECT s.*, s.p_partkey AS ticker, p_retailprice AS last_price, CAST(p.p_partkey % 90 AS DOUBLE) AS dataConfidence FROM scored s JOIN part p USING (p_partkey)),
h AS (SELECT o_custkey AS owner, l_partkey AS ticker, sum(l_quantity) AS shares, sum(l_extendedprice) / sum(l_quantity) AS average_cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
_PENALTY = "CASE action WHEN 'Sell' THEN 28 WHEN 'Trim' THEN 18 WHEN 'Avoid' THEN 12 ELSE 0 END"
_RANK = "CASE action WHEN 'Buy Now' THEN 1 WHEN 'Accumulate' THEN 2 WHEN 'Hold' THEN 3 WHEN 'Trim' THEN 4 WHEN 'Sell' THEN 5 ELSE 6 END"


@query(UNIVERSE + """, l AS (SELECT owner, h.ticker, sector, shares, shares * (last_price - average_cost) AS loss, (last_price - average_cost) / average_cost * 100 AS pct FROM h JOIN u USING (ticker) WHERE (last_price - average_cost) / average_cost * 100 <= -3),
r AS (SELECT owner, sector, arg_min(ticker, (-opportunity, ticker)) AS other, max(opportunity) AS score FROM (SELECT DISTINCT owner, sector FROM l) JOIN (SELECT ticker, sector, opportunity FROM u WHERE action IN ('Buy Now', 'Accumulate', 'Hold')) USING (sector)
  ANTI JOIN h USING (owner, ticker) GROUP BY owner, sector)
SELECT owner, ticker, shares, round(loss, 4) AS loss, round(pct, 4) AS loss_pct, other AS replacement, score AS replacement_score FROM l LEFT JOIN r USING (owner, sector)""")
def tax_loss_candidates(spark, sf_dir):
    return rounded(pf.tax_loss(holdings(spark, sf_dir), universe(spark, sf_dir)), 4)


#: A saved filter: numbers, a text part, a flag, and a rule whose number is none.
RULES = (("confidence", ">=", "45", "number"), ("risk_score", "<=", "70", "number"), ("action", "=", "o", "text"), ("sector", "!=", "brand#11", "text"), ("owned", "=", "true", "flag"), ("opportunity", ">=", "high", "number"))


@query(UNIVERSE + """ SELECT ticker, action, confidence, risk_score FROM u WHERE confidence >= 45 AND risk_score <= 70 AND contains(lower(action), 'o') AND lower(sector) <> 'brand#11' AND ticker IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def filtered_signals(spark, sf_dir):
    owned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("ticker"), F.lit(True).alias("owned")).distinct()
    rows = universe(spark, sf_dir).join(owned, "ticker", "left").withColumn("owned", F.coalesce("owned", F.lit(False)))
    return rows.filter(pf.predicate(RULES)).select("ticker", "action", "confidence", "risk_score")


_LISTS = {"action": f"{_RANK}, opportunity DESC", "opportunity": "opportunity DESC", "confidence": "confidence DESC", "risk": "risk_score DESC", "data": "dataConfidence DESC", "regime": "regime_fit DESC", "risk_priority": f"thesis_damage * 0.45 + risk_score * 0.3 + fragility_score * 0.18 + {_PENALTY} DESC"}


@query(UNIVERSE + " " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS list, row_number() OVER (ORDER BY {o}, ticker) AS place, ticker FROM u) WHERE place <= 20" for n, o in _LISTS.items()))
def ranked_signals(spark, sf_dir):
    """The first twenty names in each order of the signal table."""
    return pf.top_lists(universe(spark, sf_dir), "ticker", 20)


@query(UNIVERSE + """, o AS (SELECT ticker, count(*) AS owners, sum(shares) AS shares FROM h GROUP BY ticker)
SELECT ticker, action, coalesce(owners, 0) AS owners, round(coalesce(shares * last_price, 0), 2) AS value,
  CASE WHEN owners IS NULL THEN 'unowned' ELSE 'owned' END AS side FROM u LEFT JOIN o USING (ticker)""")
def owned_overlay(spark, sf_dir):
    """The universe with what is held of each name; names that nobody holds stay."""
    held = holdings(spark, sf_dir).groupBy("ticker").agg(F.count(F.lit(1)).alias("owners"), F.sum("shares").alias("shares"))
    rows = universe(spark, sf_dir).join(held, "ticker", "left")
    value = F.round(F.coalesce(F.col("shares") * F.col("last_price"), F.lit(0.0)), 2)
    return rows.select("ticker", "action", F.coalesce("owners", F.lit(0)).alias("owners"), value.alias("value"), F.when(F.col("owners").isNull(), "unowned").otherwise("owned").alias("side"))


@query(UNIVERSE + """, held AS (SELECT DISTINCT ticker FROM h), fit AS (SELECT ticker FROM u WHERE action IN ('Buy Now', 'Accumulate', 'Hold'))
SELECT 'owned and ownable' AS part, ticker FROM (SELECT * FROM held INTERSECT SELECT * FROM fit) UNION ALL SELECT 'owned only', ticker FROM (SELECT * FROM held EXCEPT SELECT * FROM fit)
UNION ALL SELECT 'unowned', ticker FROM (SELECT * FROM fit EXCEPT SELECT * FROM held) UNION ALL SELECT 'either', ticker FROM (SELECT * FROM held UNION SELECT * FROM fit)""")
def holding_sets(spark, sf_dir):
    """Semi and anti joins of held and ownable names, and their union."""
    a = holdings(spark, sf_dir).select("ticker").distinct()
    b = universe(spark, sf_dir).filter(F.col("action").isin(*pf.OWNABLE)).select("ticker")
    parts = {"owned and ownable": a.join(b, "ticker", "left_semi"), "owned only": a.join(b, "ticker", "left_anti"), "unowned": b.join(a, "ticker", "left_anti"), "either": a.union(b).distinct()}
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("part"), "ticker")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH n AS (SELECT 0 AS list, p_brand AS name, min(p_partkey) AS ord FROM part GROUP BY p_brand UNION ALL SELECT 1, n_name, min(n_nationkey) FROM nation GROUP BY n_name
  UNION ALL SELECT 2, p_brand, min(-p_partkey) FROM part GROUP BY p_brand UNION ALL SELECT 3, c_mktsegment, min(c_custkey) FROM customer GROUP BY c_mktsegment)
SELECT name, arg_min(list, (list, ord)) AS list, arg_min(ord, (list, ord)) AS ord FROM n GROUP BY name""")
def symbol_union(spark, sf_dir):
    """Distinct names of four lists in the order of first mention."""
    lists = [("part", "p_brand", F.col("p_partkey")), ("nation", "n_name", F.col("n_nationkey")), ("part", "p_brand", -F.col("p_partkey")), ("customer", "c_mktsegment", F.col("c_custkey"))]
    return pf.ordered_union(*[table(spark, sf_dir, t).select(F.col(name).alias("name"), key.cast("long").alias("ord")) for t, name, key in lists])


def _predicted(spark, sf_dir):
    key = F.col("ticker")
    rows = universe(spark, sf_dir).withColumn("predicted", F.when(key % 5 != 0, (key * 37 % 1009).cast("double") / 10))
    return rows.withColumns({"dataConfidence": F.col("dataConfidence") + 20, "real_fundamentals": key % 7 != 0, "bullish_evidence": key % 3 != 0, "bearish_evidence": key % 4 != 0})


_PREDICTED = UNIVERSE + """, m AS (SELECT ticker, sector, action, risk_score, opportunity, dataConfidence + 20 AS sure, CASE WHEN ticker % 5 <> 0 THEN (ticker * 37 % 1009)::DOUBLE / 10 END AS predicted,
  ticker % 7 <> 0 AS real, ticker % 3 <> 0 AS bull, ticker % 4 <> 0 AS bear FROM u),
q AS (SELECT *, CASE WHEN predicted IS NOT NULL AND count(predicted) OVER (PARTITION BY sector) >= 25 THEN
  (rank() OVER (PARTITION BY sector, predicted IS NULL ORDER BY predicted) - 1 + (count(*) OVER (PARTITION BY sector, predicted) - 1) / 2.0) / (count(*) OVER (PARTITION BY sector, predicted IS NULL) - 1) * 100 END AS pct FROM m)"""
_BACK = "CASE WHEN action IN ('Buy Now', 'Accumulate') THEN 'Hold|{}' ELSE action || '|rules' END"
_OK = "risk_score < 80 AND real AND sure >= 80 AND bull"
_OPEN = f"""CASE WHEN pct IS NULL THEN {_BACK.format('demoted-no-ml')} WHEN pct >= 80 THEN CASE WHEN {_OK} THEN 'Buy Now|ml' ELSE 'Hold|ml-veto' END
  WHEN pct >= 67 THEN CASE WHEN {_OK} THEN 'Accumulate|ml' ELSE 'Hold|ml-veto' END WHEN pct <= 10 THEN CASE WHEN bear THEN 'Avoid|ml' ELSE 'Hold|ml-veto-bearish' END
  WHEN pct <= 25 THEN CASE WHEN bear THEN 'Trim|ml' ELSE 'Hold|ml-veto-bearish' END ELSE 'Hold|ml' END"""
_SHUT = f"CASE WHEN pct >= 67 THEN 'Hold|demoted-evidence' WHEN pct <= 25 THEN 'Hold|demoted-evidence-bearish' ELSE {_BACK.format('demoted-no-ml')} END"
_EXITS = "CASE WHEN action IN ('Trim', 'Sell', 'Avoid') THEN action || '|rules-exit' ELSE {} END"


@query(_PREDICTED + f""", v AS (SELECT 'open' AS gate, ticker, pct, {_EXITS.format(_OPEN)} AS v FROM q UNION ALL SELECT 'regime', ticker, pct, {_EXITS.format(_BACK.format('demoted-gated'))} FROM q
  UNION ALL SELECT 'evidence', ticker, pct, {_EXITS.format(_SHUT)} FROM q)
SELECT gate, ticker, round(pct, 6) AS pct, split_part(v, '|', 1) AS verdict, split_part(v, '|', 2) AS verdict_source FROM v""")
def ml_verdicts(spark, sf_dir):
    rows, out = _predicted(spark, sf_dir), None
    for gate, options in (("open", {}), ("regime", {"regime_gated": True}), ("evidence", {"evidence_gated": True})):
        part = pf.ml_verdicts(rows, "sector", **options).select(F.lit(gate).alias("gate"), "ticker", "pct", "verdict", "verdict_source")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


_B, _D = pf.BUY_RETURN, pf.DRAWDOWN_GATE


@query(UNIVERSE + f""", g AS (SELECT *, (ticker % 101 - 50)::DOUBLE / 20 AS mean, (ticker % 17)::DOUBLE / 200 AS kelly, (ticker % 23)::DOUBLE / 40 AS down FROM u),
g1 AS (SELECT * REPLACE (CASE WHEN action = 'Buy Now' AND (mean < {_B} OR kelly < 0.03 OR down > {_D}) THEN 'Accumulate' ELSE action END AS action) FROM g),
g2 AS (SELECT * REPLACE (CASE WHEN action = 'Accumulate' AND (mean < 0 OR down > {_D + 0.05}) THEN 'Hold' ELSE action END AS action) FROM g1),
g3 AS (SELECT * REPLACE (CASE WHEN action = 'Hold' AND mean < {-_B} AND down > {_D + 0.10} THEN 'Trim' ELSE action END AS action) FROM g2),
g4 AS (SELECT * REPLACE (CASE WHEN action = 'Trim' AND mean < {-3 * _B} AND down > {_D + 0.20} THEN 'Sell' ELSE action END AS action) FROM g3)
SELECT ticker, action, CASE action WHEN 'Buy Now' THEN CASE WHEN opportunity >= 84 AND risk_score <= 55 AND dataConfidence < 65 THEN 'Starter position' ELSE 'Small starter' END WHEN 'Accumulate' THEN 'Scale on pullbacks'
  WHEN 'Hold' THEN 'No fresh add' WHEN 'Trim' THEN 'Reduce exposure' WHEN 'Sell' THEN 'Exit candidate' ELSE 'Avoid for now' END AS plan,
  CASE WHEN action IN ('Sell', 'Trim') THEN 'Review before the next close.' WHEN ticker % 100 >= 65 THEN 'Review before the next scheduled event.' WHEN risk_score >= 64 THEN 'Review after the next market refresh.' ELSE 'Review on the next daily refresh.' END AS next_check,
  CASE WHEN cap >= 50e9 THEN 3 WHEN cap >= 10e9 THEN 6 WHEN cap >= 2e9 THEN 12 WHEN cap >= 300e6 THEN 30 ELSE 60 END AS cost_bps, CASE WHEN cap >= 10e9 THEN 30 WHEN cap >= 2e9 THEN 100 ELSE 350 END AS borrow_bps
FROM (SELECT *, CASE WHEN ticker % 10 <> 0 THEN last_price * 10000 * (ticker % 9000) END AS cap FROM g4)""")
def refined_actions(spark, sf_dir):
    rows = universe(spark, sf_dir)
    key = F.col("ticker")
    rows = rows.withColumn("action", pf.refined_action((key % 101 - 50).cast("double") / 20, (key % 17).cast("double") / 200, (key % 23).cast("double") / 40))
    cap = F.when(key % 10 != 0, F.col("last_price") * 10000 * (key % 9000))
    return rows.select("ticker", "action", pf.position_plan(F.col("action"), F.col("dataConfidence")).alias("plan"), pf.next_check(F.col("action"), key % 100).alias("next_check"), pf.tiered(cap, pf.TRADING_COST).alias("cost_bps"), pf.tiered(cap, pf.BORROW_FEE).alias("borrow_bps"))


@query(UNIVERSE + """, m AS (SELECT ticker, opportunity, CAST(opportunity AS DOUBLE) AS alpha, CASE WHEN ticker % 5 > 0 THEN (ticker % 13) - 5.5 END AS ml, CASE WHEN ticker % 4 > 0 THEN (ticker % 9) / 10.0 END AS mc,
  risk_score AS skew, CASE WHEN ticker % 3 > 0 THEN ticker % 7 = 0 END AS gated, ticker % 6 AS k FROM u),
sk AS (SELECT *, CASE WHEN count(*) OVER () > 1 THEN (rank() OVER (ORDER BY skew) - 1 + (count(*) OVER (PARTITION BY skew) - 1) / 2.0) / (count(*) OVER () - 1) * 100 ELSE 50 END AS pct FROM m),
l AS (SELECT *, [alpha >= 80, ml > 0, mc > 0.055 * 20 / 252 * 100, pct < 80, NOT gated, CASE WHEN k >= 3 THEN len(list_filter(range(1, k + 1), lambda i: (ticker * i) % 11 > 3)) >= ceil(k * 0.75) END] AS layers FROM sk),
cv AS (SELECT *, len(list_filter(layers, lambda x: x)) AS passed, len(list_filter(layers, lambda x: x IS NOT NULL)) AS available FROM l),
s AS (SELECT *, CASE WHEN available >= 3 THEN passed / available ELSE 0 END AS score FROM cv)
SELECT ticker, CAST(passed AS INT) AS passed, CAST(available AS INT) AS available, round(score, 6) AS score, CASE WHEN available < 3 THEN 'Insufficient evidence' WHEN passed >= 5 THEN 'High conviction' WHEN score >= 2 / 3 THEN 'Solid' WHEN score >= 1 / 3 THEN 'Mixed' ELSE 'Weak' END AS label FROM s""")
def conviction_stacks(spark, sf_dir):
    """Layers made of keys; the skew percentile comes from counts of whole scores, so no window holds the universe."""
    t, rows = F.col("ticker"), universe(spark, sf_dir)
    counts = rows.groupBy("risk_score").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("risk_score").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    place = F.when(F.col("all") > 1, (F.col("upto") - F.col("n") + (F.col("n") - 1) / 2) / (F.col("all") - 1) * 100).otherwise(50.0)
    rows = rows.join(counts.select("risk_score", place.alias("skew_percentile")), "risk_score")
    horizons = F.filter(F.sequence(F.lit(1), F.lit(5)), lambda i: i <= t % 6)
    rows = rows.select("ticker", F.col("opportunity").cast("double").alias("alpha"), "skew_percentile", F.when(t % 5 > 0, t % 13 - 5.5).alias("ml"), F.when(t % 4 > 0, (t % 9) / 10).alias("monte_carlo"), F.when(t % 3 > 0, t % 7 == 0).alias("gated"), F.transform(horizons, lambda i: (t * i % 11 - 3).cast("double")).alias("horizons"))
    return rounded(decisions.conviction(rows).select("ticker", "passed", "available", "score", "label"))
