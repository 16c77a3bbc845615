"""Filters, tiers, imputation, jumps and numbers on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalars
from tidewater.operators import panel, portfolio, prices


def test_numbers_are_plain_ones(spark):
    told = ["1d", "2f", "NaN", "Infinity", "$1,640.20", "(12)", " -3.5e2 ", "", "0x10", ".5", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i int, t string")
    got = [r["n"] for r in df.select("i", scalars.parse_number("t").alias("n")).orderBy("i").collect()]
    assert got == [None, None, None, None, 1640.2, -12.0, -350.0, None, None, 0.5, None]


def test_imputation_never_looks_ahead(spark):
    rows = [("a", 1, 10.0), ("b", 1, 20.0), ("a", 2, None), ("b", 2, None), ("a", 3, 1000.0), ("b", 3, 2000.0), ("c", 3, None)]
    df = spark.createDataFrame(rows, "ticker string, date int, x double")
    got = {(r["ticker"], r["date"]): (r["x"], r["x_imputed"]) for r in panel.imputed(df, ["x"]).collect()}
    assert got[("a", 2)] == got[("b", 2)] == (20.0, True) and got[("c", 3)] == (2000.0, True) and got[("a", 1)] == (10.0, False)
    none = spark.createDataFrame([("a", 1, None)], "ticker string, date int, x double")
    assert panel.imputed(none, ["x"]).first()["x"] == 0.0


def test_filter_rules(spark):
    df = spark.createDataFrame([(1, 50.0, "Buy Now", True), (2, 49.9995, None, False), (3, None, "Hold", True)], "i int, n double, action string, owned boolean")
    held = lambda *rules: [r["i"] for r in df.filter(portfolio.predicate(rules)).orderBy("i").collect()]
    assert held() == [1, 2, 3] and held(("n", "=", "50", "number")) == [1, 2] and held(("n", "!=", "50", "number")) == [3]
    assert held(("n", ">=", "many", "number")) == [1, 2, 3] and held(("action", "=", "buy", "text")) == [1]
    assert held(("action", "!=", "hold", "text")) == [1, 2] and held(("owned", "!=", "true", "flag")) == [2]


def test_tiers(spark):
    df = spark.createDataFrame([(1e12,), (5e9,), (0.0,), (-1.0,), (None,)], "cap double")
    rows = df.select(portfolio.tiered(F.col("cap"), portfolio.TRADING_COST).alias("cost"), portfolio.tiered(F.col("cap"), portfolio.BORROW_FEE).alias("fee")).collect()
    assert [tuple(r) for r in rows] == [(3, 30), (12, 100), (60, 350), (60, 350), (60, 350)]


def test_drawdown_and_jumps(spark):
    r = spark.range(1).select(prices.drawdown(F.array(*[F.lit(float(x)) for x in (10, 12, 6, 9, 15, 12)])).alias("d")).first()
    assert r["d"] == pytest.approx(50.0)
    rows = [("a", i, 0.01 if i % 2 else -0.01) for i in range(60)] + [("a", 60, 0.5), ("b", 0, 9.0)]
    got = {r["ticker"]: r for r in prices.jump_stats(spark.createDataFrame(rows, "ticker string, date int, ret double")).collect()}
    assert got["a"]["jumps"] == 1 and got["a"]["mean_jump"] == pytest.approx(0.5) and got["a"]["intensity"] == pytest.approx(252 / 41)
    assert got["b"]["jumps"] == 0 and got["b"]["intensity"] == 0


def test_tax_loss_replacement_is_not_owned(spark):
    held = spark.createDataFrame([("o", "x", 1.0, 10.0), ("o", "y", 1.0, 1.0), ("p", "x", 2.0, 10.0)], "owner string, ticker string, shares double, average_cost double")
    names = spark.createDataFrame([("x", "s", "Hold", 90, 5.0), ("y", "s", "Buy Now", 80, 5.0), ("z", "s", "Hold", 10, 5.0), ("w", "s", "Sell", 99, 5.0)], "ticker string, sector string, action string, opportunity int, last_price double")
    got = {r["owner"]: (r["ticker"], r["loss_pct"], r["replacement"]) for r in portfolio.tax_loss(held, names).collect()}
    assert got == {"o": ("x", -50.0, "z"), "p": ("x", -50.0, "y")}
