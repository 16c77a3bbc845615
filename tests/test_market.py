"""Market queries against their SQL, textbook constants and causality."""

import math

import pytest
from pyspark.sql import functions as F

from tests.oracle import difference
from tidewater import registry
from tidewater.functions import columns as fx
from tidewater.operators import joins, panel

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, SF), SF, registry.ORACLE_SQL[name]) == ""


def test_option_constants(spark):
    c = fx.bsm(42, 40, 0.5, 0.10, 0.20)
    r = spark.range(1).select(*[v.alias(k) for k, v in c.items()], fx.inverse_normal_cdf(F.lit(0.975)).alias("z")).first()
    assert r["call"] == pytest.approx(4.76, abs=0.01) and r["put"] == pytest.approx(0.81, abs=0.01)
    assert r["call"] - r["put"] == pytest.approx(42 - 40 * math.exp(-0.05), abs=1e-5)
    assert r["z"] == pytest.approx(1.959964, abs=1e-5)


def test_selection_statistics(spark):
    r = spark.range(1).select(fx.probabilistic_sharpe(0.2, 101, 0.0, 0.0).alias("psr")).first()
    assert r["psr"] == pytest.approx(0.976, abs=0.002)


def test_features_do_not_see_the_current_bar(spark):
    rows = [("a", d, 100.0 + d % 7, 110.0, 90.0, 5.0 + d) for d in range(330)]
    make = lambda x: panel.price_features(spark.createDataFrame(x, "ticker string, date int, close double, high double, low double, volume double").withColumn("date", F.date_add(F.lit("2000-01-01").cast("date"), F.col("date"))))
    one = make(rows).filter("n_before <= 300").collect()
    other = make([r if r[1] < 300 else (r[0], r[1], r[2] * 9, 999.0, 1.0, 1.0) for r in rows]).filter("n_before <= 300").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, other))


def test_asof_carries_a_whole_row(spark):
    left = spark.createDataFrame([("k", 5), ("k", 9), ("k", 1)], "k string, t int")
    right = spark.createDataFrame([("k", 1, 10.0), ("k", 5, None)], "k string, t int, v double")
    got = {r["t"]: r["asof"] and (r["asof"]["asof_time"], r["asof"]["v"]) for r in joins.asof_join(left, right, "k", "t", "t", ["v"]).collect()}
    assert got == {1: None, 5: (1, 10.0), 9: (5, None)}
