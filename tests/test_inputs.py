"""Raw inputs, implied volatility and bootstraps: edge cases and plain versions."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions.columns import bsm
from tidewater.operators import calibration, events, options
from tidewater.sources import tables
from tidewater.sources.facts import facts_from_json


def chart(closes, adjusted=None, times=None, **other):
    times = times or [1704153600 + 86400 * i for i in range(len(closes))]
    quote = {"open": [c and c * 0.98 for c in closes], "high": [c and c * 1.02 for c in closes], "low": [c and c * 0.97 for c in closes], "close": closes, "volume": [1000.0] * len(closes)} | other
    return json.dumps({"chart": {"result": [{"timestamp": times, "indicators": {"quote": [quote]} | ({"adjclose": [{"adjclose": adjusted}]} if adjusted else {})}], "error": None}})


def test_charts(spark):
    told = {"split": chart([100.0, 50.0], [50.0, 50.0]), "gap": chart([50.0, 50.0, 50.0], [50.0, None, 50.0]), "raw": chart([50.0, 51.0]), "twice": chart([1.0, 2.0], [1.0, 2.0], [5, 5]), "when": chart([1.0, 2.0], [1.0, 2.0], [5, None]),
        "volume": chart([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], volume=[None, -1.0, 0.0]), "short": chart([1.0, 2.0], [1.0]), "none": "{}", "bad": "not json"}
    raw = spark.createDataFrame([*told.items(), ("null", None)], "ticker string, json string")
    bars = {}
    for r in tables.parse_chart(raw).orderBy("ticker", "date").collect():
        bars.setdefault(r["ticker"], []).append(r)
    first = bars["split"][0]
    assert (first["close"], first["raw_close"], first["raw_open"], first["adj_factor"], str(first["date"])) == (50.0, 100.0, 98.0, 0.5, "2024-01-02") and first["open"] == pytest.approx(49)
    assert {k: len(v) for k, v in bars.items()} == {"split": 2, "gap": 2, "volume": 1, "short": 1}
    told = {r["ticker"]: r for r in tables.chart_adjustment(raw).collect()}
    assert (told["gap"]["eligible"], told["gap"]["adjusted"], told["gap"]["missing"]) == (3, 2, 1) and told["gap"]["coverage_pct"] == pytest.approx(200 / 3)
    assert told["raw"]["coverage_pct"] == 0 and told["twice"]["invalid"] == told["when"]["invalid"] == 2 and told["volume"]["invalid"] == 2
    assert set(told) == {"split", "gap", "raw", "twice", "when", "volume", "short"}


def test_csv_bodies(spark):
    row = lambda k, close="5": f"2024-01-{k:02d},1,2,0.5,{close},10"
    good = "\r\n".join(["Date,Open,High,Low,Close,Volume", *[row(k) for k in (7, 6, 5, 4, 3)], row(8, "0"), row(9, "x"), "2024-01-10,1,2,3", "", "2024-13-01,1,1,1,1,1"])
    bodies = {"good": good, "few": "\n".join(good.split("\r\n")[:5]), "head": good.replace("Date", "No"), "empty": "", "null": None}
    got = tables.parse_csv_text(spark.createDataFrame(list(bodies.items()), "ticker string, body string")).collect()
    assert sorted((r["ticker"], r["date"].day) for r in got) == [("good", d) for d in (3, 4, 5, 6, 7)]
    assert {r["date"].day for r in tables.parse_csv_text(spark.createDataFrame([("good", good)], "ticker string, body string"), newest=2).collect()} == {6, 7}


def test_first_name_with_data_wins(spark):
    fact = lambda val, end="2024-12-31", filed="2025-02-01", form="10-K", **x: {"val": val, "end": end, "filed": filed, "form": form} | x
    usd = lambda *rows: {"units": {"USD": list(rows)}}
    names = {
        "RevenueFromContractWithCustomerExcludingAssessedTax": usd(fact(1, form="8-K"), fact(None), fact(2, end="soon")),
        "Revenues": usd(fact(100, start="2024-01-01"), fact(101, start="2024-01-01"), fact(120, start="2024-01-01", filed="2025-09-01", form="10-K/A"), fact(7, start="2024-10-01"), fact(9, start="2024-07-15")),
        "SalesRevenueNet": usd(fact(999)),
        "NetIncomeLoss": {"units": {"EUR": [fact(5)]}}, "ProfitLoss": usd(fact(24)), "Assets": usd(fact(300)), "Unread": usd(fact(1)),
        "CommonStockSharesOutstanding": {"units": {"shares": [fact(50)]}},
    }
    raw = spark.createDataFrame([("a", json.dumps({"facts": {"us-gaap": names, "dei": {}}})), ("b", "{}"), ("c", "no"), ("d", None)], "symbol string, json string")
    got = sorted((r["concept"], r["value"], str(r["filed"]), r["span"]) for r in facts_from_json(raw).collect())
    assert got == [("assets", 300.0, "2025-02-01", "instant"), ("netIncome", 24.0, "2025-02-01", "instant"), ("revenue", 7.0, "2025-02-01", "quarter"), ("revenue", 9.0, "2025-02-01", "other"),
        ("revenue", 100.0, "2025-02-01", "annual"), ("revenue", 120.0, "2025-09-01", "annual"), ("shares", 50.0, "2025-02-01", "instant")]
    newest = {(r["concept"], r["since"]): r["value"] for r in facts_from_json(raw, newest_only=True).collect()}
    assert newest[("revenue", dt.date(2024, 1, 1))] == 120.0 and len(newest) == 6


def test_implied_volatility(spark):
    rows = spark.createDataFrame([(k, s, v) for k in ("call", "put") for s in (30.0, 42.0, 60.0) for v in (0.05, 0.2, 0.9, 3.0)], "kind string, spot double, vol double")
    at = lambda v: F.when(F.col("kind") == "call", bsm("spot", 40.0, 0.5, 0.1, v)["call"]).otherwise(bsm("spot", 40.0, 0.5, 0.1, v)["put"])
    found = rows.withColumn("price", at("vol")).withColumn("iv", options.implied_volatility("price", "kind", "spot", 40.0, 0.5, 0.1))
    again = found.withColumn("again", at("iv")).collect()
    assert all(r["again"] == pytest.approx(r["price"], abs=1e-6) for r in again if r["price"] > 1e-3)
    edge = spark.createDataFrame([(0.0, "call"), (-1.0, "put"), (None, "call"), (41.9999, "call"), (1e-9, "call")], "price double, kind string")
    assert [r[0] if r[0] is None else round(r[0], 2) for r in edge.select(options.implied_volatility("price", "kind", 42.0, 40.0, 0.5, 0.1)).collect()] == [None, None, None, 5.0, 0.0]


def test_cluster_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [("a", d, float(rng.normal() + level)) for d in range(40) for level in [rng.normal()] for _ in range(rng.integers(1, 9))] + [("few", d, 1.0) for d in range(7)] + [("a", 99, None)]
    frame = spark.createDataFrame(rows, "kind string, day int, v double")
    one, two = ({r["kind"]: r for r in calibration.cluster_bootstrap(frame.repartition(n), ["kind"], "day", "v").collect()} for n in (1, 3))
    groups = [np.array([v for k, d, v in rows if k == "a" and d == day and v is not None]) for day in range(40)]
    means = [np.concatenate([groups[i] for i in rng.integers(0, 40, 40)]).mean() for _ in range(4000)]
    low, high = np.quantile(means, [0.025, 0.975])
    assert one["a"]["lower"] == pytest.approx(two["a"]["lower"], abs=1e-9) and one["a"]["clusters"] == 40
    assert one["a"]["lower"] == pytest.approx(low, abs=0.06) and one["a"]["upper"] == pytest.approx(high, abs=0.06) and one["a"]["mean"] == pytest.approx(np.concatenate(groups).mean())
    assert one["few"]["lower"] is None and (one["few"]["n"], one["few"]["mean"], one["few"]["median"]) == (7, 1.0, 1.0)


def test_block_bootstrap(spark):
    rng = np.random.default_rng(2)
    series = {"noise": rng.normal(size=300), "drift": rng.normal(size=300) + 0.4, "short": np.ones(5), "two": np.ones(2)}
    frame = spark.createDataFrame([(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)], "s string, i int, v double")
    got = {r["s"]: r for r in calibration.block_bootstrap(frame, "i", "v", ["s"], block=10).collect()}
    starts = rng.integers(0, 291, (4000, 30))
    means = series["drift"][(starts[:, :, None] + np.arange(10)).reshape(4000, -1)].mean(1)
    assert got["drift"]["lower"] == pytest.approx(np.quantile(means, 0.025), abs=0.03) and got["drift"]["upper"] == pytest.approx(np.quantile(means, 0.975), abs=0.03)
    assert got["drift"]["p_value"] == pytest.approx(1 / 1001) and got["noise"]["p_value"] > 0.05 and got["two"]["p_value"] == 1.0
    assert got["short"]["lower"] == got["short"]["upper"] == 1.0
    assert tuple(calibration.bootstrap_mean(frame.limit(0), "i", "v").first()) == (0.0, 0.0, 0.0)


def test_late_labels(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    bars = spark.createDataFrame([("a", day(k), 100.0 + k) for k in range(0, 60)] + [("z", day(k), 0.0) for k in range(60)], "ticker string, date date, close double")
    log = spark.createDataFrame([("a", day(0), 1.0), ("a", day(20), 2.0), ("a", day(45), 3.0), ("a", day(-400), 4.0), ("b", day(0), 5.0), ("z", day(0), 6.0)], "ticker string, date date, predicted double")
    told = lambda log, k: {(r["ticker"], r["date"]): (r["realized"], r["status"]) for r in events.reconciled(log, bars, str(day(k))).collect()}
    early = told(log, 29)
    assert early[("a", day(0))] == (None, "pending") and ("a", day(-400)) not in early
    then = told(log, 45)
    assert then[("a", day(0))] == (20.0, "realized") and then[("a", day(20))] == (None, "pending") and then[("b", day(0))][1] == then[("z", day(0))][1] == "pending"
    # what is realized stays so, also when the same bars come again, and what never is goes in the end
    again = events.reconciled(events.reconciled(log, bars, str(day(45))).drop("status"), bars, str(day(380)))
    assert {(r["ticker"], r["date"], r["status"]) for r in again.collect()} == {("a", day(0), "realized"), ("a", day(20), "realized"), ("a", day(45), "pending")}
