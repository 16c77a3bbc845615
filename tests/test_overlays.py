"""Brokers' files, option strategies and groups of names: cases of real exports and edges."""

import datetime as dt
import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tests.oracle import difference
from tidewater import registry
from tidewater.operators import events, groups, panel, paths, strategies
from tidewater.sources import archive, brokers
from tidewater.streaming import labels, logs


def files(spark, **bodies):
    return spark.createDataFrame(list(bodies.items()), "file string, body string")


def told(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["place"])):
        out.setdefault(r["file"], []).append((r["ticker"], r["shares"], r["average_cost"]))
    return out


def test_broker_formats(spark):
    raw = files(
        spark,
        fidelity='"Brokerage"\n\nAccount Number,Symbol,Description,Quantity,Average Cost Basis\nX1,AAPL,"APPLE, ""INC""",10,"$1,150.25"\nX1,SPAXX**,CASH,1,1\nX1,AAPL,again,5,1\nX1,BRK.B,x,-3,(4)\nX1\n',
        schwab="Symbol,Quantity,Day Change $,Cost Basis\n$MSFT,4,0,400\nCash,1,0,1\nBAD SYMBOL!,1,0,1\nZERO,0,0,9\n**X,1,1,1",
        etrade="a\tb\nSymbol\tQuantity #\tPrice Paid $\nT\t2\t3.5\n",
        robinhood="Instrument,Shares,Average Cost,Total Cost\nA,2,0,10\nB,x,1,1\n",
        generic="Ticker,Qty\nF (Ford),1e2\nGM - General,\n",
        late="1,a\n2,b\n3,c\n4,d\n5,e\n6,f\nSymbol,Quantity\nZ,1\n",
        paste="\n aapl 10 $20 \r\nMSFT,5\nTSLA\naapl\n123\n",
        empty="  \n ", none=None, head="Symbol,Quantity\n", tail="Symbol,Quantity\nX,1\n" + '"' * 3,
    )
    assert told(brokers.broker_holdings(raw).collect()) == {
        "fidelity": [("AAPL", 10, 1150.25), ("BRK.B", 0, None)], "schwab": [("MSFT", 4, 100), ("ZERO", 0, None)], "etrade": [("T", 2, 3.5)], "robinhood": [("A", 2, 5)],
        "generic": [("F", 100, None)], "late": [("SYMBOL", 0, None), ("Z", 1, None)], "paste": [("AAPL", 10, 20), ("MSFT", 5, None), ("TSLA", 0, None)], "tail": [("X", 1, None)],
    }
    got = {r["file"]: tuple(r)[1:] for r in brokers.broker_report(raw).collect()}
    assert got["fidelity"] == ("fidelity", 5, 2, 2, 1, None) and got["schwab"] == ("schwab", 4, 2, 3, 0, None)
    assert [got[k][0] for k in ("etrade", "robinhood", "generic", "late")] == ["etrade", "robinhood", "generic-csv", "paste"]
    assert got["paste"] == ("paste", None, 3, 1, 1, None) and got["empty"] == got["none"] == ("paste", None, 0, 0, 0, "no rows")
    assert got["head"] == ("generic-csv", 2, 0, 0, 0, "header without usable rows") and len(got) == 11


def test_line_breaks_in_quotes(spark):
    raw = files(spark, a='Symbol,Description,Quantity\nA,"two\nlines",3\nB,x,4\n')
    assert told(brokers.broker_holdings(raw, multiline=True).collect()) == {"a": [("A", 3, None), ("B", 4, None)]}
    assert told(brokers.broker_holdings(raw).collect()) == {"a": [("B", 4, None)]}


def test_positions(spark):
    raw = files(
        spark,
        totals='Symbol,Quantity,Cost Basis Total\nNVDA,2,"$1,640.20"\nMSFT,5,"$2,050.00"\nBROKEN,--,""\n',
        cash="Account Number,Account Name,Symbol,Description,Quantity,Last Price,Current Value,Cost Basis Total,Average Cost Basis,Type\n"
        "X1,Own,SPAXX**,HELD IN MONEY MARKET,,,$286850.51,, ,Cash,\nX1,Own,IONQ,IONQ INC COM,136,$43.46,$5910.56,$1053.49,$7.75,Equity,\nX1,Own,LMT,LOCKHEED,3.091,$533.46,$1648.92,$1468.05,$474.94,Equity,\n",
        bare='"A\nB",1,2\r\nnvda x,1\r\nNVDA,3,(5)\r\n,,\r\n,4\r\n"un""quoted,7',
        twice="Ticker,Shares,Shares\nA,1,9\n", blank="", none=None,
    )
    got = {(r["file"], r["ticker"]): (r["shares"], r["average_cost"], r["current_value"]) for r in brokers.positions(raw).collect()}
    assert got.pop(("totals", "NVDA"))[1] == pytest.approx(820.1) and got.pop(("totals", "MSFT"))[1] == pytest.approx(410)
    assert got == {("cash", "IONQ"): (136, 7.75, 5910.56), ("cash", "LMT"): (3.091, 474.94, 1648.92), ("bare", "A"): (1, 2, None), ("bare", "NVDA"): (3, -5, None), ("twice", "A"): (9, None, None)}
    report = {r["file"]: (r["imported"], r["skipped"], r["cash"]) for r in brokers.position_report(raw).collect()}
    assert report == {"totals": (2, 1, None), "cash": (2, 0, 286850.51), "bare": (3, 2, None), "twice": (1, 0, None)}


def test_strategies(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    option = lambda days, kind, strike, delta, bid=1.0, ask=3.0, last=None: ("a", day(days), days, kind, float(strike), bid, ask, last, delta)
    quotes = [option(29, "call", 105, 0.25), option(31, "call", 106, 0.25, 8.0, 8.0), option(29, "call", 110, 0.2, 1.5, 1.5), option(29, "call", 120, 0.1, 0.5, 0.5), option(29, "put", 90, -0.2, 1.5, 1.5), option(29, "put", 80, -0.1, None, None, 0.5),
        option(29, "put", 91, -0.21, None, 1.0, None), option(29, "call", 111, None), option(60, "call", 95, 0.6, 6.0, 8.0), option(60, "put", 94, -0.25), option(0, "call", 1, 0.2)]
    chained = strategies.chains(spark.createDataFrame(quotes, "ticker string, expiration date, days int, kind string, strike double, bid double, ask double, last double, delta double"))
    r = chained.first()
    assert (r["income"]["days"], r["income"]["call_25"]["premium"], r["income"]["put_20"]["strike"], r["hedge"]["days"], r["hedge"]["put_20"]["strike"]) == (29, 2.0, 90.0, 60, 94.0)
    names = [("a", 100.0, "Hold", 60.0, 50.0, 0.5, 0.3, 0.2, 4.0, 0.3), ("b", 100.0, "Buy Now", 10.0, 10.0, 0.5, 0.1, 0.2, 9.0, 0.0), ("c", 100.0, None, None, None, None, None, None, None, None)]
    signals = spark.createDataFrame(names, "ticker string, spot double, action string, risk_score double, implied_vol_rank double, composite_z double, implied double, forecast double, sigma_20d double, down_8pct double")
    held = spark.createDataFrame([("a", 250.0)], "ticker string, shares double")
    got = [(r["ticker"], r["rank"], r["name"]) for r in strategies.strategies(signals, chained, held).orderBy("ticker", "rank").collect()]
    assert got == [("a", 1, "Covered Call"), ("a", 2, "Protective Put"), ("a", 3, "Iron Condor"), ("a", 4, "Vol Arb: Sell Premium"), ("b", 1, "Vol Arb: Buy Premium")]
    by = {r["name"]: r for r in strategies.strategies(signals, chained, held).filter("ticker = 'a'").collect()}
    put, call, condor = by["Protective Put"], by["Covered Call"], by["Iron Condor"]
    assert put["score"] == pytest.approx(12 + 30 + 20 + 30 - 2 * 365 / 60) and put["max_profit"] is None and put["max_loss"] == -800 and put["legs"][0]["quantity"] == 3
    assert call["score"] == 100.0
    assert (call["net_cost"], call["max_profit"], call["breakeven_low"], call["probability"], call["legs"][0]["quantity"]) == (-200, 700, 98, 0.875, 2)
    assert (condor["max_profit"], condor["max_loss"], condor["breakeven_low"], condor["breakeven_high"]) == (200, -800, 88, 112) and len(condor["legs"]) == 4
    assert condor["score"] == pytest.approx(0.6 * 60 + 4 + 15) and condor["probability"] == pytest.approx(0.6)


def test_sector_adjusted_ranks(spark):
    rows = [(1, f"s{i}", "big", float(i)) for i in range(8)] + [(1, f"t{i}", None, float(i) + 10) for i in range(2)] + [(1, "none", "big", None), (2, "one", "big", 5.0)]
    frame = spark.createDataFrame(rows, "date int, ticker string, sector string, x double")
    got = {r["ticker"]: r["rank"] for r in groups.sector_adjusted_ranks(frame, "x", "sector", ["date"]).collect()}
    assert got["s7"] == pytest.approx((100 + 7 / 9 * 100) / 2) and got["s0"] == 0 and got["t0"] == pytest.approx(8 / 9 * 100) and got["one"] == 50 and got["none"] is None and len(got) == 12


def test_benchmarks_and_cohorts(spark):
    metrics = spark.createDataFrame([("a", 10.0, 20.0, 61.0), ("x", 0.0, 10.0, 62.0), ("q", None, None, 63.0)], "ticker string, return_20d double, return_60d double, trend_60_score double")
    sectors = spark.createDataFrame([("a", "s"), ("x", "other")], "ticker string, sector string")
    of = lambda table, market: {r["ticker"]: (r["benchmark"], r["relative_strength_score"]) for r in groups.relative_strength(metrics, sectors, table, market).collect()}
    assert of({"s": "x"}, ("q",)) == {"a": ("x", pytest.approx(50 + 16.5 + 10.5)), "x": ("q", pytest.approx(66.5)), "q": ("q", 50)}
    assert of({"s": "gone"}, ("gone", "x"))["a"][0] == "x" and of({}, ("gone",)) == {"a": (None, 61), "x": (None, 62), "q": (None, 63)}
    rows = spark.createDataFrame([("1", "b", "Tech", 60.0), ("1", "a", "Tech", 80.0), ("2", "c", "Tech", 10.0), ("2", "d", None, 20.0), ("3", "e", "Tech", 1.0), ("", "f", "Tech", 1.0), (None, "g", "Tech", 1.0)], "c string, t string, s string, x double")
    got = sorted(tuple(r) for r in groups.cohorts(rows, "c", "t", "s", "x").collect())
    assert got == [("1", "tech cohort (1)", 2, ["a", "b"], 70.0, True), ("2", "cross-sector cohort (2)", 2, ["c", "d"], 15.0, False)]


def plain_uniform(n, seed=12345):
    """The generator one draw after another."""
    state, out = seed, []
    low = lambda x: x & 0xFFFFFFFF
    for _ in range(n):
        state = low(state + 0x6D2B79F5)
        t = low((state ^ state >> 15) * (state | 1))
        t ^= low(t + low((t ^ t >> 7) * (t | 61)))
        out.append((t ^ t >> 14) / 2**32)
    return out


def test_draws_skip_ahead(spark):
    rows = spark.createDataFrame([(n,) for n in (999, 0, 5, 1)], "n int")
    want = plain_uniform(1000)
    assert {r["n"]: r["u"] for r in paths.with_uniform(rows, "u", F.col("n"), 12345).collect()} == {n: want[n] for n in (999, 0, 5, 1)}


def test_forecasts(spark):
    rows = [("low", 0.1, 0.2), ("zero", 0.0, 0.0), ("none", None, 0.2)]
    make = lambda n: spark.createDataFrame(rows, "key string, drift double, volatility double").repartition(n)
    one, two = ({r["key"]: r for r in paths.forecast(paths.path_ends(make(n), 4000, 20)).collect()} for n in (1, 4))
    assert set(one) == {"low", "zero"} and (one["zero"]["mean_return_pct"], one["zero"]["p95"], one["zero"]["prob_up"]) == (0, 0, 0)
    t, low = 20 / 252, one["low"]
    normal, spread = NormalDist(), 0.2 * t**0.5
    end = lambda q: (math.exp((0.1 - 0.02) * t + spread * normal.inv_cdf(q)) - 1) * 100
    assert low["mean_return_pct"] == pytest.approx((math.exp(0.1 * t) - 1) * 100, abs=3 * 100 * spread / 4000**0.5)
    assert all(low[f"p{round(q * 100):02d}"] == pytest.approx(end(q), abs=0.6) for q in paths.QUANTILES)
    assert all(two["low"][c] == pytest.approx(low[c], abs=1e-9) for c in low.asDict() if c != "key")
    draws = plain_uniform(40)
    first = (math.exp(sum(0.08 / 252 + 0.2 * 252**-0.5 * normal.inv_cdf(u) for u in draws[20:])) - 1) * 100
    got = paths.path_ends(make(1), 2, 20).filter("key = 'low' and path = 1").first()["return_pct"]
    assert got == pytest.approx(first, abs=1e-6)
    jumping = make(2).withColumns({"intensity": F.lit(30.0), "jump_mean": F.lit(-0.1), "jump_vol": F.lit(0.01)})
    jumped = {r["key"]: r for r in paths.forecast(paths.path_ends(jumping, 4000, 20)).collect()}["low"]
    assert jumped["mean_return_pct"] == pytest.approx(low["mean_return_pct"], abs=1.2) and jumped["p05"] < low["p05"] - 10


def test_low_discrepancy(spark):
    rows = spark.range(6)
    a, b = paths.low_discrepancy(F.col("id"))
    got = rows.select("id", a.alias("a"), b.alias("b"), paths.quasi_uniform(F.col("id")).alias("q"), paths.quasi_uniform(F.col("id"), 1).alias("r")).orderBy("id").collect()
    assert [r["a"] for r in got] == [0, 0.5, 0.25, 0.75, 0.125, 0.625]
    assert [r["b"] for r in got] == pytest.approx([1 / 3, 2 / 3, 1 / 9, 4 / 9, 7 / 9, 2 / 9])
    assert all(0 < r["q"] < 1 and 0 < r["r"] < 1 for r in got) and len({r["q"] for r in got}) == 6


def test_archive_replaces_a_snapshot(spark, tmp_path):
    path, day = str(tmp_path / "archive"), lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    frame = lambda *rows: spark.createDataFrame(rows, "source string, as_of date, ticker string, price double")
    archive.save_snapshots(frame(("s", day(0), "a", 1.0), ("s", day(0), "b", 2.0), ("s", day(1), "a", 3.0), ("t", day(0), "a", 9.0)), path)
    archive.save_snapshots(frame(("s", day(0), "a", 5.0)), path)
    archive.save_snapshots(frame(("s", day(0), "a", 5.0)), path)
    rows = spark.read.parquet(path)
    assert sorted((r["source"], r["as_of"], r["price"]) for r in rows.collect()) == [("s", day(0), 5.0), ("s", day(1), 3.0), ("t", day(0), 9.0)]
    assert {tuple(r) for r in archive.archive_summary(rows).collect()} == {("s", 2, day(0), day(1), 2), ("t", 1, day(0), day(0), 1)}
    assert [r["price"] for r in archive.newest_snapshots(spark, path, 1).collect()] == [3.0] and archive.newest_snapshots(spark, path, 1, "t").first()["price"] == 9.0


def test_ledger(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    told = [(day(0), "a", 1, 10.0, 5.0), (day(0), "z", 3, 1.0, 0.0), (day(6), "a", 1, 99.0, 5.0), (day(8), "a", 1, 11.0, 9.0), (day(35), "a", 2, None, 1.0), (day(95), "b", 1, 1.0, 1.0)]
    got = {r["id"]: r for r in archive.ledger(spark.createDataFrame(told, "as_of date, ticker string, place int, price double, opportunity double"), 2).collect()}
    first = got["2024-01-01:a"]
    assert len(got) == 5 and (first["measured_at_5d"], first["return_pct_5d"], first["opportunity_delta_5d"], first["status_5d"]) == (day(8), pytest.approx(10), 4.0, "measured")
    assert (first["measured_at_20d"], first["return_pct_20d"], first["status_20d"], first["status_60d"], first["return_pct_60d"]) == (day(35), 0.0, "priceMissing", "pending", None)
    assert len(archive.ledger(spark.createDataFrame(told, "as_of date, ticker string, place int, price double, opportunity double"), 2, 2).collect()) == 2


def test_late_labels_as_a_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    bar = lambda t, k, close, gap=1, predicted=None: (t, k, start + dt.timedelta(days=k * gap), close, predicted)
    rows = [bar("a", k, 100.0 + k, predicted=float(k)) for k in range(30)] + [bar("slow", k, 10.0, 30, 1.0 if k < 3 else None) for k in range(24)] + [bar("z", 0, 0.0, predicted=7.0), bar("gone", 1, 5.0, predicted=8.0)]
    rows += [bar("clock", 800 + k, 1.0) for k in range(2)]
    schema, out = "ticker string, bar int, time timestamp, close double, predicted double", str(tmp_path)
    ends = (start + dt.timedelta(days=20), start + dt.timedelta(days=400))
    parts = [[r for r in rows if r[2] < ends[0]], [r for r in rows if ends[0] <= r[2] < ends[1]], [r for r in rows if r[2] >= ends[1]]]
    for part in parts:  # a stream each time, from where the last one stopped
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{out}/source")
        stream = lambda: spark.readStream.schema(schema).parquet(f"{out}/source")
        done = logs.run_to_end(labels.realized_labels(stream(), stream().drop("predicted")), spark, out)
    got = {(r["ticker"], r["predicted"], (r["time"] - start).days): (r["realized"], r["status"]) for r in done.collect()}
    want = {("a", float(k), k): (pytest.approx(2000 / (100 + k)), "realized") if k < 10 else (None, "expired") for k in range(30)}
    want |= {("slow", 1.0, 30 * k): (None, "expired") for k in range(3)} | {("z", 7.0, 0): (None, "expired"), ("gone", 8.0, 1): (None, "expired")}
    assert got == want and done.count() == len(want)


def test_event_risk(spark):
    rows = [("a", "Shares fall after PROBE, guidance cut", -4.0, 1), ("a", "All is well", None, 3), ("a", None, 2.0, 2), ("b", "quiet", None, None)] + [("c", "lawsuit", 0.0, k) for k in range(20)]
    got = {r["s"]: r for r in events.event_risk(spark.createDataFrame(rows, "s string, t string, tone double, at int"), "s", "t", "tone", "at").collect()}
    assert (got["a"]["articles"], got["a"]["negative_articles"], got["a"]["tone"], got["a"]["latest"], got["a"]["pressure_score"]) == (3, 1, -1.0, 3, pytest.approx(48.6))
    assert got["a"]["event_risk_score"] == pytest.approx((48.6 + 61) / 2) and got["b"]["event_risk_score"] == pytest.approx((36.2 + 50) / 2) and got["c"]["event_risk_score"] == 100


def test_one_list_a_date(spark):
    """Cohorts and serving batches: a date's list is not carried by its rows, null dates and missing values keep theirs."""
    rows = [(1, f"t{i}", float(i), 9.0, i % 6 > 0) for i in range(12)] + [(2, "x", 1.0, 9.0, True), (2, "y", 1.0, 1.0, True), (None, "n", None, None, True)]
    frame = spark.createDataFrame(rows, "date int, ticker string, cap double, age double, observed boolean")
    got = {r["ticker"]: r["cohort"] for r in panel.survivorship_cohorts(frame, "cap", "age", "observed").collect()}
    small = {f"t{i}" for i in (1, 2, 3)}
    assert got == {f"t{i}": "noFundamentals" if i % 6 == 0 else "survivorPrivileged" if f"t{i}" in small else "core" for i in range(12)} | {"x": "core", "y": "survivorPrivileged", "n": "core"}
    values = [(1, f"t{i}", v) for i, v in enumerate((1.0, 2.0, None, 3.0, 4.0))] + [(2, "s", 5.0), (3, "e", None)]
    got = {r["ticker"]: r["z"] for r in panel.batch_normalized(spark.createDataFrame(values, "date int, ticker string, x double"), "x", "z", 1.0, 2.0).collect()}
    filled = [1.0, 2.0, 3.0, 3.0, 4.0]
    level, wide = sum(filled) / 5, (sum((x - 2.6) ** 2 for x in filled) / 5) ** 0.5
    assert [got[f"t{i}"] for i in range(5)] == pytest.approx([(x - level) / wide for x in filled]) and (got["s"], got["e"]) == (2.0, 0.0)
    for made in (panel.survivorship_cohorts(frame, "cap", "age", "observed"), panel.batch_normalized(frame, "cap", "z", 0.0, 1.0)):
        assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString()


def test_cohort_cut_is_a_cap_of_its_date(spark):
    """Caps whose last digits differ each time they are told, as sums of doubles do; with and without missing caps in the count."""
    told_anew = F.udf(lambda x: x * (1 + random.SystemRandom().randrange(64) * 2.0**-52), "double").asNondeterministic()
    rows = [(d, f"t{i:02}", None if i > 11 else 1.0 + i, 9.0, True) for d in range(30) for i in range(15)]
    frame = spark.createDataFrame(rows, "date int, ticker string, cap double, age double, observed boolean")
    frame = frame.repartition(3, "ticker").withColumn("cap", F.when(F.col("cap").isNotNull(), told_anew(F.coalesce("cap", F.lit(1.0)))))
    for counted, n in ((None, 3), ("observed", 4)):
        got = panel.survivorship_cohorts(frame, "cap", "age", "observed", counted=counted).filter("cohort = 'survivorPrivileged'").collect()
        assert sorted((r["date"], r["ticker"]) for r in got) == [(d, f"t{i:02}") for d in range(30) for i in range(n)]


def test_cohorts_of_odd_trades(spark, tmp_path):
    """The query against its SQL: no ship date, no brand, no price in a whole bar or in a part of it."""
    rng, start, trades = random.Random(5), dt.datetime(1993, 1, 1), []
    for part in range(40):
        for day in (0, *range(1500, 1540)):
            for k in range(2):
                price = None if rng.random() < 0.4 else round(rng.uniform(900, 9000), 2)
                trades.append((part, float(rng.randint(1, 50)), price, None if day and rng.random() < 0.03 else start + dt.timedelta(days=day)))
    spark.createDataFrame(trades, "l_partkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"Brand#{k}" if k else None) for k in range(40)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert difference(registry.QUERIES["survivorship_cohorts"](spark, str(tmp_path)), str(tmp_path), registry.ORACLE_SQL["survivorship_cohorts"]) == ""


def test_pooled_medians(spark):
    """Against plain medians: dates without values, ties that a third of all rows share, two features, a late start."""
    rng = random.Random(3)
    rows = [(d, f"t{i}", None if d % 4 == 3 or d < 2 or rng.random() < 0.2 else (7.0 if rng.random() < 0.34 else rng.gauss(0, 50)), None if d < 11 else float(i)) for d in range(17) for i in range(40)]
    rows += [(None, "n", None, 3.0)]
    made = panel.imputed(spark.createDataFrame(rows, "date int, ticker string, x double, y double"), ["x", "y"])
    upper = lambda v: sorted(v)[len(v) // 2] if v else None

    def fill(d, k):
        own = upper([r[k] for r in rows if r[0] == d and d is not None and r[k] is not None])
        pool = [r[k] for r in rows if r[0] is not None and d is not None and r[0] <= d and r[k] is not None]
        return own if own is not None else upper(pool) if pool else 0.0

    want = {(r[0], r[1]): tuple(x for k in (2, 3) for x in ((r[k], False) if r[k] is not None else (fill(r[0], k), True))) for r in rows}
    assert {(r["date"], r["ticker"]): (r["x"], r["x_imputed"], r["y"], r["y_imputed"]) for r in made.collect()} == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
