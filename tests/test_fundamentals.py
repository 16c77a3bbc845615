"""Facts by filing date: restatements, missing quarters, strict joins."""

import datetime as dt

import pytest

from tidewater.operators import filings

SCHEMA = "symbol string, concept string, since date, until date, filed date, value double, span string"


def day(text):
    return dt.date.fromisoformat(text)


def quarters(year, values, symbol="a", concept="revenue"):
    ends = ["03-31", "06-30", "09-30", "12-31"]
    return [(symbol, concept, day(f"{year}-{int(e[:2]) - 2:02d}-01"), day(f"{year}-{e}"), day(f"{year}-{e}") + dt.timedelta(40), float(v), "quarter") for e, v in zip(ends, values, strict=False)]


def known(spark, rows):
    return {r["known"]: r for r in filings.snapshots(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_restatement_counts_from_its_own_date(spark):
    rows = quarters(2020, [1, 2, 3, 4])
    again = ("a", "revenue", *rows[0][2:4], day("2021-06-01"), 11.0, "quarter")
    got = known(spark, [*rows, again, rows[1], ("a", "revenue", None, None, day("2020-01-01"), 5.0, "quarter"), ("a", "other", None, day("2020-01-01"), day("2022-01-01"), 5.0, "instant")])
    assert sorted(got) == [r[4] for r in rows] + [again[4]]
    assert [got[d]["ttm_revenue"] for d in sorted(got)] == [None, None, None, 10.0, 20.0]


def test_year_rolled_forward_needs_the_quarter_before(spark):
    year = ("a", "revenue", day("2020-01-01"), day("2020-12-31"), day("2021-03-01"), 100.0, "annual")
    got = known(spark, [*quarters(2020, [20, 25, 25]), year, *quarters(2021, [30])])
    assert got[day("2021-03-01")]["ttm_revenue"] == 100.0 and got[day("2021-05-10")]["ttm_revenue"] == 110.0
    without = known(spark, [year, *quarters(2021, [30])])
    assert without[day("2021-05-10")]["ttm_revenue"] == 100.0


def test_features_are_of_filings_before_the_day(spark):
    facts = spark.createDataFrame([*quarters(2020, [1, 2, 3, 4], concept="netIncome"), ("a", "shares", None, day("2020-12-31"), day("2021-02-09"), 100.0, "instant")], SCHEMA)
    prices = spark.createDataFrame([(t, day(d), 2.0, 0.2, 5.0) for t, d in [("a", "2020-01-01"), ("a", "2021-02-09"), ("a", "2021-02-10"), ("b", "2021-02-10")]], "ticker string, date date, last_close double, volatility double, change double")
    got = {(r["ticker"], str(r["date"])): r for r in filings.fund_features(prices, filings.snapshots(facts)).collect()}
    assert len(got) == 4 and got[("a", "2021-02-09")]["fund_earnings_yield"] is None
    after = got[("a", "2021-02-10")]
    assert after["fund_earnings_yield"] == pytest.approx(5.0) and after["fund_filing_age"] == 1.0 and after["fund_log_market_cap"] == 10.0 and after["fund_naive_dd"] is None
    assert got[("b", "2021-02-10")]["fund_filing_age"] == got[("a", "2020-01-01")]["fund_filing_age"] == 400.0


def test_no_facts(spark):
    assert known(spark, []) == {}
