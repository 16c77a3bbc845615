"""Evidence lists and the gate of a model's direction: each rule alone, order, limits and nulls."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import evidence as ev

GOOD = {"verdictSource": "ml", "dataConfidence": 90.0, "fundamentalsSource": ev.FILINGS, "fundamentalsAsOf": "2024-02-01", "priceAsOf": "2024-03-01T21:00:00Z", "priceBasis": ev.ADJUSTED, "dataSource": "feed", "dataWarnings": []}
FORECAST = {"normalizationMode": ev.LIVE, "asOf": "2024-03-01", "predictedReturn20d": 2.0, "p10Return20d": 0.5, "p90Return20d": 4.25}
SCHEMA = (
    "verdictSource string, dataConfidence double, fundamentalsSource string, fundamentalsAsOf string, priceAsOf string, priceBasis string, dataSource string, dataWarnings array<string>, "
    "forecast struct<normalizationMode: string, asOf: string, predictedReturn20d: double, p10Return20d: double, p90Return20d: double>"
)


def assessed(spark, cases, direction="bullish", scenario="base"):
    rows = []
    for i, (row, forecast) in enumerate(cases):
        told = None if forecast is None else tuple((FORECAST | forecast).values())
        rows.append((i, *(GOOD | row).values(), told))
    out = ev.ml_evidence(spark.createDataFrame(rows, "i int, " + SCHEMA).repartition(2), direction, scenario).orderBy("i").collect()
    assert all(r["decision_grade"] == (not r["blockers"]) for r in out)
    return out


def test_each_blocker_alone(spark):
    b = ev.BLOCKERS
    cases = [
        ({}, {}, None),
        ({"verdictSource": "rules"}, {}, b["source"]),
        ({"verdictSource": None}, {}, b["source"]),
        ({"dataConfidence": 79.5}, {}, b["confidence"] % 80),
        ({"dataConfidence": None}, {}, b["confidence"] % 0),
        ({"fundamentalsSource": None}, {}, b["filings"]),
        ({"fundamentalsAsOf": "2024-02-30"}, {}, b["filing day"]),
        ({"fundamentalsAsOf": "2024-03-02"}, {}, b["order"] % ("2024-03-02", "2024-03-01")),
        ({"priceAsOf": None}, {}, b["price day"]),
        ({"priceBasis": "close"}, {}, b["basis"]),
        ({"dataWarnings": ["Feed is STALE"]}, {}, b["stale"]),
        ({"dataWarnings": ["stalemate", " ", None]}, {}, None),
        ({}, None, b["forecast"]),
        ({}, {"normalizationMode": "frozen"}, b["mode"]),
        ({}, {"asOf": "today"}, b["forecast day"]),
        ({}, {"asOf": "2024-02-29"}, b["days"] % ("2024-02-29", "2024-03-01")),
        ({}, {"p10Return20d": float("nan")}, b["interval"]),
        ({}, {"p10Return20d": 3.0}, b["interval"]),
        ({}, {"p90Return20d": float("inf")}, b["interval"]),
        ({}, {"p90Return20d": None}, b["interval"]),
        ({}, {"p10Return20d": 0.0}, b["bullish"]),
    ]
    got = assessed(spark, [c[:2] for c in cases])
    for (row, forecast, want), r in zip(cases, got, strict=True):
        assert r["blockers"] == ([want] if want else []), (row, forecast)
    assert got[0]["uncertainty"] == "80% relative-return interval +0.5% to +4.3%" and got[0]["evidence_source"] == "feed + SEC EDGAR XBRL"
    assert got[12]["uncertainty"] == ev.UNKNOWN_INTERVAL and got[11]["caveats"] == ["stalemate"]


def test_directions_scenarios_and_sources(spark):
    falls = {"predictedReturn20d": -2.0, "p10Return20d": -4.0, "p90Return20d": -0.5}
    one, two = assessed(spark, [({"dataSource": " "}, falls), ({"dataSource": None, "fundamentalsSource": "x"}, {})], "bearish")
    assert one["decision_grade"] and one["evidence_source"] == "SEC EDGAR XBRL"
    assert two["blockers"] == [ev.BLOCKERS["filings"], ev.BLOCKERS["bearish"]] and two["evidence_source"] == ev.UNKNOWN_SOURCE
    assert assessed(spark, [({}, {})], "bullish", "volJump")[0]["blockers"] == [ev.BLOCKERS["scenario"]]
    with pytest.raises(ValueError):
        assessed(spark, [({}, {})], "sideways")


def test_lists_of_a_signal(spark):
    names = "momentum_z growth_z quality_z value_z lowVol_z fragility_z risk_z dataConfidence impliedVolRank skewRisk crowding relativeStrength revisionTrend breadth".split()
    calm = dict.fromkeys(names, 0.0) | {"dataConfidence": 60.0, "relativeStrength": 70.0, "revisionTrend": 65.0, "breadth": 51.0}
    cases = [
        (calm, 10, None),
        (calm | {"momentum_z": 0.5, "growth_z": 1.26, "quality_z": 2.0, "value_z": 0.49, "lowVol_z": 3.0, "dataConfidence": 75.0}, 10, None),
        (calm | {"dataConfidence": 44.0, "risk_z": 0.8, "fragility_z": -0.8, "impliedVolRank": 65.0, "skewRisk": 64.5}, 60, ["late", "late"]),
        (calm | {"crowding": 68.0, "breadth": 50.0, "relativeStrength": 69.0, "revisionTrend": 0.0, "skewRisk": 58.0}, 60, ["late", "late", None]),
        (calm | {"dataConfidence": None, "momentum_z": None}, None, []),
    ]
    rows = [(i, *c.values(), damage, "risk-on-broad", warnings) for i, (c, damage, warnings) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} double" for n in names) + ", thesis_damage bigint, regime string, dataWarnings array<string>")
    got = ev.signal_evidence(frame.withColumn("dataSource", F.lit("synced"))).orderBy("i").collect()
    reasons, flags, ends = (lambda i, k=k: got[i][k] for k in ("reasons", "risk_flags", "invalidation"))
    assert reasons(0) == ["Mixed factor profile in a risk on broad regime — no factor clears 0.5σ."] == reasons(4) and flags(0) == [ev.NO_FLAG] == flags(4)
    assert [x.split(" ")[0] + x.split("+")[1][:4] for x in reasons(1)[:3]] == ["Momentum0.5σ", "Growth1.3σ", "Quality2.0σ"] and len(reasons(1)) == 4 and reasons(1)[3].startswith("Low-vol factor +3.0σ")
    assert flags(2) == [ev.LOW_CONFIDENCE, ev.HIGH_RISK % "0.8", ev.FRAGILE % "-0.8", ev.LEVELS[0][2] % "65"]
    assert flags(3) == [ev.LEVELS[2][2] % "68", ev.LEVELS[3][2] % "60", "late"]
    assert ends(0) == [ev.INVALID["strength"][0], ev.INVALID["revisions"][0]] and ends(3) == [ev.INVALID["strength"][1], ev.INVALID["revisions"][1], ev.INVALID["skew"]]
    assert ev.signal_evidence(frame.limit(0)).count() == 0
