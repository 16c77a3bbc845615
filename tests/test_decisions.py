"""Decision rules and calibration against hand-made cases and brute force."""

import numpy as np
import pytest

from tidewater.functions import columns as fx
from tidewater.functions import scalars
from tidewater.operators import calibration, decisions


def test_isotonic_against_pooling(spark):
    rng = np.random.default_rng(3)
    p = np.sort(rng.random(200)).round(6)
    rows = [(float(x), float(rng.random() < x)) for x in p]
    blocks = []
    for _, y in rows:
        blocks.append([y, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v, c = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * c) / (blocks[-1][1] + c), blocks[-1][1] + c]
    want = [v for v, c in blocks for _ in range(c)]
    got = calibration.isotonic(spark.createDataFrame(rows, "p double, y double"), "p", "y").orderBy("p").collect()
    assert [r["calibrated"] for r in got] == pytest.approx(want, abs=1e-9)


def test_bootstrap(spark):
    make = lambda n: spark.createDataFrame([(i, float(i % 7)) for i in range(n)], "d int, v double")
    one, two = (calibration.bootstrap_mean(make(400), "d", "v", iterations=200).first() for _ in range(2))
    assert one == two and one["lower"] < one["mean"] < one["upper"]
    assert one["mean"] == pytest.approx(np.mean([i % 7 for i in range(400)]))
    assert len(set(calibration.bootstrap_mean(make(20), "d", "v").first())) == 1


def test_scalars(spark):
    rows = [("$1,234.5", "$aapl"), ("(12)", "BRK.B ($5)"), ("", "1X"), (None, None), ("x", "msft — Microsoft")]
    got = spark.createDataFrame(rows, "n string, t string").select(scalars.parse_number("n"), scalars.sanitize_ticker("t")).collect()
    assert [tuple(r) for r in got] == [(1234.5, "AAPL"), (-12.0, "BRK.B"), (None, None), (None, None), (None, "MSFT")]


def test_scores_survive_nulls_and_flat_universes(spark):
    fields = ", ".join(f"{f} double" for f in decisions.FIELDS)
    same = tuple(50.0 for _ in decisions.FIELDS)
    df = spark.createDataFrame([(1, None, *same), (2, 10.0, *([None] * len(same)))], f"id int, dataConfidence double, {fields}")
    rows = decisions.score_universe(df, decisions.universe_stats(df)).collect()
    assert {r["action"] for r in rows} == {"Hold"} and {r["opportunity"] for r in rows} == {50} and {r["regime"] for r in rows} == {"mixed"}


def test_two_distributions_agree(spark):
    r = spark.range(1).select((fx.scorer_cdf(0.7) - fx.normal_cdf(0.7)).alias("a"), (fx.scorer_cdf(-2.0) - fx.normal_cdf(-2.0)).alias("b")).first()
    assert abs(r["a"]) < 1e-6 and abs(r["b"]) < 1e-6


def test_conviction_needs_three_layers(spark):
    schema = "i int, alpha double, skew_percentile double, ml double, monte_carlo double, gated boolean, horizons array<double>"
    rows = [
        (1, 90.0, None, None, None, None, None),
        (2, 90.0, 79.9, 1.0, 0.44, False, [1.0, 2.0, 3.0, -1.0]),
        (3, 90.0, 10.0, 1.0, 0.43, True, [1.0, -2.0, None]),
        (4, 10.0, 80.0, 0.0, None, None, [1.0, 2.0]),
        (5, None, 10.0, 1.0, None, False, []),
    ]
    got = {r["i"]: (r["passed"], r["available"], r["label"]) for r in decisions.conviction(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == (1, 1, "Insufficient evidence") and got[2] == (6, 6, "High conviction")
    assert got[3] == (3, 6, "Mixed") and got[4] == (0, 3, "Weak") and got[5] == (3, 3, "Solid")
