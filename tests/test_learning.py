"""Boosted trees against a plain version, planted signals, and folds that share no labels."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import boosting, walkforward


def plain(x, y, trees, depth, rate, quantile=None, bins=64, least=5):
    """Predictions of one model, row by row and node by node."""
    at = lambda v, q: np.sort(v)[math.floor(q * len(v))]
    edges = [np.unique([np.sort(c)[b * len(c) // bins] for b in range(1, bins)]) for c in x.T]
    pred = np.full(len(y), at(y, quantile) if quantile else y.mean())
    for _ in range(trees):
        r = np.where(y > pred, quantile, quantile - 1) if quantile else y - pred
        add = np.zeros(len(y))

        def grow(rows, left, r=r, pred=pred, add=add):
            best = (0.0, None, None)
            spread = lambda v: (v * v).sum() - v.sum() ** 2 / len(v)
            if len(rows) > least and left and spread(r[rows]) > 1e-12 * (r[rows] ** 2).sum():
                for f, cut in enumerate(edges):
                    for e in cut:
                        low = x[rows, f] < e
                        if least <= low.sum() <= len(rows) - least:
                            gain = round((spread(r[rows]) - spread(r[rows][low]) - spread(r[rows][~low])) / spread(r[rows]), 12)
                            if gain > best[0]:
                                best = (gain, f, e)
            if best[1] is None:
                add[rows] = at(y[rows] - pred[rows], quantile) if quantile else r[rows].mean()
                return
            low = x[rows, best[1]] < best[2]
            grow(rows[low], left - 1)
            grow(rows[~low], left - 1)

        grow(np.arange(len(y)), depth)
        pred = pred + rate * add
    return pred


def planted(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (n, 3))
    x[:, 2] = np.round(x[:, 2])  # ties, and fewer edges than bins
    return x, 3 * x[:, 0] - 2 * x[:, 1] + rng.uniform(-0.75, 0.75, n)


@pytest.fixture(scope="module")
def signal(spark):
    x, y = planted(400)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(len(y))]
    return x, y, spark.createDataFrame(rows, "id int, a double, b double, c double, target double").withColumn("fit", F.lit(True))


def test_same_as_plain_version(spark, signal):
    x, y, rows = signal
    three = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(q).cast("double").alias("quantile")) for m, q in (("mean", None), ("low", 0.1), ("high", 0.9))]))
    got, models = boosting.boost(rows.withColumn("m", three).select("*", "m.*").drop("m"), ["a", "b", "c"], trees=4, depth=3)
    for m, q in (("mean", None), ("low", 0.1), ("high", 0.9)):
        told = np.array([r[0] for r in got.filter(F.col("model") == m).orderBy("id").select("prediction").collect()])
        assert np.allclose(told, plain(x, y, 4, 3, 0.1, q))
    again = [r[0] for r in rows.select(models["mean"].score().alias("p"), "id").orderBy("id").select("p").collect()]
    assert np.allclose(again, plain(x, y, 4, 3, 0.1))


def test_recovers_signal(spark, signal):
    x, y, rows = signal
    unseen = spark.createDataFrame([(-1, 1.0, -1.0, None, None, False), (-2, -1.0, 1.0, float("nan"), None, False)], "id int, a double, b double, c double, target double, fit boolean")
    named = boosting.bagged(rows.unionByName(unseen).withColumns({"model": F.lit("m"), "quantile": F.lit(None).cast("double")}), ["id"], bags=2)
    got, models = boosting.boost(named, ["a", "b", "c"], trees=12, depth=3, rate=0.35)
    assert sorted(models) == ["m#0", "m#1"] and all(len(m.trees) == 12 for m in models.values())
    told = {r["id"]: r["p"] for r in got.groupBy("id").agg(F.avg("prediction").alias("p")).collect()}
    assert np.corrcoef([told[i] for i in range(len(y)) if i in told], [y[i] for i in range(len(y)) if i in told])[0, 1] > 0.9
    assert told[-1] > 2 and told[-2] < -2
    share = got.filter("id >= 0").groupBy("model").count().collect()
    assert all(0.7 < r["count"] / len(y) < 0.9 for r in share)


def test_no_rows_to_fit(spark):
    rows = spark.createDataFrame([(1.0, 1.0, False, "m", None)], "a double, target double, fit boolean, model string, quantile double")
    got, models = boosting.boost(rows, ["a"], trees=1)
    assert got.count() == 0 and models == {}


def daily(spark, n_dates=120, names=6, horizon=5, seed=3):
    rng = np.random.default_rng(seed)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=int(k))
    rows = []
    for d in range(n_dates):
        for t in range(names):
            x = rng.normal(size=2)
            rows.append((f"t{t}", day(d), day(d + horizon), float(x[0]), float(x[1]), float(2 * x[0] + rng.normal() * 0.3)))
    return spark.createDataFrame(rows, "ticker string, date date, label_end date, x double, z double, y double"), rows


def test_folds_share_no_labels(spark):
    samples, rows = daily(spark)
    members, table = walkforward.folds(samples.repartition(5), "label_end", first=0.5, size=0.2, embargo=9)
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    begin, step = len(rows) // 2, len(rows) // 5
    told = {r["fold"]: r for r in table.collect()}
    assert sorted(told) == [0, 1]
    for k, r in told.items():
        test = rows[begin + k * step : begin + (k + 1) * step]
        train = [x for x in rows[: begin + k * step] if x[2] < test[0][1] and (test[0][1] - x[1]).days >= 9]
        got = members.filter(F.col("fold") == k)
        key = lambda q: sorted((x["ticker"], x["date"]) for x in q.collect())
        assert key(got.filter("fit")) == sorted(x[:2] for x in train) and key(got.filter("NOT fit")) == sorted(x[:2] for x in test)
        assert (r["n_test"], r["n_train"], r["n_candidates"]) == (len(test), len(train), begin + k * step) and r["last_label_end"] < r["test_start"]
    assert walkforward.folds(samples.limit(20), "label_end")[1].count() == 0
    assert walkforward.folds(samples.limit(0), "label_end")[1].count() == 0


def test_walk_forward_finds_signal_and_covers(spark):
    samples, _ = daily(spark)
    told = walkforward.walk_forward(samples, ["x", "z"], "y", "label_end", bags=2, trees=12, depth=2, rate=0.25, first=0.6, size=0.2)
    rows = told.collect()
    assert len(rows) == 2 * 144 and all(r["lower"] < r["upper"] for r in rows)
    for r in walkforward.fold_scores(told).collect():
        assert r["n"] == 144 and r["ic"] > 0.9 and r["rank_ic"] > 0.85 and r["hit_rate"] > 0.8 and 0.7 < r["coverage"] < 0.92
