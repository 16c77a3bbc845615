"""Registered queries on boosted trees and walk-forward tests, with SQL for bins, a split and the folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, panel, walkforward
from ..sources.tables import bars
from .market import BARS, W, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

FEATURES = ["momentum_20d", "momentum_5d", "range_1d", "volume_1d"]
SAMPLES = BARS + f""", s AS (SELECT ticker, date, (lag(close, 1) OVER w / lag(close, 21) OVER w - 1) * 100 AS momentum_20d, (lag(close, 1) OVER w / lag(close, 6) OVER w - 1) * 100 AS momentum_5d,
  lag(high, 1) OVER w / lag(low, 1) OVER w AS range_1d, lag(volume, 1) OVER w AS volume_1d, (lead(close, 20) OVER w / close - 1) * 100 AS fwd, lead(date, 20) OVER w AS label_end FROM bars WINDOW w AS ({W})),
samples AS (SELECT *, CASE WHEN count(*) OVER d >= 5 THEN fwd - avg(fwd) OVER d ELSE fwd END AS rel FROM s WHERE momentum_20d IS NOT NULL AND fwd IS NOT NULL WINDOW d AS (PARTITION BY date)),
long AS (SELECT rel - avg(rel) OVER () AS r, unnest({FEATURES}) AS feature, unnest([{', '.join(FEATURES)}]) AS x FROM samples),
sorted AS (SELECT feature, count(*) AS n, list_sort(list(x)) AS xs FROM long GROUP BY feature),
e AS (SELECT feature, list_sort(list_distinct(list_transform(range(1, 64), lambda b: xs[b * n // 64 + 1]))) AS edges FROM sorted),
b AS (SELECT feature, edges, r, len(list_filter(edges, lambda y: y <= x)) AS bin FROM long JOIN e USING (feature)),
h AS (SELECT feature, bin, any_value(edges) AS edges, count(*) AS n, sum(r) AS s, sum(r * r) AS ss FROM b GROUP BY feature, bin)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def samples(spark, sf_dir):
    w = panel.by_ticker()
    back = lambda c, k: F.lag(c, k).over(w)
    change = lambda k: (back("close", 1) / back("close", k + 1) - 1) * 100
    rows = bars(spark, sf_dir).select("ticker", "date", change(20).alias("momentum_20d"), change(5).alias("momentum_5d"), (back("high", 1) / back("low", 1)).alias("range_1d"), back("volume", 1).alias("volume_1d"),
        ((F.lead("close", 20).over(w) / F.col("close") - 1) * 100).alias("fwd"), F.lead("date", 20).over(w).alias("label_end"))
    return panel.demeaned(rows.filter("momentum_20d is not null and fwd is not null"), "fwd", "rel")


def _root(spark, sf_dir):
    """Edges of the whole panel as one model, and the sums of its root."""
    rows = samples(spark, sf_dir).select(*FEATURES, "rel", F.lit("all").alias("model"), F.lit(True).alias("fit"), F.lit(1).alias("node"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.avg("rel").alias("mean")))).withColumn("r", F.col("rel") - F.col("mean"))  # one row
    edges = boosting.edges(rows, FEATURES, accuracy=1_000_000)
    return boosting.histograms(boosting.binned(rows, FEATURES, edges), "r"), edges


def _named(rows, edges, at):
    names = F.array(*map(F.lit, FEATURES))
    return rows.join(edges, "model").withColumn("edge", F.get(F.get("edges", F.col("feature")), at)).withColumn("feature", F.get(names, F.col("feature")))


@query(SAMPLES + "SELECT feature, CAST(bin AS INT) AS bin, round(edges[bin], 6) AS edge, n, round(s, 4) AS s, round(ss, 3) AS ss FROM h")
def boost_histograms(spark, sf_dir):
    sums, edges = _root(spark, sf_dir)
    return _named(sums, edges, F.col("bin") - 1).select("feature", "bin", F.round("edge", 6).alias("edge"), "n", F.round("s", 4).alias("s"), F.round("ss", 3).alias("ss"))


@query(SAMPLES + """, t AS (SELECT *, sum(n) OVER l AS ln, sum(s) OVER l AS ls, sum(ss) OVER l AS lss, sum(n) OVER a AS tn, sum(s) OVER a AS ts, sum(ss) OVER a AS tss FROM h
  WINDOW l AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature)),
g AS (SELECT feature, edges[bin + 1] AS threshold, CAST(ln AS BIGINT) AS left_n, CAST(tn - ln AS BIGINT) AS right_n, (tss - ts * ts / tn) - (lss - ls * ls / ln) - (tss - lss - (ts - ls) ** 2 / (tn - ln)) AS gain FROM t WHERE ln >= 5 AND tn - ln >= 5)
SELECT feature, round(threshold, 6) AS threshold, round(gain, 2) AS gain, left_n, right_n FROM g ORDER BY g.gain DESC LIMIT 1""")
def boost_first_split(spark, sf_dir):
    sums, edges = _root(spark, sf_dir)
    return _named(boosting.best_splits(sums), edges, F.col("bin")).select("feature", F.round("edge", 6).alias("threshold"), F.round("gain", 2).alias("gain"), "left_n", "right_n")


@query(SAMPLES + """, placed AS (SELECT *, row_number() OVER (ORDER BY date, ticker) - 1 AS place FROM samples),
k AS (SELECT CAST(floor(count(*) * 0.6) AS BIGINT) AS first, greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) AS step, count(*) AS n FROM samples),
f AS (SELECT CAST(unnest(range(0, (n - first) // step)) AS INT) AS fold, first, step FROM k),
tests AS (SELECT fold, first + fold * step AS split, min(date) AS test_start, max(date) AS test_end, count(*) AS n_test FROM f JOIN placed ON place >= first + fold * step AND place < first + (fold + 1) * step GROUP BY ALL)
SELECT fold, test_start, test_end, n_test, count(*) FILTER (known) AS n_train, max(date) FILTER (known) AS train_end, max(label_end) FILTER (known) AS last_label_end, count(*) AS n_candidates, max(label_end) FILTER (known) < test_start AS apart
FROM (SELECT t.*, date, label_end, label_end < test_start AND date_diff('day', date, test_start) >= 5 AS known FROM tests t JOIN placed ON place < split)
GROUP BY fold, test_start, test_end, n_test HAVING n_test >= 10 AND count(*) FILTER (known) >= 50""")
def walk_forward_folds(spark, sf_dir):
    _, table = walkforward.folds(samples(spark, sf_dir), "label_end")
    return table.select("fold", "test_start", "test_end", "n_test", "n_train", "train_end", "last_label_end", "n_candidates", (F.col("last_label_end") < F.col("test_start")).alias("apart"))


@query()
def walk_forward_scores(spark, sf_dir):
    told = walkforward.walk_forward(samples(spark, sf_dir), FEATURES, "rel", "label_end", bags=2, trees=12)
    return rounded(walkforward.fold_scores(told))
