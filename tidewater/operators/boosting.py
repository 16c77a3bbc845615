"""Gradient boosting over binned features, many models at once.

Rows carry the name of their model, so the models of all folds, bags and quantiles grow in the same jobs. A tree
grows level by level: per model, node, feature and bin the sums of what is to be explained are added up where the
rows lie and once more behind a shuffle, a few numbers for each; the split of a node is found on those sums alone.
Only splits and leaf values come to the driver: at most 2 ** depth rows a model and level. Rows that are not to be
fitted (``fit`` false) go along and are predicted with the rest.

Null or NaN features count as the largest value. Edges and quantile leaves are exact for models of up to half
of ``accuracy`` fitted rows, and beyond that within 1 / accuracy of their rank.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import Stage

BINS, LEAST, ACCURACY = 64, 5, 20_000
#: What lifts a share just above a whole rank, so that a quantile is the value at floor(share * n), counted from 0.
ABOVE = 1e-9


@dataclass
class Boosted:
    """One model: features in order, value to start with, and trees as {node: (feature, threshold) or value}; node n has children 2n and 2n + 1."""

    features: list[str]
    base: float
    rate: float
    trees: list[dict[int, tuple[str, float] | float]] = field(default_factory=list)

    def score(self) -> Column:
        """The model as one expression over its features."""

        def grown(tree: dict, node: int) -> Column:
            if not isinstance(tree[node], tuple):
                return F.lit(float(tree[node]))
            name, threshold = tree[node]
            return F.when(F.col(name) < threshold, grown(tree, 2 * node)).otherwise(grown(tree, 2 * node + 1))

        out = F.lit(float(self.base))
        for tree in self.trees:
            out = out + self.rate * grown(tree, 1)
        return out


def edges(rows: DataFrame, features: list[str], bins: int = BINS, accuracy: int = ACCURACY) -> DataFrame:
    """model, edges: for each feature the distinct values at floor(b * n / bins) of the fitted rows' order, ascending."""
    shares = [b / bins + ABOVE for b in range(1, bins)]
    # null and NaN are above all edges, so an edge is never one of them
    of = [F.array_sort(F.array_distinct(F.filter(F.percentile_approx(F.coalesce(f, F.lit(float("nan"))), shares, accuracy), lambda e: ~F.isnan(e)))) for f in features]
    return rows.filter("fit").groupBy("model").agg(F.array(*of).alias("edges"))


def binned(rows: DataFrame, features: list[str], found: DataFrame) -> DataFrame:
    """rows with ``bins``: for each feature how many of its model's edges are at most the value."""
    place = lambda i, f: F.size(F.filter(F.get("edges", F.lit(i)), lambda e: e <= F.coalesce(F.col(f), F.lit(float("nan")))))
    return rows.join(found, "model").withColumn("bins", F.array(*[place(i, f) for i, f in enumerate(features)])).drop("edges")


def histograms(rows: DataFrame, value: str) -> DataFrame:
    """n, s, ss of the value by model, node, feature (its place) and bin."""
    cells = rows.select("model", "node", F.col(value).alias("r"), F.posexplode("bins").alias("feature", "bin"))
    return cells.groupBy("model", "node", "feature", "bin").agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss"))


def best_splits(sums: DataFrame, least: int = LEAST) -> DataFrame:
    """model, node, feature, bin, gain: the split behind a bin that takes most of the variance away.

    Of gains that are the same share of the node's variance to twelve digits the first feature's and bin's is taken, so
    the order in which sums are added does not decide.
    """
    whole = Window.partitionBy("model", "node", "feature")
    left = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = sums.select("model", "node", "feature", "bin", *[F.sum(c).over(left).alias(f"l{c}") for c in ("n", "s", "ss")], *[F.sum(c).over(whole).alias(f"t{c}") for c in ("n", "s", "ss")])
    rows = rows.withColumns({f"r{c}": F.col(f"t{c}") - F.col(f"l{c}") for c in ("n", "s", "ss")}).filter((F.col("tn") > least) & (F.col("ln") >= least) & (F.col("rn") >= least))
    spread = lambda k: F.col(f"{k}ss") - F.col(f"{k}s") * F.col(f"{k}s") / F.col(f"{k}n")
    rows = rows.withColumn("gain", spread("t") - (spread("l") + spread("r"))).filter(spread("t") > 1e-12 * F.col("tss"))  # else all are equal
    rows = rows.withColumn("share", F.round(F.try_divide("gain", spread("t")), 12)).filter("share > 0")
    first = F.max(F.struct("share", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gain", "ln", "rn")).alias("best")
    return rows.groupBy("model", "node").agg(first).select("model", "node", (-F.col("best.f")).alias("feature"), (-F.col("best.b")).alias("bin"), "best.gain", F.col("best.ln").alias("left_n"), F.col("best.rn").alias("right_n"))


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # 2 ** depth rows a model at most


def bagged(rows: DataFrame, key: list[str], bags: int = 5, share: float = 0.8, seed: int = 42, least: int = 100) -> DataFrame:
    """Each model as ``bags`` members, <model>#<number>, fitted on a seeded share of its rows; a member of fewer than ``least`` is fitted on all."""
    members = rows.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "model", "bag", *key), F.lit(1_000_000)) < share * 1_000_000
    members = members.withColumn("drawn", drawn & F.col("fit"))
    few = members.groupBy("model", "bag").agg((F.count_if("drawn") < least).alias("all"))
    members = members.join(few, ["model", "bag"]).filter("NOT fit OR drawn OR all")
    return members.withColumn("model", F.concat_ws("#", "model", "bag")).drop("bag", "drawn", "all")


def boost(rows: DataFrame, features: list[str], trees: int = 50, depth: int = 3, rate: float = 0.1, bins: int = BINS, least: int = LEAST, accuracy: int = ACCURACY) -> tuple[DataFrame, dict[str, Boosted]]:
    """The rows with ``prediction``, and the models by name.

    rows: model, fit, target, quantile (null: squared loss, the mean is told; else that quantile), the features, others.
    A model without fitted rows has no predictions and is left out.
    """
    spark = rows.sparkSession
    fitted = rows.filter(F.col("fit") & F.col("target").isNotNull())
    # of all quantiles asked for the model's own one: few levels are in use
    levels = sorted(q["quantile"] for q in fitted.select("quantile").distinct().filter("quantile is not null").collect())

    def told(value: Column, name: str) -> Column:
        by_level = [F.when(F.first("quantile") == q, F.percentile_approx(value, q + ABOVE, accuracy)) for q in levels]
        return F.coalesce(*by_level, F.avg(value)).alias(name)

    found = edges(rows.filter("target is not null"), features, bins, accuracy)
    start = fitted.groupBy("model").agg(told(F.col("target"), "prediction"))
    stage = Stage(spark, "boosting")
    state = stage.put(binned(rows, features, found).join(start, "model"))
    models = {r["model"]: Boosted(features, r["prediction"], rate) for r in start.collect()}
    known = {r["model"]: r["edges"] for r in found.collect()}
    explained = F.when(F.col("quantile").isNull(), F.col("target") - F.col("prediction")).when(F.col("target") > F.col("prediction"), F.col("quantile")).otherwise(F.col("quantile") - 1)
    for _ in range(trees):
        now = state.withColumn("node", F.lit(1))
        grown: dict[str, dict] = {m: {} for m in models}
        for _ in range(depth):
            sums = histograms(now.filter("fit AND target is not null").withColumn("r", explained), "r")
            splits = [tuple(r) for r in best_splits(sums, least).select("model", "node", "feature", "bin").collect()]
            if not splits:
                break
            for m, node, f, b in splits:
                grown[m][node] = (features[f], known[m][f][b])
            split = _local(spark, splits, "model string, node int, feature int, bin int")
            go = F.when(F.get("bins", F.col("feature")) <= F.col("bin"), 2 * F.col("node")).when(F.col("bin").isNotNull(), 2 * F.col("node") + 1).otherwise(F.col("node"))
            now = now.join(split, ["model", "node"], "left").withColumn("node", go).drop("feature", "bin")
        gap = F.col("target") - F.col("prediction")
        leaves = [tuple(r) for r in now.filter("fit AND target is not null").groupBy("model", "node").agg(told(gap, "value")).collect()]
        for m, node, value in leaves:
            grown[m][node] = value
        for m, tree in grown.items():
            models[m].trees.append(tree)
        leaf = _local(spark, leaves, "model string, node int, value double")
        state = stage.put(now.join(leaf, ["model", "node"], "left").withColumn("prediction", F.col("prediction") + rate * F.coalesce("value", F.lit(0.0))).drop("node", "value"))
    return state.drop("bins"), models
