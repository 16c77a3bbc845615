"""Walk-forward tests: folds over samples in order of time, trained on what was known before each.

A fold's training rows are those before its test rows whose labels end before the first test date (purge) and
whose own date is ``embargo`` days before it or more. All folds are fitted together, as models of one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_corr
from ..sources.staging import Stage
from .boosting import bagged, boost


def placed(samples: DataFrame, *by: str, out: str = "at") -> DataFrame:
    """samples (ticker, date) with their number by date and ticker from 0, within ``by``. Only counts by date are summed up in order."""
    dates = samples.groupBy(*by, "date").agg(F.count("*").alias("n"))  # one row a calendar date
    ahead = dates.select(*by, "date", (F.sum("n").over(Window.partitionBy(*by).orderBy("date")) - F.col("n")).alias("ahead"))
    own = F.row_number().over(Window.partitionBy(*by, "date").orderBy("ticker")) - 1
    return samples.withColumn("own", own).join(ahead, [*by, "date"]).withColumn(out, F.col("ahead") + F.col("own")).drop("own", "ahead")


def folds(samples: DataFrame, label_end: str, first: float = 0.6, size: float = 0.1, embargo: int = 5, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """Members (fold, fit, the samples' columns) and the table of folds.

    first and size are shares of all samples: where the first test begins, and how long each is. Folds of fewer than
    10 test or ``least`` training rows are left out.
    """
    rows = placed(samples)
    n = rows.count()
    begin, step = int(n * first), max(1, int(n * size))
    count = max(0, (n - begin) // step)
    tested = rows.withColumn("fold", F.floor((F.col("at") - begin) / step).cast("int")).filter((F.col("at") >= begin) & (F.col("fold") < count))
    starts = tested.groupBy("fold").agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.count("*").alias("n_test"))
    earliest = F.greatest(F.lit(0), F.floor((F.col("at") - begin) / step) + 1).cast("int")
    candidates = rows.withColumn("from", earliest).filter(F.col("from") < count).withColumn("fold", F.explode(F.expr(f"sequence(`from`, {count - 1})"))).drop("from") if count else rows.withColumn("fold", F.lit(0)).limit(0)
    trained = candidates.join(starts.select("fold", "test_start"), "fold").filter((F.col(label_end) < F.col("test_start")) & (F.datediff("test_start", "date") >= embargo)).drop("test_start")
    known = trained.groupBy("fold").agg(F.count("*").alias("n_train"), F.max("date").alias("train_end"), F.max(label_end).alias("last_label_end"))
    before = candidates.groupBy("fold").agg(F.count("*").alias("n_candidates"))
    table = starts.join(known, "fold").join(before, "fold").filter((F.col("n_test") >= 10) & (F.col("n_train") >= least))
    members = trained.withColumn("fit", F.lit(True)).unionByName(tested.withColumn("fit", F.lit(False))).join(table.select("fold"), "fold", "left_semi")
    return members, table


def walk_forward(samples: DataFrame, features: list[str], target: str, label_end: str, bags: int = 5, calibration: float = 0.25, seed: int = 42, first: float = 0.6, size: float = 0.1, **options) -> DataFrame:
    """fold, ticker, date, target, prediction, lower, upper of each test row.

    prediction is the mean of bagged models of the fold's training rows. lower and upper are the quantiles 0.1 and 0.9 of
    models fitted on the older part of them, as far as its labels end before the newest ``calibration`` share begins,
    widened by the 0.8 quantile of how far that newest share lies outside; null where fewer than 200 training rows, or
    100 of the older part, are there. A fold's newest training rows are put in order in one task.
    """
    members, _ = folds(samples, label_end, first, size)
    stage = Stage(samples.sparkSession, "folds")
    members = stage.put(members.select("fold", "fit", "ticker", "date", F.col(label_end).alias("label_end"), F.col(target).alias("target"), *features))
    point = bagged(members.withColumn("model", F.concat(F.lit("p"), "fold")).withColumn("quantile", F.lit(None).cast("double")), ["ticker", "date"], bags, seed=seed)
    # the newest training rows, by place
    train = members.filter("fit")
    sizes = train.groupBy("fold").agg(F.count("*").alias("n_train"))
    newest = F.greatest(F.lit(50), F.floor(F.col("n_train") * calibration))
    ranked = placed(train, "fold").join(sizes.filter("n_train >= 200"), "fold").withColumn("held", F.col("at") >= F.col("n_train") - newest)
    ranked = ranked.join(ranked.filter("held").groupBy("fold").agg(F.min("date").alias("held_from")), "fold")
    proper = ranked.filter(F.col("held") | (F.col("label_end") < F.col("held_from"))).withColumn("fit", ~F.col("held"))
    enough = proper.groupBy("fold").agg(F.count_if("fit").alias("n")).filter("n >= 100").select("fold")
    heads = proper.select(*members.columns, "held").unionByName(members.filter("NOT fit").withColumn("held", F.lit(False))).join(enough, "fold", "left_semi")
    heads = heads.withColumn("quantile", F.explode(F.array(F.lit(0.1), F.lit(0.9)))).withColumn("model", F.concat(F.lit("q"), "fold", F.lit("@"), "quantile"))
    rows, _ = boost(point.withColumn("held", F.lit(False)).unionByName(heads), features, **options)
    stage.drop()
    told = rows.filter("NOT fit").groupBy("fold", "ticker", "date", "held").agg(
        F.first("target").alias("target"), F.avg(F.when(F.col("quantile").isNull(), F.col("prediction"))).alias("prediction"),
        *[F.max(F.when(F.col("quantile") == q, F.col("prediction"))).alias(c) for q, c in ((0.1, "low"), (0.9, "high"))])
    outside = told.filter("held").withColumn("e", F.greatest(F.col("low") - F.col("target"), F.col("target") - F.col("high")))
    order = Window.partitionBy("fold").orderBy("e")
    n = F.count("*").over(Window.partitionBy("fold"))
    rank = F.least(n, F.ceil((n + 1) * F.lit(0.8)))
    offsets = outside.withColumn("rank", rank).withColumn("place", F.row_number().over(order)).filter("place = rank").select("fold", F.col("e").alias("offset"))
    told = told.filter("NOT held").join(offsets, "fold", "left")
    return told.select("fold", "ticker", "date", "target", "prediction", (F.col("low") - F.col("offset")).alias("lower"), (F.col("high") + F.col("offset")).alias("upper"))


def fold_scores(predictions: DataFrame) -> DataFrame:
    """Per fold the correlation with what came true, its ranks' correlation, the share of right signs, and the intervals' coverage and width."""
    average = lambda c: F.rank().over(Window.partitionBy("fold").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("fold", c)) - 1) / 2
    rows = predictions.withColumns({"a": average("prediction"), "b": average("target")})
    covered = F.when(F.col("lower").isNotNull(), F.col("target").between(F.col("lower"), F.col("upper")).cast("double"))
    return rows.groupBy("fold").agg(F.count("*").alias("n"), safe_corr("prediction", "target").alias("ic"), safe_corr("a", "b").alias("rank_ic"),
        F.avg((F.signum("prediction") == F.signum("target")).cast("double")).alias("hit_rate"), F.avg(covered).alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("mean_width"))
