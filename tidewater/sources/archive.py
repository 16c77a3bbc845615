"""An archive of market snapshots, and the ledger of what was recommended in them and came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import asof_join

#: Days after which an outcome is taken, by horizon.
HORIZONS = {"5d": 7, "20d": 30, "60d": 90}


def save_snapshots(rows: DataFrame, path: str) -> None:
    """Writes snapshots (source, as_of, others), a folder each: one saved again replaces its former rows, others stay.

    Rows are brought together by snapshot before they are written, so that a folder has few files.
    """
    dealt = rows.repartition("source", "as_of")
    dealt.write.partitionBy("source", "as_of").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def newest_snapshots(spark: SparkSession, path: str, count: int, source: str | None = None) -> DataFrame:
    """Rows of the newest snapshots; the others stay on disk. Ties of time by source."""
    rows = spark.read.parquet(path)
    rows = rows if source is None else rows.filter(F.col("source") == source)
    newest = rows.select("source", "as_of").distinct().orderBy(F.desc("as_of"), "source").limit(count)
    return rows.join(newest, ["source", "as_of"], "left_semi")


def ledger(snapshots: DataFrame, top: int = 80, newest: int = 500) -> DataFrame:
    """The newest records of the first ``top`` names of each snapshot, with their outcomes by horizon.

    snapshots: as_of (date), ticker, place (from 1), price, opportunity, others; one row a ticker and date. An outcome is
    taken at the first later snapshot with the ticker that is HORIZONS days on: measured_at, return_pct, opportunity_delta
    and status, which is pending (nothing else told) before one. A price that is null or not positive on either side gives
    a return of 0 and ``priceMissing``. Records are told newest first, then by place.
    """
    kept = snapshots.filter(F.col("place") <= top).orderBy(F.desc("as_of"), "place", "ticker").limit(newest)
    kept = kept.withColumn("id", F.concat_ws(":", "as_of", "ticker"))
    later = snapshots.select("ticker", (-F.unix_date("as_of")).alias("back"), "as_of", "price", "opportunity")
    out = kept
    for name, days in HORIZONS.items():
        # told backwards, the first snapshot so many days on is the latest one up to that day
        due = out.withColumn("_due", -(F.unix_date("as_of") + days))
        out = asof_join(due, later, "ticker", "_due", "back", ["as_of", "price", "opportunity"], strict=False).drop("_due")
        then, good = F.col("asof.price"), (F.col("price") > 0) & (F.col("asof.price") > 0)
        status = F.when(F.col("asof").isNull(), "pending").when(F.coalesce(good, F.lit(False)), "measured").otherwise("priceMissing")
        gained = F.when(F.col("asof").isNotNull(), F.when(F.coalesce(good, F.lit(False)), (then / F.col("price") - 1) * 100).otherwise(0.0))
        out = out.withColumns({f"measured_at_{name}": F.col("asof.as_of"), f"return_pct_{name}": gained, f"opportunity_delta_{name}": F.col("asof.opportunity") - F.col("opportunity"), f"status_{name}": status}).drop("asof")
    return out


def archive_summary(rows: DataFrame) -> DataFrame:
    """Per source: its snapshots, the first and the last of them, and their rows."""
    return rows.groupBy("source").agg(F.count_distinct("as_of").alias("snapshots"), F.min("as_of").alias("first"), F.max("as_of").alias("last"), F.count("*").alias("names"))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds each name's place in its snapshot by opportunity, ties by ticker."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("opportunity"), "ticker")))
