"""As-of and nearest joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, carried: list[str], strict: bool = True) -> DataFrame:
    """Each left row with the latest right row before it (strict) or up to it, as a struct ``asof`` (null if none).

    Both sides are united and sorted by key and time, one shuffle and no range join. The struct keeps a
    right row together: a null in its newest value does not reach back to an older row.
    """
    side = (F.lit(0), F.lit(1)) if strict else (F.lit(1), F.lit(0))
    mine = left.select(F.col(key).alias("k"), F.col(left_time).alias("t"), side[0].alias("side"), F.struct(*left.columns).alias("mine"))
    theirs = right.select(F.col(key).alias("k"), F.col(right_time).alias("t"), side[1].alias("side"), F.struct(F.col(right_time).alias("asof_time"), *carried).alias("theirs"))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    order = Window.partitionBy("k").orderBy("t", "side", F.col("theirs").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("asof", F.last("theirs", ignorenulls=True).over(order)).filter("mine is not null").select("mine.*", "asof")


def nearest(df: DataFrame, keys: list[str], value: str, target, carried: list[str]) -> DataFrame:
    """For each key the row whose value is nearest the target; ties by the carried columns."""
    gap = F.abs(F.col(value) - F.lit(target))
    return df.groupBy(*keys).agg(F.min(F.struct(gap.alias("gap"), *carried)).alias("best")).select(*keys, *[F.col(f"best.{c}") for c in carried], F.col("best.gap").alias("gap"))
