"""Labels that come late, as a stream: predictions wait in state for the bar that realizes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def realized_labels(predictions: DataFrame, bars: DataFrame, steps: int = 20, give_up: int = 370, late: str = "0 days") -> DataFrame:
    """ticker, time, predicted, realized (percent), realized_at, status: each prediction once, when its bar is there or is given up.

    predictions: ticker, bar (its number in the ticker's series), time (timestamp), close, predicted. bars: ticker, bar, time,
    close. A prediction is realized by the bar ``steps`` on if that is no later than ``give_up`` days; behind those it comes as
    expired, without a value, once the stream's time has passed them. Both sides are state keyed by ticker and bar, which
    the watermark clears, so a restart goes on where it stopped. A close that is not positive never realizes. Rows later
    than ``late`` behind the newest time are dropped by the watermark. Rows of predictions that predict nothing are no
    predictions but move the time on: the stream's time is that of the slower side, so without them it would stand still
    when predictions end. Rows without a time are left out.
    """
    timed = predictions.filter("time is not null")
    told = timed.select("ticker", (F.col("bar") + steps).alias("due"), "time", F.when(F.col("close") > 0, F.col("close")).alias("close"), "predicted").withWatermark("time", late)
    # names the time too, so that it is not moved below the watermark
    told = told.filter("predicted is not null or time is null")
    ends = bars.filter("close is not null").select(F.col("ticker").alias("t"), F.col("bar").alias("end_bar"), F.col("time").alias("end_time"), F.col("close").alias("end")).withWatermark("end_time", late)
    within = (F.col("end_time") >= F.col("time")) & (F.col("end_time") <= F.col("time") + F.expr(f"INTERVAL {give_up} DAYS"))
    both = told.join(ends, (F.col("ticker") == F.col("t")) & (F.col("due") == F.col("end_bar")) & F.col("close").isNotNull() & within, "left_outer")
    realized = (F.col("end") - F.col("close")) / F.col("close") * 100
    return both.select("ticker", "time", "predicted", realized.alias("realized"), F.col("end_time").alias("realized_at"), F.when(realized.isNull(), "expired").otherwise("realized").alias("status"))
