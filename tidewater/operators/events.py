"""Change logs, transitions and their studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp

# Words of bad news.
NEGATIVE_WORDS = ("probe", "lawsuit", "miss", "warning", "downgrade", "cuts", "cut", "layoff", "fraud", "investigation", "recall", "guidance", "shortfall", "slump", "falls", "drops")


def transitions(log: DataFrame, key: str, time: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before, with that one; the first row of a key is none."""
    w = Window.partitionBy(key).orderBy(*time)
    return log.withColumn("from_state", F.lag(state).over(w)).filter(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state)))


def change_log(log: DataFrame, key: str, time: list[str], state: str, newest: int = 60) -> DataFrame:
    """Only first rows and changes, of which the newest ones of each key stay."""
    w = Window.partitionBy(key).orderBy(*time)
    changed = log.withColumn("before", F.lag(state).over(w)).filter(F.col("before").isNull() | (F.col("before") != F.col(state))).drop("before")
    back = Window.partitionBy(key).orderBy(*[F.col(t).desc() for t in time])
    return changed.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= newest).drop("back")


def pair_matrix(moves: DataFrame, state: str, value: str) -> DataFrame:
    return moves.groupBy("from_state", F.col(state).alias("to_state")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))


def newest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("back", F.row_number().over(w)).filter("back = 1").drop("back")


def outcome_study(rows: DataFrame, kind: str, outcome: str, day: str) -> DataFrame:
    """Per kind of event how often it occurs, on how many days, and what follows; rows without an outcome are left out."""
    hits = F.avg(F.when(F.col(outcome) > 0, 1.0).otherwise(0.0))
    return rows.filter(F.col(outcome).isNotNull()).groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(day).alias("n_days"), F.avg(outcome).alias("mean"), F.median(outcome).alias("median"), hits.alias("hit_rate"))


def reconciled(log: DataFrame, bars: DataFrame, today, steps: int = 20, wait: int = 30, give_up: int = 370) -> DataFrame:
    """log (ticker, date, others) with realized (percent), realized_at and status on the day ``today``.

    A prediction that is ``wait`` days old is realized if there is a bar of its own date and one ``steps`` bars later; it is
    pending before that and as long as one is missing, and left out when it is pending after ``give_up`` days. Predictions
    that came realized stay as they are. bars: ticker, date, close; one row a ticker and date, and later bars than today do
    not count.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    seen = bars.filter(F.col("date") <= F.lit(today).cast("date")).select("ticker", "date", "close", F.lead("close", steps).over(w).alias("end"), F.lead("date", steps).over(w).alias("end_date"))
    rows = log if "realized" in log.columns else log.withColumns({"realized": F.lit(None).cast("double"), "realized_at": F.lit(None).cast("date")})
    rows = rows.join(seen, ["ticker", "date"], "left").withColumn("age", F.datediff(F.lit(today).cast("date"), "date"))
    due = F.col("realized").isNull() & F.col("age").between(wait, give_up) & (F.col("close") > 0) & F.col("end").isNotNull()
    rows = rows.withColumn("realized_at", F.when(due, F.col("end_date")).otherwise(F.col("realized_at"))).withColumn("realized", F.when(due, (F.col("end") - F.col("close")) / F.col("close") * 100).otherwise(F.col("realized")))
    rows = rows.filter(F.col("realized").isNotNull() | (F.col("age") <= give_up)).drop("close", "end", "end_date", "age")
    return rows.withColumn("status", F.when(F.col("realized").isNotNull(), "realized").otherwise("pending"))


def negative_words(text: str) -> Column:
    """How many of the words of bad news occur in the text, inside longer words too; 0 in a null text."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array(*map(F.lit, NEGATIVE_WORDS)), lambda w: F.contains(lower, w)))


def event_risk(articles: DataFrame, symbol: str, title: str, tone: str, seen_at: str) -> DataFrame:
    """Per symbol: its articles, those with bad news, mean tone (0 without any), the latest, pressure and event-risk scores."""
    out = articles.groupBy(symbol).agg(F.count(F.lit(1)).alias("articles"), F.count_if(negative_words(title) > 0).alias("negative_articles"), F.coalesce(F.avg(tone), F.lit(0.0)).alias("tone"), F.max(seen_at).alias("latest"))
    out = out.withColumn("pressure_score", clamp(34 + F.col("articles") * 2.2 + F.col("negative_articles") * 8, 0, 100))
    return out.withColumn("event_risk_score", (F.col("pressure_score") + clamp(50 - F.col("tone") * 5 + F.col("negative_articles") * 6, 0, 100)) / 2)
