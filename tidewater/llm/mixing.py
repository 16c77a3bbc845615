"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

A source's target is whole passes over it plus a remainder. Which documents fill the remainder follows
from a 30-bit hash of the identifier: sizes are summed by source and the top LEVEL_BITS bits, the
bucket in which the remainder ends is found, and only the rows of that bucket are summed again by the
next bits. What comes out is one threshold a source; the documents below it are taken once more, so
that a larger budget takes all that a smaller one takes. Nothing is sorted but sums.

Defined results: a null text has size 0; a null source is a source of its own, the last one; sizes that
are all 0 give targets of 0; repeated rows count as rows, and all rows of an identifier go together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
LEVELS, LEVEL_BITS = 3, 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """skey, source_size, target of every source. sizes: skey, source_size, one row a source.

    The sources in the order of size a weight: as long as the next one would be above ``most`` times its
    size, it stops there and the rest is shared by weight among those behind it.
    """
    by_name = Window.partitionBy(F.lit(1)).orderBy("skey")
    each = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(each, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("most") / F.col("weight"))
    whole = Window.partitionBy(F.lit(1))
    by_ratio = whole.orderBy("ratio", "skey")
    behind = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(whole) * F.lit(share)
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(behind)
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("ratio") <= F.col("level"))
    common = F.min(F.when(~F.col("full"), F.struct("ratio", "skey", "level"))).over(whole)["level"]
    return ranked.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * common)).select("skey", "source_size", "target")


def taken_share(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """skey, passes, threshold: rows with a hash below the threshold are taken passes + 1 times, others passes times."""
    plan = targets.withColumn("passes", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)))
    plan = plan.withColumn("left", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    at = plan.select("skey", "source_size", "target", "passes", "left", F.lit(0).cast("long").alias("prefix"))
    mask = (1 << LEVEL_BITS) - 1
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = rows.join(at.select("skey", "prefix"), "skey")
        if level:
            inside = inside.filter(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("skey", F.shiftright("h", shift).bitwiseAND(mask).alias("bucket")).agg(F.sum("size").alias("size"))
        order = Window.partitionBy("skey").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("size").over(order)).join(at.select("skey", "left"), "skey")
        # the first bucket that goes beyond what is left, and what the buckets before it have taken
        ends = sums.filter(F.col("upto") > F.col("left")).groupBy("skey").agg(F.min(F.struct("bucket", "upto", "size")).alias("end"))
        moved = at.join(ends, "skey", "left")
        found = F.col("end").isNotNull()
        step = F.when(found, F.col("end.bucket")).otherwise(F.lit(mask + 1))
        rest = F.when(found, F.col("left") - (F.col("end.upto") - F.col("end.size"))).otherwise(F.col("left"))
        nearer = (F.col("end.upto") - F.col("left")) < (F.col("left") - (F.col("end.upto") - F.col("end.size")))
        if level == LEVELS - 1:
            step = F.when(found & nearer, F.col("end.bucket") + 1).otherwise(step)
        # where no bucket goes beyond, all rows of the prefix are taken: the next levels find nothing more
        at = moved.select("skey", "source_size", "target", "passes", rest.alias("left"), (F.shiftleft("prefix", LEVEL_BITS) + step).alias("prefix"))
        at = stored(at, "mix-level")
    return at.select("skey", "source_size", "target", "passes", F.col("prefix").alias("threshold"))


def mixed(docs: DataFrame, carried: list[str] = (), weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes taken as ``times``, and a struct ``row`` of the carried columns."""
    skey = F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("k")), F.coalesce(F.col("source"), F.lit("")))
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << (LEVELS * LEVEL_BITS)))
    row = F.struct(*[F.col(c) for c in carried]) if carried else F.struct(F.lit(1).alias("none"))
    sized = docs.select("doc_id", skey.alias("skey"), n_words(F.col("text")).alias("size"), h.alias("h"), row.alias("row"))
    if not carried:
        sized = stored(sized.drop("row"), "mix-sizes")
        slim = sized
    else:
        slim = stored(sized.drop("row", "doc_id"), "mix-sizes")
    targets = stored(source_targets(slim.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    plan = taken_share(slim.select("skey", "size", "h"), targets)
    times = (F.col("passes") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)).cast("int")
    return sized.join(plan, "skey").withColumn("times", times).withColumn("taken", F.col("size") * F.col("times"))


def mix_report(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of the mix with their own columns; a row that is taken twice is there twice."""
    rows = mixed(docs, docs.columns)
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.when(F.col("times") > 0, F.col("times")).otherwise(F.lit(1))))).filter("times > 0").select("row.*")
