"""Document fingerprints by winnowing, in DataFrame functions only.

Words (long ones in pieces of PIECE code points) form k-grams; of every ``window`` consecutive k-gram
hashes the smallest is chosen, the rightmost one on ties, and its position is kept. Any run of
``k + window - 1`` words that two texts share therefore gives them a common chosen hash.

Defined results: a null text is an empty text; a text without words has no hashes; one of fewer words
than k has one k-gram, the whole sequence; one of fewer k-grams than a window has one window. The
likeness of two empty fingerprints is 1, of an empty and another one 0. Repeated rows each get their
own result, and rows with equal identifiers follow each other in the order of a hash of their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

K, WINDOW, PIECE = 5, 4, 24


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(r"([^\x20\x09-\x0D]{1,%d})" % PIECE), F.lit(1))
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(words: Column, k: int = K) -> Column:
    """The rolling k-gram hashes of an array of word hashes."""
    whole = F.array(F.aggregate(words, F.lit(42).cast("long"), lambda acc, w: F.xxhash64(acc, w)))
    starts = F.sequence(F.lit(1), F.size(words) - (k - 1))
    rolled = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(k)]))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < k, whole).otherwise(rolled)


def winnowed_positions(hashes: Column, window: int = WINDOW) -> Column:
    """Positions, counted from 0, of each window's smallest hash; the rightmost one of equal hashes."""
    span = F.least(F.size(hashes), F.lit(window))
    starts = F.when(F.size(hashes) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(hashes) - span + 1))

    def chosen(i: Column) -> Column:
        backwards = F.reverse(F.slice(hashes, i, span))
        return (i + span - 1 - F.array_position(backwards, F.array_min(backwards))).cast("int")

    return F.array_distinct(F.transform(starts, chosen))


def fingerprinted(df: DataFrame, text: str, prefix: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """df with the columns <prefix>hashes and <prefix>positions of the named text column."""
    return (
        df.withColumn(f"{prefix}hashes", word_hashes(F.col(text)))
        .withColumn(f"{prefix}hashes", gram_hashes(F.col(f"{prefix}hashes"), k))
        .withColumn(f"{prefix}positions", winnowed_positions(F.col(f"{prefix}hashes"), window))
        .withColumn(f"{prefix}hashes", F.transform(F.col(f"{prefix}positions"), lambda p: F.element_at(F.col(f"{prefix}hashes"), p + 1)))
    )


def likeness(one: Column, other: Column) -> Column:
    """Jaccard likeness of two fingerprints' hash sets."""
    both, either = F.size(F.array_intersect(one, other)), F.size(F.array_union(one, other))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def digest(hashes: Column, positions: Column) -> Column:
    """A short text that equals another one only if hashes and positions are equal."""
    return F.sha2(F.concat_ws(";", F.array_join(F.transform(hashes, lambda h: F.hex(h)), ","), F.array_join(positions.cast("array<string>"), ",")), 256)


def with_next(df: DataFrame, order: str, tie: Column, carried: list[str], buckets: int) -> DataFrame:
    """df with, as next_<column>, the carried columns of the row that follows in descending order.

    After the last row comes the first. Rows go to range buckets whose bounds are identifiers that
    occur, so a bucket's first row is known beforehand and is also sent to the bucket before it: one
    shuffle, no task that holds all rows. Null identifiers come last.
    """
    spark = df.sparkSession
    parts = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.max(order).alias("top"), F.percentile_approx(order, parts or [0.5], 10_000).alias("cuts")).first()
    cuts = sorted({*(found["cuts"] or []), found["top"]} - {None})
    if not cuts:
        cuts = [0]
    # bounds ascend, buckets are numbered from the smallest identifiers; a bucket ends at its bound
    bounds = F.array(*[F.lit(int(c)).cast("long") for c in cuts])
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    below = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.get(bounds, at + s - 1) < F.col(order)), at + s).otherwise(at))
    bucket = F.when(F.col(order).isNull(), F.lit(0)).otherwise(below)
    last = len(cuts) - 1
    ends_bucket = F.coalesce(F.get(bounds, F.col("own_bucket")) == F.col(order), F.col(order).isNull() & F.lit(found["top"] is None))
    goes_on = F.when(F.col("own_bucket") == last, F.lit(-1)).otherwise(F.col("own_bucket") + 1)
    sent = df.withColumn("own_bucket", bucket).withColumn("tie_hash", tie)
    sent = sent.withColumn("copy", F.explode(F.when(ends_bucket, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    # a copy stands behind all rows of the bucket it is sent to; the one of the very first row behind the last
    sent = sent.withColumn("to_bucket", F.when(F.col("copy") == 0, F.col("own_bucket")).when(goes_on == -1, F.lit(0)).otherwise(goes_on))
    row = Window.partitionBy("to_bucket").orderBy(F.col("copy").asc(), F.col(order).desc_nulls_last(), F.col("tie_hash").asc())
    return sent.withColumns({f"next_{c}": F.lead(c).over(row) for c in carried}).filter("copy = 0").drop("own_bucket", "tie_hash", "copy", "to_bucket")


def winnowing(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes array<bigint>, positions array<int> (of k-grams, in words) of every row."""
    return fingerprinted(docs.select("doc_id", "text"), "text", "", k, window).select("doc_id", "hashes", "positions")


def fingerprint_edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the start of the next document."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    buckets = max(2, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = fingerprinted(base, "text", "own_", k, window).withColumn("fingerprint", digest(F.col("own_hashes"), F.col("own_positions"))).drop("own_positions")
    paired = with_next(own, "doc_id", F.xxhash64("text"), ["text", "own_hashes"], buckets)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = paired.withColumn("edited", F.concat(F.left("text", n - third), F.left(F.col("next_text"), third)))
    edited = fingerprinted(edited, "edited", "edited_", k, window)
    return edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        digest(F.col("edited_hashes"), F.col("edited_positions")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_own_hashes")).alias("near_next"),
        F.size("own_hashes").cast("long").alias("n_hashes"),
    )
