"""Exact deduplication over streaming state, in DataFrame functions only.

The rows are stored with a digest of their normalised text (A-Z lower-cased, null as empty). A stream
takes the stored files in BATCHES micro-batches, however many they are, and keeps keyed state on disk
(RocksDB, without expiry): for each digest the largest identifier, where its content lies (file and row)
and how many rows there are. On hits, digests met more than once, the full bytes are compared: a filter
of fixed size lets the rows of hit digests pass and few others, equal texts meet in each task before the
shuffle, and texts that differ in spite of an equal digest become groups of their own.

Defined results: rows with equal identifiers are separate rows of a group, of which one stays (the
first by place); a null identifier is smaller than any other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ascii_lower, hash_filter, marked_by, new_path, stored

#: State on disk; a state partition reserves no disk ahead and uploads what has changed.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Micro-batches that the stored rows are dealt to.
BATCHES = 4
#: Digests with more than one row in so many are hot; there are fewer of them than this number.
HOT_SHARE = 1_000
FIRST = "struct<id:bigint,place:struct<file:string,at:bigint>>"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _place() -> Column:
    """Where a stored row lies."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def _state(rows: DataFrame, key: list[str]) -> DataFrame:
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("place"))
    return rows.groupBy(*key).agg(F.max(place).alias("first"), F.count(F.lit(1)).alias("group_size"))


def update_state(spark: SparkSession, source: str, schema: StructType, target: str, batches: int = BATCHES) -> None:
    """Send the files under ``source`` that no run before has seen through the stream; what changes goes to ``target``.

    Progress and state lie beside the target, so a run that was cut short, or one after more files came, goes on.
    """
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        files = len(spark.read.schema(schema).parquet(source).inputFiles())
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(source)
        rows = rows.select("doc_id", "digest", _place().alias("place"))
        query = (
            _state(rows, ["digest"])
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{target}-progress")
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch={n}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def state_of(spark: SparkSession, target: str) -> DataFrame:
    """digest, first (identifier and place of the row that stays), group_size: the newest state of each digest."""
    probe = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not probe.getFileSystem(spark._jsc.hadoopConfiguration()).exists(probe):  # no rows, no batch
        return spark.createDataFrame([], f"digest string, first {FIRST}, group_size bigint")
    updates = spark.read.schema(f"digest string, first {FIRST}, group_size bigint, batch bigint").parquet(target)
    return updates.groupBy("digest").agg(F.max_by("first", "batch").alias("first"), F.max_by("group_size", "batch").alias("group_size"))


def _clashes(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The hit digests that stand for more than one text. rows: digest, norm."""
    # the filter lets through all hits and few others
    hit = marked_by(rows, "digest", hash_filter(state.filter("group_size > 1"), "digest")).filter("may")
    seen = hit.groupBy("digest").agg(F.collect_set("norm").alias("texts"))
    return seen.filter(F.size("texts") > 1).select("digest", F.lit(True).alias("clash"))


def _by_digest(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows with their digest's state; the few hot digests are broadcast, so their rows stay where they are."""
    total = state.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") * HOT_SHARE > total
    often = state.filter(hot).select(F.col("digest"), F.col("first").alias("hot_first"), F.col("group_size").alias("hot_size"))
    marked = rows.join(F.broadcast(often), "digest", "left")
    known = marked.filter("hot_size is not null").withColumnsRenamed({"hot_first": "first", "hot_size": "group_size"})
    others = marked.filter("hot_size is null").drop("hot_first", "hot_size").join(state.filter(~hot), "digest")
    return known.unionByName(others)


def _stored_groups(docs: DataFrame, carried: list[str], digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored rows (doc_id, digest, place, row, norm), the state of their digests, and the clashes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    source = new_path(spark, "exact-rows")
    row = F.struct(*[F.col(c) for c in carried]) if carried else F.struct(F.lit(1).alias("none"))
    own = "text" in carried  # the text is then stored once
    staged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(ascii_lower(text)).alias("digest"), row.alias("row"), *([] if own else [text.alias("text")]))
    staged.write.parquet(source)
    target = new_path(spark, "exact-updates")
    update_state(spark, source, staged.schema, target)
    state = stored(state_of(spark, target), "exact-state")
    rows = spark.read.schema(staged.schema).parquet(source).withColumn("place", _place())
    rows = rows.withColumn("norm", ascii_lower(F.coalesce(F.col("row.text" if own else "text"), F.lit(""))))
    return rows, state, stored(_clashes(rows.select("digest", "norm"), state), "exact-clashes")


def exact_groups(docs: DataFrame, carried: list[str] = (), digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row with its group: doc_id, digest, keep_id, group_size, kept, and a struct ``row`` of the carried columns."""
    rows, state, clash = _stored_groups(docs, carried, digest)
    cols = ["doc_id", "digest", "place", *(["row"] if carried else [])]
    if clash.isEmpty():
        joined = _by_digest(rows.select(*cols), state)
    else:
        marked = rows.select(*cols, "norm").join(clash, "digest", "left")
        other = marked.filter("clash").drop("clash")
        same = _by_digest(marked.filter("clash is null").drop("norm", "clash"), state)
        joined = same.unionByName(other.join(_state(other, ["digest", "norm"]), ["digest", "norm"]).drop("norm"))
    kept_id = F.when(F.col("first.id") == -(1 << 63), F.lit(None)).otherwise(F.col("first.id"))
    return joined.select("doc_id", "digest", kept_id.alias("keep_id"), "group_size", (F.col("place") == F.col("first.place")).alias("kept"), *(["row"] if carried else []))


def exact_dedup_report(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too."""
    groups = exact_groups(docs)
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns; rows meet by place, so no group is in one task."""
    rows, state, clash = _stored_groups(docs, docs.columns, sha256)
    first = state.join(clash, "digest", "left_anti").select("first.place")
    if not clash.isEmpty():
        first = first.unionByName(_state(rows.join(clash, "digest"), ["digest", "norm"]).select("first.place"))
    return rows.select("place", "row").join(first, "place").select("row.*")
