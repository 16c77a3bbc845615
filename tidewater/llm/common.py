"""What the training-data operators share: word classes, stored tables and their folder."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Where the session has none, the folder that setCheckpointDir named is taken; a local session (tests) gets a
    temporary one, and any other is refused, because its executors would not see the driver's folders.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


#: Who is told of stored tables; each thread of work has its own.
_watchers: ContextVar[tuple[list[str], ...]] = ContextVar("watchers", default=())


@contextlib.contextmanager
def stored_paths() -> Iterator[list[str]]:
    """The paths of tables that operators store meanwhile, for a caller that deletes them in the end."""
    paths: list[str] = []
    token = _watchers.set((*_watchers.get(), paths))
    try:
        yield paths
    finally:
        _watchers.reset(token)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
    for paths in _watchers.get():
        paths.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: the lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; a null stays null."""
    only_ascii = F.octet_length(text) == F.length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the identifier's decimal text modulo folds; a null identifier counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


#: A filter of hashes has 2 ** FILTER_BITS numbers of 64 bits at most, 4 MB.
FILTER_BITS = 18


def _slot() -> Column:
    return F.expr(f"shiftrightunsigned(h, {64 - FILTER_BITS})")


def hash_filter(keys: DataFrame, name: str) -> DataFrame:
    """at, bits: which hashes the named column has, in a table of bounded size."""
    hashed = keys.select(F.xxhash64(name).alias("h")).withColumn("at", _slot())
    return hashed.groupBy("at").agg(F.expr("bit_or(shiftleft(1L, CAST(h & 63 AS INT)))").alias("bits"))


def marked_by(rows: DataFrame, name: str, filter_: DataFrame) -> DataFrame:
    """rows with ``may``: false only if the filter has not the named column's value. The filter is broadcast; its size is bounded."""
    hashed = rows.withColumn("h", F.xxhash64(name)).withColumn("at", _slot()).join(F.broadcast(filter_), "at", "left")
    return hashed.withColumn("may", F.expr("coalesce(shiftrightunsigned(bits, CAST(h & 63 AS INT)) & 1, 0) = 1")).drop("h", "at", "bits")
