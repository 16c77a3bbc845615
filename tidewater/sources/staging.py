"""Tables that cut a job's lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """From spark.checkpoint.dir or setCheckpointDir; a local session without one gets a temporary folder, any other is refused."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


class Stage:
    """One table that is written anew again and again: put() returns the rows as stored and deletes those before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def put(self, rows: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/tidewater/{self.name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.drop()
        self.path = path
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self) -> None:
        if self.path:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.path = None
