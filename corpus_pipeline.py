"""A corpus from raw documents to token ids: five stages, each one an operator of tidewater.llm.

run() applies them one after the other; each stage's rows are stored and read again as the next one's
documents. A stage is called when the rows of the one before it are written, so it first deletes the tables
that the operator of that stage stored on the way to them. All stages but the last return the columns of
documents. A document that the mix takes twice is there twice from then on.
"""

from __future__ import annotations

import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import byte_bpe, exact_dedup, language_id, mixing, simhash
from tidewater.llm.common import forget, release, shared_dir, stored_paths

#: Tables of the stage before, which its successor deletes; each run() has its own, stages called alone share one a session.
_left: ContextVar[list[str] | None] = ContextVar("left", default=None)
_alone: dict[str, list[str]] = {}


def _applied(spark: SparkSession, operator, docs: DataFrame) -> DataFrame:
    left = _left.get()
    if left is None:
        left = _alone.setdefault(spark.sparkContext.applicationId, [])
    while left:
        forget(spark, left.pop())
    release(spark)
    with stored_paths() as paths:
        out = operator(docs)
    left.extend(paths)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language that has at least half of the score."""
    return _applied(spark, language_id.with_language, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _applied(spark, exact_dedup.exact_dedup, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies."""
    return _applied(spark, simhash.near_dedup, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return _applied(spark, mixing.mix, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids."""
    return _applied(spark, byte_bpe.encode_documents, docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: Language ID, SimHash components and BPE cannot be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What it reads lies in the shared folder until the session ends; all before is deleted, also on a failure."""
    own: list[str] = []
    token = _left.set(own)
    before = None
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES[:-1]:
            rows = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark)}/tidewater-pipeline/{name}-{uuid.uuid4().hex}"
            rows.write.parquet(path)
            if before:
                forget(spark, before)
            docs, before = spark.read.schema(rows.schema).parquet(path), path
        return STAGES[-1][1](spark, docs, sf_dir)
    except BaseException:
        for path in [*own, before]:
            if path:
                forget(spark, path)
        raise
    finally:
        _left.reset(token)
