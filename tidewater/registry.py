"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import decisions, evidence, features, fundamentals, inputs, learning, market, overlays, portfolio, volatility

QUERIES = market.QUERIES | decisions.QUERIES | features.QUERIES | portfolio.QUERIES | fundamentals.QUERIES | learning.QUERIES | inputs.QUERIES | overlays.QUERIES | volatility.QUERIES | evidence.QUERIES
ORACLE_SQL = market.ORACLE_SQL | decisions.ORACLE_SQL | features.ORACLE_SQL | portfolio.ORACLE_SQL | fundamentals.ORACLE_SQL | learning.ORACLE_SQL | inputs.ORACLE_SQL | overlays.ORACLE_SQL | volatility.ORACLE_SQL | evidence.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.momentum_ic(spark, sf_dir)
