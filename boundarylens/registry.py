"""All queries of the core library and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boundarylens.plans import cache_queries, finding_queries, schema_queries  # noqa: F401 - they register their queries
from boundarylens.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_exposed_paths"](spark, sf_dir)
