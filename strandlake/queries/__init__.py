"""All queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, files, predictions, relations  # noqa: F401  (they register their queries)
from .inputs import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "entry"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: entropy, rank and coverage of every column of an alignment."""
    return QUERIES["plain_entropy_single"](spark, sf_dir)
