"""Structured Streaming forms of the record filter and of the mergeable counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dataset import usable_headers


def stream_parquet(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def filtered_records(records: DataFrame) -> DataFrame:
    """Records with usable headers, one by one: no state."""
    return usable_headers(records)


def running_counts(cells: DataFrame) -> DataFrame:
    """pos, code, cnt of a stream of residues; counts only grow, so update or complete mode both serve."""
    return cells.groupBy("pos", "code").agg(F.count("*").alias("cnt"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows; state older than the watermark is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
