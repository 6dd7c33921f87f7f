"""Pairs of rows in tiles, lineage cuts, and running sums over any number of rows."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

#: Rows of one side of a tile, about.
TILE = 512


def _checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return root


def shared_folder(spark: SparkSession) -> str:
    """A new path below the shared folder that spark.checkpoint.dir names."""
    return f"{_checkpoint_root(spark).rstrip('/')}/strandlake-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder that spark.checkpoint.dir names; its lineage ends here.

    Where the setting is missing, a local session uses a temporary folder; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_checkpoint_root(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written below the shared folder and read back, for loops: unlike :func:`cut`, its size is that of its
    files, where the estimate for a chain of joins would double its digits in each round."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(df: DataFrame) -> DataFrame:
    """``df``, after Python workers have been told where this package is (workers that share the driver's files)."""
    root, env = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return df


def tiled(rows: DataFrame, key: str, by: list[str], size: int = TILE, ordered: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """(left, right, columns to join by) so that each unordered pair of rows of a ``by`` group meets in one tile.

    Rows are dealt into parts by a hash of ``key``, as many as their own group needs; the pairs of two parts are a tile,
    hence no task gets a whole group, and a small group beside a large one is not copied.  Rows of one part meet both
    ways round: :func:`once` says which way counts.  Tiles are dealt to as many tasks as spark.sql.shuffle.partitions says:
    what they hold is small beside what is made of it, so partitions must not be put together by their size.

    With ``ordered``, parts are runs of rows in the order of ``key`` (different from row to row of a group), not dealt by a hash.
    """
    spread = numbered(rows, "_place", *by, key) if ordered else rows
    sizes = spread.groupBy(*by).agg(F.count("*").alias("_n"), *([F.min("_place").alias("_least")] if ordered else []))
    held = spread.join(sizes, by) if by else spread.crossJoin(F.broadcast(sizes))  # one row
    parts = F.ceil(F.col("_n") / size).cast("int")
    run = F.floor((F.col("_place") - F.col("_least")) / size) if ordered else F.pmod(F.xxhash64(key), parts)
    dealt = held.withColumn("_part", run.cast("int"))
    left = dealt.select(*rows.columns, F.col("_part").alias("_p"), F.explode(F.sequence("_part", parts - 1)).alias("_q"))
    right = dealt.select(*rows.columns, F.explode(F.sequence(F.lit(0), "_part")).alias("_p"), F.col("_part").alias("_q"))
    on, parts = [*by, "_p", "_q"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(parts, *on), right.repartition(parts, *on), on


def once(left_key: str, right_key: str) -> Column:
    """Of the rows that meet in a tile, each unordered pair with different keys once."""
    return ((F.col("_p") < F.col("_q")) & (F.col(left_key) != F.col(right_key))) | (F.col(left_key) < F.col(right_key)) & (F.col("_p") == F.col("_q"))


def in_tiles(rows: DataFrame, key: str, by: list[str], kernel, schema: T.StructType, size: int = TILE, ordered: bool = False) -> DataFrame:
    """What ``kernel`` makes of the two blocks of each tile: (join columns, Arrow table, Arrow table) -> Arrow table.

    The tiles are those of :func:`tiled`; a task holds one tile at a time, and no pair of rows is shuffled.
    """
    left, right, on = tiled(rows.dropna(subset=[key]), key, by, size, ordered)

    def run(at, a, b):
        return kernel(at, a, b.rename_columns(a.column_names)) if a.num_rows and b.num_rows else empty

    empty = to_arrow_schema(schema).empty_table()
    right = right.toDF(*[f"_r{c}" for c in right.columns])  # names of its own, since both come from one table
    return importable(left).groupBy(*on).cogroup(right.groupBy(*[f"_r{c}" for c in on])).applyInArrow(run, schema)


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Add the place (int, from 1) of each row in the order of the columns ``order``, which together differ from row to row.

    Rows are sorted in ranges; a range goes on from the number of rows in the ranges before it, so no task sees all.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = cut(dealt.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = held.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = (F.col("_start") + F.col("_at") + 1).cast("int").alias(name)
    return held.join(F.broadcast(starts), "_range").select(*rows.columns, place)


def _bounds_below(bounds: list):
    """How many of the sorted numbers are less than a value: looked up, not compared one by one."""
    sorted_bounds = np.array(bounds, float)

    @F.pandas_udf(T.IntegerType())
    def below(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sorted_bounds, x.to_numpy(), "left"))

    return below


def running(rows: DataFrame, order: str, by: list[str], sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Add running sums (new name -> column) in the order of ``order``, whose values differ within each ``by`` group.

    Numbers are cut into ranges at quantiles; a window sees one range, and each range continues from the
    sums of the ranges before it.
    """
    spark = rows.sparkSession
    start = [F.desc(order) if descending else F.asc(order)]
    bounds: list = []
    if isinstance(rows.schema[order].dataType, T.NumericType):
        parts = min(256, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        bounds = sorted(set(rows.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 1000)).first()[0] or []))
    if not bounds:
        window = Window.partitionBy(*by).orderBy(*start)
        return rows.select("*", *[F.sum(c).over(window).alias(n) for n, c in sums.items()])
    parted = rows.withColumn("_range", F.when(F.col(order).isNull(), 0).otherwise(_bounds_below(bounds)(F.col(order).cast("double"))))
    inside = Window.partitionBy(*by, "_range").orderBy(*start)
    before = Window.partitionBy(*by).orderBy(F.desc("_range") if descending else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])  # a row for each range
    offsets = totals.select(*[F.col(c).alias(f"_b_{c}") for c in [*by, "_range"]], *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    held = parted.select("*", *[F.sum(c).over(inside).alias(f"_s_{n}") for n, c in sums.items()])
    on = [held[c].eqNullSafe(offsets[f"_b_{c}"]) for c in [*by, "_range"]]
    return held.join(offsets, on).select(*rows.columns, *[(F.col(f"_s_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])
