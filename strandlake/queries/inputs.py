"""How the driver's tables become alignments, hierarchies, structures and hits; in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    """Six decimals; very large values (x/0 counts as tan(pi/2)) are left as they are."""
    return F.when(F.abs(x) < 1e9, F.round(x, 6)).otherwise(x)


def sql6(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e9 THEN round({x}, 6) ELSE {x} END"


# -- alignment of the embeddings: 64 columns, 20 codes, one group per label ----------------------

GAP = 10


def _code(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(19), F.floor((x.cast("double") + 0.5) * 20))).cast("int")


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_idx, label, codes."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq_idx"), "label", F.transform("embedding", _code).alias("codes"))


def long(packed: DataFrame, *keep: str) -> DataFrame:
    return packed.select("seq_idx", *keep, F.posexplode("codes").alias("pos", "code"))


RESIDUE = """
residue AS (
    SELECT vec_id AS seq_idx, label, CAST(p - 1 AS INTEGER) AS pos,
           CAST(greatest(0, least(19, floor((CAST(x AS DOUBLE) + 0.5) * 20))) AS INTEGER) AS code
    FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)
)"""

#: Nodes: the whole alignment, and one group per label.
NODES = (
    RESIDUE
    + """,
member AS (
    SELECT 'root' AS node, seq_idx, pos, code FROM residue
    UNION ALL SELECT 'group' || label, seq_idx, pos, code FROM residue
)"""
)


def one_node(packed: DataFrame) -> DataFrame:
    return packed.withColumn("node", F.lit("root"))


def two_ranks(packed: DataFrame, group: str) -> DataFrame:
    """Each row in the root and in its group."""
    nodes = F.explode(F.array(F.lit("root"), F.concat(F.lit("group"), F.col(group).cast("string"))))
    return packed.withColumn("node", nodes)


def two_rank_assignment(members: DataFrame) -> DataFrame:
    """rank 1: the root; rank 2: the groups (and rank-2 weight 1/2 for each)."""
    return members.select("node").distinct().select(F.when(F.col("node") == "root", 1).otherwise(2).alias("rank"), "node")


# -- alignment of the supplier names: 18 columns, one group per nation ------------------------------

NAME_LETTERS = "Suplier#0123456789"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_idx, nation, codes."""
    codes = F.transform(F.filter(F.split("s_name", ""), lambda c: c != ""), lambda c: (F.instr(F.lit(NAME_LETTERS), c) - 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq_idx"), F.col("s_nationkey").alias("nation"), codes.alias("codes"))


NAMES = f"""
names AS (
    SELECT s_suppkey AS seq_idx, s_nationkey AS nation, CAST(p - 1 AS INTEGER) AS pos,
           CAST(instr('{NAME_LETTERS}', s_name[p]) - 1 AS INTEGER) AS code
    FROM (SELECT s_suppkey, s_nationkey, s_name, unnest(generate_series(1, length(s_name))) AS p FROM supplier)
)"""
