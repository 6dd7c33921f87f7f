"""Exact dedup [native]: skew-safe combining of equal texts.

Three stages, each of which compares whole texts, not only digests:

1. every map task collapses its own copies (partial aggregation by the text itself); the
   salt is the task's number, so that one row is left of a text in a task;
2. the survivors meet by (digest, salt, text), so that one text that fills a third
   of the table is merged by ``salts`` reducers;
3. the salt winners, at most ``salts`` per text, are combined by (digest, text).

Winners are joined back to the rows in two parts: the texts that more than 1 in ``HOT`` rows hold, of which there are
fewer than ``HOT``, are broadcast; all other texts are few rows each and meet by digest.

Defined results: a null text counts as empty; a null id is smaller than any id;
rows that repeat both id and text are copies of each other; an empty table
gives an empty result.  Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, whole_text

SALTS = 16
#: A text that more than one in so many rows hold is hot; hence there are fewer hot texts than this.
HOT = 4096


def _salt(salts: int):
    """The number of the task that reads a row: no result depends on it."""
    return F.pmod(F.spark_partition_id(), F.lit(salts)).cast("int").alias("_salt")


def _winners(df: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """One row per distinct text: digest, largest id, number of rows."""
    text = whole_text(text_col)
    rows = df.select(
        col(id_col).alias("_id"),
        text.alias("_text"),
        F.unhex(F.sha2(text, 256)).alias("_sha"),
        _salt(salts),
    )
    salted = rows.groupBy("_sha", "_salt", "_text").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
    whole = salted.groupBy("_sha", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    # Below, rows are told apart by digest alone.  That is exact, as the texts of a
    # digest have met above; should one digest ever hold two texts, the job stops.
    one = whole.groupBy("_sha").agg(
        F.max("_keep").alias("_keep"), F.max("_n").alias("_n"), F.count("*").alias("_texts")
    )
    return one.withColumn(
        "_n",
        F.when(F.col("_texts") == 1, F.col("_n")).otherwise(F.raise_error(F.lit("two texts share one SHA-256 digest"))),
    ).drop("_texts")


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``kept`` marks the row with the group's largest id.  Only texts that occur
    twice or more are joined back.
    """
    copies = _winners(df, id_col, text_col, salts).where("_n > 1")
    most = max(2, df.count() // HOT)
    hot = copies.where(F.col("_n") > most).select("_sha", F.col("_keep").alias("_hot_keep"), F.col("_n").alias("_hot_n"))
    rows = df.select(col(id_col).alias("_id"), F.sha2(whole_text(text_col), 256).alias("_hex"))
    rows = rows.withColumn("_sha", F.unhex("_hex")).join(F.broadcast(hot), "_sha", "left")  # fewer than HOT rows
    # what has its winner already is dealt by a number of eight bytes, which is no digest
    done = F.unhex(F.lpad(F.hex(F.xxhash64("_id", F.monotonically_increasing_id())), 16, "0"))
    rows = rows.withColumn("_sha", F.when(F.col("_hot_n").isNull(), F.col("_sha")).otherwise(done))
    joined = rows.join(copies.where(F.col("_n") <= most), "_sha", "left")
    size = F.coalesce(F.col("_hot_n"), F.col("_n"), F.lit(1).cast("long"))
    keep = F.when(F.col("_hot_n").isNotNull(), F.col("_hot_keep")).when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        size.alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_hex").alias("text_sha256"),
    )


def _orderable(kind: T.DataType) -> bool:
    return isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType)


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS
) -> DataFrame:
    """The rows that stay: of equal texts the one with the largest id, all columns kept.

    Exactly one row stays per distinct text, also among rows that repeat the id.
    The rows travel with their texts through the same salted stages, so nothing is
    joined back.
    """
    text = whole_text(text_col)
    plain = [c for c in df.columns if c not in (id_col, text_col) and _orderable(df.schema[c].dataType)]
    others = [c for c in df.columns if c != text_col]
    rows = df.select(
        text.alias("_text"),
        col(text_col).isNull().alias("_null"),
        F.unhex(F.sha2(text, 256)).alias("_sha"),
        _salt(salts),
        F.struct(col(id_col), *[col(c) for c in plain]).alias("_order"),
        F.struct(*[col(c) for c in others]).alias("_row"),
    )
    best = [
        F.max_by(F.struct("_row", "_null"), "_order").alias("_best"),
        F.max("_order").alias("_order"),
    ]
    salted = rows.groupBy("_sha", "_salt", "_text").agg(*best)
    best[0] = F.max_by("_best", "_order").alias("_best")
    whole = salted.groupBy("_sha", "_text").agg(*best)
    kept_text = F.when(~F.col("_best._null"), F.col("_text")).alias(text_col)
    return whole.select(
        *[kept_text if c == text_col else F.col("_best._row").getField(c).alias(c) for c in df.columns]
    )
