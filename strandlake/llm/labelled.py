"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, written

#: Labelled rows that a classifier is fitted on, at most.
SAMPLE_ROWS = 20_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, where: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(label, text) of at most ``rows`` labelled documents, written to the scratch folder.

    The labelled ids of smallest hash are taken, so the sample does not depend on the
    order of rows.  Null ids and labels are left out; an id that is labelled twice has
    its largest label, and rows that repeat an id all count.  ``where`` may filter on ``_id``.
    """
    named = labels.select(col(id_col).alias("_id"), col(label).cast("int").alias("label")).dropna()
    if where is not None:
        named = named.where(where)
    named = named.groupBy("_id").agg(F.max("label").alias("label"))
    picked = named.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(col(id_col).alias("_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(picked), "_id").select("_id", "label", "text"))  # broadcast: ``rows`` rows at most
