"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All stages but the last return the
columns of ``documents``; the last returns packed pieces.

In every stage: a null text counts as empty (and stays null in what is kept); empty and very long texts are
whole texts like any other; repeated rows count each, and go or stay as the stage says; an empty table gives an
empty result; other columns come along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import fold, table, written
from strandlake.llm.exact_dedup import exact_dedup
from strandlake.llm.packing import pack_documents
from strandlake.llm.quality import quality_filter
from strandlake.llm.simhash import near_dedup
from strandlake.llm.suffix_dedup import suffix_dedup

TOKENIZER = "byte_bpe_50k.json"
#: Bytes of a repeated string that is cut out: about 50 words' worth, also of short words.
REPEAT_BYTES = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects (score below 0.3; of equal scores all go or stay)."""
    return quality_filter(docs, table(spark, sf_dir, "labels"), threshold=0.3, where=fold("_id") != 0)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the row with the largest doc_id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are similar, keep the smallest doc_id: five-word shingles, a similarity of 0.8 or more.

    Candidates come from 256-bit signatures and are compared on their sets of shingles.  Rows without an id stay.
    """
    return near_dedup(docs, words=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of REPEAT_BYTES that occur twice anywhere out of the texts; n_chars follows the text."""
    cut = suffix_dedup(docs, length=REPEAT_BYTES)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise what is left and pack it into sequences of 1024 ids; an empty text is a piece of its end alone."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("suffix_dedup", repeats),
    ("packing", pack),
]

#: The stages cannot be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
