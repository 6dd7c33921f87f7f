"""The plan that makes a data set of alignments from hits: filter, best hits, redundancy, check, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabets import encoded
from ..operators import dataset, distance
from ..operators.pairs import cut


@dataclass(frozen=True)
class Thresholds:
    """What a hit has to meet; rows of one alignment with a larger identity than ``max_redundancy`` are redundant."""

    max_expect: float = 0.05
    min_fraction: float = 0.7
    min_identity: float = 0.4
    max_identity: float = 1.0
    max_redundancy: float = 0.95
    banned: str | None = r"\(Fragment\)|LOW QUALITY"


@dataclass(frozen=True)
class DataSet:
    """hits that pass, the best of each (with seq_idx), what is left without redundancy, and a summary for each id."""

    filtered: DataFrame
    best: DataFrame
    kept: DataFrame
    summary: DataFrame


def build(ids: DataFrame, hits: DataFrame, codes: dict[str, int], letters: str, thresholds: Thresholds = Thresholds()) -> DataSet:
    """Data sets of all sequences at once.

    ids: (id, seq), where ids may share a sequence; hits: (seq, hit_id, hit_no, definition, expect, identities, align_length,
    sbjct), one row for each matching part of a hit, its aligned row in ``sbjct``, all as wide as the others of its seq.

    A hit passes by expect value, length fraction, identity, definition and letters; of its parts the one with the
    highest identity counts, then the lowest expect value, then the first row.  In order of ``hit_no``, a row that is too near to an earlier one of
    the same sequence goes.  A kept row outside the thresholds stops the job.
    """
    t = thresholds
    rows = hits.withColumn("query_length", F.length("seq"))
    filtered = dataset.passing_hits(rows, t.max_expect, t.min_fraction, t.min_identity, t.max_identity, t.banned)
    filtered = cut(dataset.alphabet_only(filtered, letters))
    best = dataset.best_per_hit(filtered, ["seq", "hit_id"], [F.desc("identity"), F.asc("expect"), F.asc("hit_no"), F.asc("sbjct")])
    best = cut(best.withColumnRenamed("hit_no", "seq_idx"))
    packed = best.select("seq", "seq_idx", encoded(F.col("sbjct"), codes).alias("codes"))
    distinct = distance.distinct_rows(packed, "seq")
    near = distance.near_rows(distinct, t.max_redundancy, "seq")
    stay = distance.redundancy_filter(near, distinct, t.max_redundancy, by=("seq",))
    kept = dataset.checked_thresholds(best.join(stay, ["seq", "seq_idx"]), t.min_fraction, t.min_identity, t.max_identity)
    return DataSet(filtered, best, kept, dataset.data_set_summary(ids, hits, best, kept))
