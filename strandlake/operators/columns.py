"""Alignments as tidy tables: encoding, subsets, gaps, consensus, usable columns.

A residue table has (seq_idx, pos, code), one row for each cell of an alignment, and may carry
a column ``node``; a packed table has (seq_idx, codes array<int>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.alphabets import encoded


def encode(sequences: DataFrame, codes: dict[str, int], seq_col: str = "seq") -> DataFrame:
    """Add ``codes``: the sequence as array<int>; unknown characters raise an error."""
    return sequences.withColumn("codes", encoded(F.col(seq_col), codes))


def residues(packed: DataFrame, *keep: str) -> DataFrame:
    """Long form of a packed table."""
    return packed.select("seq_idx", *keep, F.posexplode("codes").alias("pos", "code"))


def pack(long: DataFrame) -> DataFrame:
    """Packed form of a residue table, positions in order."""
    cells = F.array_sort(F.collect_list(F.struct("pos", "code")))
    return long.groupBy("seq_idx").agg(F.transform(cells, lambda c: c["code"]).alias("codes"))


def sub_alignment(sequences: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; their order column is untouched."""
    return sequences.join(ids.select(key).distinct(), key, "left_semi")


def subset_columns(long: DataFrame, positions: DataFrame) -> DataFrame:
    """Cells at the listed positions, re-numbered from 0."""
    wanted = positions.select("pos").distinct()
    numbered = wanted.select("pos", (F.dense_rank().over(Window.orderBy("pos")) - 1).alias("new_pos"))  # one row per column
    return long.join(F.broadcast(numbered), "pos").drop("pos").withColumnRenamed("new_pos", "pos")


def without_query_gaps(long: DataFrame, query: Column, gap: int) -> DataFrame:
    """Cells of the columns in which the query row has no gap, re-numbered; all cells if it has nothing else."""
    kept = long.where(query & (F.col("code") != gap))
    if kept.isEmpty():
        return long
    return subset_columns(long, kept)


def good_sequences(sequences: DataFrame, letters: str, seq_col: str = "seq") -> DataFrame:
    """Rows made of the given characters and gaps only."""
    return sequences.where(F.col(seq_col).rlike("^[" + "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in letters + "-") + "]*$"))


def gap_share(long: DataFrame, gap: int) -> DataFrame:
    """pos, gap_fraction, evidence (rows without a gap)."""
    is_gap = (F.col("code") == gap).cast("int")
    return long.groupBy("pos").agg(F.avg(is_gap).alias("gap_fraction"), F.sum(1 - is_gap).alias("evidence"))


def usable_positions(long: DataFrame, gap: int, ratio: float) -> DataFrame:
    return gap_share(long, gap).where(F.col("gap_fraction") <= ratio)


def column_pairs(packed: DataFrame, *keep: str) -> DataFrame:
    """(keep..., pos_i, pos_j, a, b) for all i < j of each row; a narrow step, no join."""
    last = F.size("codes") - 1
    cells = F.flatten(
        F.transform(
            F.sequence(F.lit(0), last - 1),
            lambda i: F.transform(
                F.sequence(i + 1, last),
                lambda j: F.struct(i.alias("pos_i"), j.alias("pos_j"), F.get("codes", i).alias("a"), F.get("codes", j).alias("b")),
            ),
        )
    )
    return packed.where(last >= 1).select(*keep, F.explode(cells).alias("c")).select(*keep, "c.pos_i", "c.pos_j", "c.a", "c.b")


def comparable_rows(packed: DataFrame, gap: int) -> DataFrame:
    """Number of rows without a gap in both columns, for all column pairs."""
    both = ((F.col("a") != gap) & (F.col("b") != gap)).cast("int")
    return column_pairs(packed).groupBy("pos_i", "pos_j").agg(F.sum(both).alias("n"))


def pair_gap_share(packed: DataFrame, gap: int) -> DataFrame:
    """pos_i, pos_j, gap_fraction: share of rows with a gap in both columns, which is the gap of a pair."""
    both = ((F.col("a") == gap) & (F.col("b") == gap)).cast("int")
    return column_pairs(packed).groupBy("pos_i", "pos_j").agg(F.avg(both).alias("gap_fraction"))


def consensus(long: DataFrame) -> DataFrame:
    """Most frequent code of each column, the lowest on a tie."""
    counted = long.groupBy("pos", "code").agg(F.count("*").alias("cnt"))
    best = F.max_by(F.struct("code", "cnt"), F.struct("cnt", (-F.col("code")).alias("low")))
    return counted.groupBy("pos").agg(best.alias("b")).select("pos", "b.code", "b.cnt")


def gap_z_scores(long: DataFrame, gap: int, cutoff: float) -> DataFrame:
    """seq_idx, gaps, z_score (population deviation), keep; without deviation every row is kept."""
    gaps = long.groupBy("seq_idx").agg(F.count_if(F.col("code") == gap).alias("gaps"))
    moments = gaps.agg(F.avg("gaps").alias("m"), F.stddev_pop("gaps").alias("s"))
    z = F.try_divide(F.col("gaps") - F.col("m"), F.col("s"))
    return gaps.crossJoin(F.broadcast(moments)).select("seq_idx", "gaps", z.alias("z_score"), F.coalesce(z < cutoff, F.lit(True)).alias("keep"))  # one row


def gap_disagreement(long: DataFrame, gap: int, cutoff: float) -> DataFrame:
    """seq_idx, share of columns whose gap state differs from the consensus, keep."""
    agreed = consensus(long).select("pos", (F.col("code") == gap).alias("gap_there"))
    differs = ((F.col("code") == gap) != F.col("gap_there")).cast("int")
    joined = long.join(F.broadcast(agreed), "pos")  # one row per column
    return joined.groupBy("seq_idx").agg(F.avg(differs).alias("share")).withColumn("keep", F.col("share") < cutoff)


def gap_evaluation(long: DataFrame, gap: int, size_cutoff: int = 15, z_cutoff: float = 20, share_cutoff: float = 0.15) -> DataFrame:
    """seq_idx, keep: by z-score for more than ``size_cutoff`` rows, else by disagreement with the consensus."""
    many = long.select("seq_idx").distinct().count() > size_cutoff
    return (gap_z_scores(long, gap, z_cutoff) if many else gap_disagreement(long, gap, share_cutoff)).select("seq_idx", "keep")


def variability(long: DataFrame, letter: Column) -> DataFrame:
    """pos, the distinct letters in order as a comma list, and their number."""
    seen = F.array_sort(F.collect_set(letter))
    return long.groupBy("pos").agg(F.array_join(seen, ",").alias("characters"), F.size(seen).alias("variability"))


def identity_bin(share: Column, interval: int, lowest: int, highest: int) -> Column:
    """Percent floored to its interval; below the lowest and above the highest bin it is clamped, outside 0..100 null."""
    percent = F.floor(share * 100)
    floored = percent - F.pmod(percent, F.lit(interval))
    return F.when(share.between(0, 1), F.greatest(F.lit(lowest), F.least(F.lit(highest), floored))).cast("int")
