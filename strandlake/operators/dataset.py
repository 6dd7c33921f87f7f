"""Building data sets of sequences: hit filters, best hits, grouping, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import identity_bin


def length_fraction(subject: Column, query: Column) -> Column:
    """The shorter length over the longer one."""
    return F.least(F.try_divide(subject, query), F.try_divide(query, subject))


def passing_hits(hits: DataFrame, max_expect: float, min_fraction: float, min_identity: float, max_identity: float, banned: str | None = None) -> DataFrame:
    """HSPs whose e-value, length fraction and identity lie in the window; definitions that match ``banned`` go."""
    rows = hits.withColumn("fraction", length_fraction(F.col("align_length"), F.col("query_length"))).withColumn("identity", F.try_divide("identities", "align_length"))
    rows = rows.where((F.col("expect") <= max_expect) & (F.col("fraction") >= min_fraction) & F.col("identity").between(min_identity, max_identity))
    return rows if banned is None else rows.where(~F.col("definition").rlike(banned))


def alphabet_only(hits: DataFrame, letters: str, seq: str = "sbjct") -> DataFrame:
    """Hits whose aligned sequence has only the given letters and gaps."""
    return hits.where(~F.translate(F.col(seq), letters + "-", "").rlike("."))


def within_lineage(hits: DataFrame, taxa: str, wanted: str) -> DataFrame:
    """Hits whose array of taxa holds the wanted one."""
    return hits.where(F.coalesce(F.array_contains(taxa, wanted), F.lit(False)))


def best_per_hit(hits: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each hit in the given order."""
    return hits.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_p = 1").drop("_p")


def same_sequences(sequences: DataFrame) -> DataFrame:
    """seq, first id, ids in order, n: ids grouped by equal sequence."""
    ids = F.array_sort(F.collect_list("seq_id"))
    return sequences.groupBy("seq").agg(ids.alias("ids")).select("seq", F.col("ids")[0].alias("first_id"), "ids", F.size("ids").alias("n"))


def usable_headers(records: DataFrame, header: str = "header") -> DataFrame:
    """Records whose header names neither a fragment nor a low-quality entry; works on streams too."""
    return records.where(~F.col(header).rlike(r"\(Fragment\)|LOW QUALITY"))


def identity_histogram(rows: DataFrame, share: str, interval: int, lowest: int, highest: int, times: str | None = None) -> DataFrame:
    """bin, n of percent identities; a row counts as often as its column ``times`` says."""
    n = F.count("*") if times is None else F.sum(times)
    return rows.withColumn("bin", identity_bin(F.col(share), interval, lowest, highest)).groupBy("bin").agg(n.alias("n"))


def identity_summary(rows: DataFrame, share: str, fraction: str, low: float, high: float, times: str | None = None) -> DataFrame:
    """One row: least and largest fraction, and how many identities are low, passing and high; see :func:`identity_histogram`."""
    x, once = F.round(share, 9), F.lit(1) if times is None else F.col(times)
    count = lambda where: F.coalesce(F.sum(F.when(where, once)), F.lit(0)).cast("long")
    return rows.agg(
        F.min(fraction).alias("min_fraction"), F.max(fraction).alias("max_fraction"),
        count(x < low).alias("low"), count((x >= low) & (x <= high)).alias("passing"), count(x > high).alias("high"),
    )


def checked_thresholds(records: DataFrame, min_fraction: float, min_identity: float, max_identity: float) -> DataFrame:
    """Filtered records again; a record outside the thresholds raises an error."""
    ok = (F.col("fraction") >= min_fraction) & F.col("identity").between(min_identity, max_identity)
    return records.withColumn("identity", F.when(ok, F.col("identity")).otherwise(F.raise_error(F.lit("a record breaks its thresholds")).cast("double")))


def data_set_summary(ids: DataFrame, hits: DataFrame, filtered: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row for each id: sequence_length, hits, filtered, aligned: counts of its sequence, which several ids may share.

    ids: (id, seq); hits, filtered, aligned: (seq, ...), a row for each hit of a sequence.
    """
    def counts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("seq").agg(F.count("*").alias(name))

    out = ids.select("id", "seq", F.length("seq").alias("sequence_length"))
    for rows, name in ((hits, "hits"), (filtered, "filtered"), (aligned, "aligned")):
        out = out.join(counts(rows, name), "seq", "left")
    return out.fillna(0, ["hits", "filtered", "aligned"])
