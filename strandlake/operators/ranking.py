"""Ranks, coverage, and the conversion of pair scores to positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pairs import running, stored

#: Scores that one task puts in order, about.
SORTED = 2_000_000


def ranked(scores: DataFrame, order: str, digits: int = 9, by: list[str] | None = None) -> DataFrame:
    """Add rank (dense, from 1) and coverage (share of rows that rank as well or better).

    ``order``: 'min' if the least score is best, 'max' otherwise.  Scores are rounded first, so
    that ties do not hang on the order of additions.  The table has a row for each position (or
    pair of positions) of one alignment.
    """
    if order not in ("min", "max"):
        raise ValueError(f"order must be 'min' or 'max', not {order!r}")
    rounded = scores.withColumn("score", F.round("score", digits))
    keys = by or []
    if "pos_j" not in scores.columns:  # a group has a row for each position: a window of that many rows
        group = Window.partitionBy(*keys)
        best_first = group.orderBy(F.desc("score") if order == "max" else F.asc("score"))
        upto = F.count(F.lit(1)).over(best_first.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return rounded.select("*", F.dense_rank().over(best_first).alias("rank"), (upto / F.count(F.lit(1)).over(group)).alias("coverage"))
    # Ranks of pairs go over the distinct scores, which are counted first, in ranges of scores.
    rounded = stored(rounded)  # used twice below; files of columns are a fraction of a checkpoint
    counts = stored(rounded.groupBy(*keys, "score").agg(F.count("*").alias("_n")))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    summed = running(counts.withColumn("_one", F.lit(1)), "score", keys, {"rank": "_one", "_upto": "_n"}, order == "max")
    whole = summed.join(totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_all"), [summed[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys] or F.lit(True))
    # stored, so that its size is known: where distinct scores are few, no pair is shuffled to be joined
    places = stored(whole.select(*keys, F.col("score").alias("_score"), F.col("rank").cast("int").alias("rank"), (F.col("_upto") / F.col("_all")).alias("coverage")))
    on = [rounded["score"].eqNullSafe(places["_score"]), *[rounded[k].eqNullSafe(places[k]) for k in keys]]
    return rounded.join(places, on).select(rounded["*"], places["rank"], places["coverage"])


def pairs_to_positions(pairs: DataFrame, method: str = "Top") -> DataFrame:
    """pos, value, rank, coverage: the best (Top) or median rank of the pairs that hold a position."""
    ends = pairs.select(F.explode(F.array("pos_i", "pos_j")).alias("pos"), "rank")
    how = {"Top": F.min("rank"), "Median": F.median("rank"), "Mean": F.avg("rank")}
    if method not in how:
        raise ValueError(f"method must be one of {sorted(how)}")
    return ranked(ends.groupBy("pos").agg(how[method].cast("double").alias("score")), "min").withColumnRenamed("score", "value")


def _binned(scores: DataFrame, rows: int, digits: int) -> tuple[DataFrame, Window]:
    """(_bin, score, pairs) of the distinct scores, least first, and the window of a bin: about ``rows`` scores are shuffled
    once, by bins of equal width.

    The width follows a few of the scores: it only deals the work, lower and higher ones go to the outer bins.
    """
    rounded = scores.select(F.round("score", digits).alias("score"))
    lo, hi = rounded.where(~F.isnan("score")).limit(10_000).agg(F.min("score"), F.max("score")).first()
    parts = max(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SORTED))
    last = 16 * parts - 1
    scale = last / (hi - lo) if lo is not None and hi > lo else 0.0
    place = F.greatest(F.lit(0.0), F.least(F.lit(float(last)), F.floor((F.col("score") - (lo or 0.0)) * scale).cast("double")))
    dealt = rounded.withColumn("_bin", F.when(F.isnan("score"), last).otherwise(place).cast("int")).repartition(parts, "_bin")
    return dealt.groupBy("_bin", "score").agg(F.count("*").alias("pairs")), Window.partitionBy("_bin").orderBy("score")


def _carried(held: DataFrame, sums: dict[str, str]) -> DataFrame:
    """``held`` (_bin, ...) with the running sums of the bins before added to columns (name -> what a bin adds to it at most)."""
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    totals = held.groupBy("_bin").agg(*[F.max(c).alias(f"_t_{c}") for c in sums])
    starts = totals.select(F.col("_bin"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    got = held.join(F.broadcast(starts), "_bin")
    return got.withColumns({n: F.col(c) + F.col(f"_o_{c}") for c, n in sums.items()})


def ranks_of(wanted: DataFrame, scores: DataFrame, rows: int, digits: int = 9) -> DataFrame:
    """score, rank: the dense ranks (least first) of the scores ``wanted`` among ``scores``, about ``rows`` of them.

    Scores above all wanted ones are left out, the others are shuffled once, without what they belong to.
    """
    asked = stored(wanted.select(F.round("score", digits).alias("score")).distinct())
    most = asked.agg(F.max("score").alias("_most"))
    upto = scores.crossJoin(F.broadcast(most)).where(F.round("score", digits) <= F.col("_most"))  # one row
    counts, order = _binned(upto, rows, digits)
    at = counts.select("_bin", "score", F.row_number().over(order).alias("_at"), F.lead("score").over(order).isNull().alias("_last"))
    found = at.join(asked.withColumn("_asked", F.lit(True)), "score", "left").where("_asked or _last")
    return _carried(stored(found), {"_at": "rank"}).where("_asked").select("score", F.col("rank").cast("int").alias("rank"))


def scores_to_positions(ends: DataFrame, scores: DataFrame, rows: int, method: str = "Top", digits: int = 9) -> DataFrame:
    """The :func:`pairs_to_positions` of ranks by ``scores``, from the scores (pos, least, low, high) of each position: the best one
    and the two in the middle."""
    if method not in ("Top", "Median"):
        raise ValueError("method must be Top or Median")
    names = ["least"] if method == "Top" else ["low", "high"]
    each = stored(ends.select("pos", F.explode(F.array(*names)).alias("score")).withColumn("score", F.round("score", digits)))
    ranks = stored(ranks_of(each, scores, rows, digits))
    values = each.join(ranks, "score").groupBy("pos").agg(F.avg("rank").alias("score"))
    return ranked(values, "min").withColumnRenamed("score", "value")


def residue_coverage(scores: DataFrame, ends: DataFrame, rows: int, digits: int = 9) -> DataFrame:
    """For each rank of about ``rows`` ``scores`` of pairs: the positions first seen there, and the running number and share of
    positions seen.  ends: (pos, least), the best score of each position."""
    news = stored(ends.groupBy(F.round("least", digits).alias("score")).agg(F.count("*").alias("new_positions")))
    counts, order = _binned(scores, rows, digits)
    every = counts.join(news, "score", "left").fillna(0, ["new_positions"])
    held = stored(every.select("_bin", F.row_number().over(order).alias("_at"), "pairs", "new_positions", F.sum("new_positions").over(order).alias("_seen")))
    total = news.agg(F.sum("new_positions").alias("_total"))  # one row
    got = _carried(held, {"_at": "rank", "_seen": "seen"}).crossJoin(F.broadcast(total))
    return got.select("rank", "pairs", "new_positions", "seen", F.round(F.col("seen") / F.col("_total"), 9).alias("residue_coverage"))
