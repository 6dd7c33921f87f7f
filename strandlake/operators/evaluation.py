"""Rankings against truth: ROC, precision and recall, top-k, hypergeometric overlap."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: The sets of separation categories that are evaluated together.
CATEGORY_SETS = {
    "Any": ["Neighbors", "Short", "Medium", "Long"],
    "Neighbors": ["Neighbors"], "Short": ["Short"], "Medium": ["Medium"], "Long": ["Long"],
    "Neighbors+Short": ["Neighbors", "Short"],
    "Neighbors+Short+Medium": ["Neighbors", "Short", "Medium"],
    "Short+Medium+Long": ["Short", "Medium", "Long"],
    "Medium+Long": ["Medium", "Long"],
}


def in_category_sets(pairs: DataFrame) -> DataFrame:
    """Each row once for every category set that holds its category; the sets overlap."""
    sets = F.array(*[F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, v)).alias("members")) for k, v in CATEGORY_SETS.items()])
    hits = F.filter(sets, lambda s: F.array_contains(s["members"], F.col("category")))
    return pairs.withColumn("category_set", F.explode(F.transform(hits, lambda s: s["name"])))


def thresholds(rows: DataFrame, by: list[str], score: str = "score", truth: str = "truth", times: str | None = None) -> DataFrame:
    """by..., score, tp, fp (running, best score first), p, n: ties are one threshold.

    Counts per distinct score come first, so windows see thresholds, not rows.  ``times``: a column that says for how many
    equal rows a row stands.
    """
    t, each = F.col(truth).cast("int"), F.col(times) if times else F.lit(1)
    at = rows.groupBy(*by, score).agg(F.sum(t * each).cast("long").alias("pos"), F.sum((1 - t) * each).cast("long").alias("neg"))
    run = Window.partitionBy(*by).orderBy(F.desc(score))
    whole = Window.partitionBy(*by)
    return at.select(
        *by, score, "pos", "neg",
        F.sum("pos").over(run).alias("tp"), F.sum("neg").over(run).alias("fp"),
        F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"),
    )


def auroc(rows: DataFrame, by: list[str], score: str = "score", truth: str = "truth", times: str | None = None) -> DataFrame:
    """by..., auroc: area under the ROC by trapezoids; null without both kinds."""
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    got = thresholds(rows, by, score, truth, times).groupBy(*by).agg(F.sum(area).alias("a"), F.max("p").alias("p"), F.max("n").alias("n"))
    return got.select(*by, F.try_divide(F.col("a"), (F.col("p") * F.col("n")).cast("double")).alias("auroc"))


def auprc(rows: DataFrame, by: list[str], score: str = "score", truth: str = "truth", times: str | None = None) -> DataFrame:
    """by..., auprc: trapezoids over recall, from the point (0, 1) on."""
    tp, fp, p = F.col("tp"), F.col("fp"), F.col("p")
    # the threshold before is what is left without the rows of this one
    tp0, n0 = tp - F.col("pos"), tp + fp - F.col("pos") - F.col("neg")
    before = F.when(n0 == 0, F.lit(1.0)).otherwise(F.try_divide(tp0, n0))
    part = (F.try_divide(tp, p) - F.try_divide(tp0, p)) * (tp / (tp + fp) + before) / 2
    return thresholds(rows, by, score, truth, times).select(*by, part.alias("a")).groupBy(*by).agg(F.sum("a").alias("auprc"))


def top_scores(rows: DataFrame, size: int, order: Column, truth: str = "truth", descending: bool = True) -> DataFrame:
    """One row: n, tp, precision, recall, f1 of the rows with the first ``size`` distinct values; undefined is 0."""
    t = F.col(truth).cast("int")
    # by distinct value first: the window sees a row for each of the first places only
    at = rows.groupBy(order.alias("_v")).agg(F.count("*").alias("n"), F.sum(t).alias("tp"))
    first = at.orderBy(F.desc("_v") if descending else F.asc("_v")).limit(size)
    got = first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("tp").alias("tp")).crossJoin(F.broadcast(rows.agg(F.sum(t).alias("p"))))  # one row each
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(F.try_divide("tp", "n")), zero(F.try_divide("tp", "p"))
    return got.select("n", "tp", precision.alias("precision"), recall.alias("recall"), zero(F.try_divide(2 * precision * recall, precision + recall)).alias("f1"))


def log_factorial(n: Column) -> Column:
    """ln n!: a list for small n, beyond it Stirling's series, whose error is below the last bit there."""
    few = [math.lgamma(k + 1) for k in range(33)]
    x = n.cast("double")
    series = x * F.ln(x) - x + F.ln(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n < len(few), F.get(F.array(*map(F.lit, few)), n.cast("int"))).otherwise(series)


def hypergeometric_sf(counts: DataFrame) -> DataFrame:
    """Add p_value = P(X >= overlap) for X hypergeometric in (population, keys, drawn, overlap).

    The terms overlap..min(keys, drawn) are summed inside each row, so nothing is joined or shuffled, and populations may
    have any size.
    """
    total, keys, drawn, overlap = (F.col(c).cast("long") for c in ("population", "keys", "drawn", "overlap"))
    least, most = F.greatest(overlap, keys + drawn - total, F.lit(0)), F.least(keys, drawn)
    whole = log_factorial(keys) + log_factorial(total - keys) + log_factorial(drawn) + log_factorial(total - drawn) - log_factorial(total)

    def term(x: Column) -> Column:
        return F.exp(whole - log_factorial(x) - log_factorial(keys - x) - log_factorial(drawn - x) - log_factorial(total - keys - drawn + x))

    tail = F.aggregate(F.sequence(least, most), F.lit(0.0), lambda s, x: s + term(x))
    return counts.withColumn("p_value", F.when(least > most, 0.0).otherwise(F.least(F.lit(1.0), tail)))


#: Pairs up to which the distribution of the signed-rank statistic is counted exactly.
EXACT_PAIRS = 50


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Probability of a standard normal value as far from 0 as z or farther."""
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def rank_sum_tail(doubled: Column, upto: Column) -> Column:
    """P(sum of a random subset <= upto) for the whole numbers ``doubled`` (array), by counting subset sums.

    An array holds the probability of each sum; each number moves half of it up by itself.
    """
    total = F.aggregate(doubled, F.lit(0), lambda s, r: s + r)
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), total))

    def step(p: Column, r: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0.0), r), F.slice(p, F.lit(1), F.size(p) - r))
        return F.zip_with(p, moved, lambda x, y: (x + y) / 2)

    return F.aggregate(F.slice(F.aggregate(doubled, start, step), F.lit(1), upto + 1), F.lit(0.0), lambda s, x: s + x)


def signed_rank(pairs: DataFrame, by: list[str], exact_pairs: int = EXACT_PAIRS) -> DataFrame:
    """by..., n, w_plus, w_minus, statistic, z, p_exact, p_value of the two-sided Wilcoxon signed-rank test of (a, b) pairs.

    Zero differences are left out; tied differences share their mean rank.  z is the normal approximation with the tie
    correction (null where it has no deviation).  p_exact counts all 2^n ways to give signs to the ranks, ties
    included, for up to ``exact_pairs`` differences (else null); p_value is p_exact, or else that of z.
    """
    diff = pairs.select(*by, F.round(F.col("a") - F.col("b"), 9).alias("d")).where("d <> 0")
    size = diff.groupBy(*by, F.abs("d").alias("_m")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    order = Window.partitionBy(*by).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("t").over(order), F.lit(0))
    ranks = size.withColumn("_before", before).withColumn("rank", F.col("_before") + (F.col("t") + 1) / 2)
    # the ranks themselves, doubled so that they are whole, of groups that are counted exactly
    few = F.when(F.col("_before") + F.col("t") <= exact_pairs, F.array_repeat((2 * F.col("rank")).cast("int"), F.col("t").cast("int")))
    got = ranks.groupBy(*by).agg(
        F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("w_minus"),
        F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("ties"), F.flatten(F.collect_list(few)).alias("_ranks"),
    )
    n = F.col("n").cast("double")
    deviation = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    statistic = F.least("w_plus", "w_minus")
    out = got.select(*by, "n", "w_plus", "w_minus", statistic.alias("statistic"), F.try_divide(statistic - n * (n + 1) / 4, deviation).alias("z"), "_ranks")
    tail = rank_sum_tail(F.col("_ranks"), (2 * F.col("statistic")).cast("int"))
    out = out.withColumn("p_exact", F.when(F.col("n") <= exact_pairs, F.least(F.lit(1.0), 2 * tail))).drop("_ranks")
    return out.withColumn("p_value", F.coalesce("p_exact", normal_two_sided("z")))


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
