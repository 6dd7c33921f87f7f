"""The trace: scores of every node of a tree, combined over ranks.

For metrics with real values, the sum over ranks of (sum of group scores) / rank is a sum over
nodes: each node's score times the harmonic weight of the ranks at which it lives.  So 2n - 1
nodes are scored instead of n(n+1)/2 groups.  Integer metrics count ranks with any non-zero group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import metrics
from . import frequency, rollup, tree
from .ranking import ranked


def node_scores(packed: DataFrame, long: DataFrame, metric: str, pos_size: int) -> DataFrame:
    """node, positions, score for any metric of the registry."""
    metrics.check(metric, pos_size)
    if pos_size == 1:
        return frequency.single_scores(long, metric)
    if metric in metrics.TRANSITION:
        return frequency.transition_scores(packed).select("node", "pos_i", "pos_j", metrics.TRANSITION[metric]().alias("score"))
    return frequency.pair_scores(packed, long, metric)


def rolled_scores(packed: DataFrame, tree: DataFrame, metric: str, pos_size: int) -> DataFrame:
    """The same for all nodes of a tree whose leaves are the rows of ``packed``; counts are rolled up, rows not copied."""
    metrics.check(metric, pos_size)
    keys = ["node", "pos"] if pos_size == 1 else ["node", "pos_i", "pos_j"]
    if metric in metrics.TRANSITION and pos_size == 2:
        return rollup.pair_transition_scores(packed, tree).select(*keys, metrics.TRANSITION[metric]().alias("score"))
    sums = rollup.single_entropies(packed, tree) if pos_size == 1 else rollup.pair_entropies(packed, tree)
    if metric == "identity":
        return sums.select(*keys, (F.col("kinds") > 1).cast("double").alias("score"))
    entropies = sums.select(*keys, "score")
    return entropies if metric == "plain_entropy" else frequency.from_entropies(entropies, rollup.single_entropies(packed, tree), metric)


def combine(scores: DataFrame, lives: DataFrame, metric: str) -> DataFrame:
    """positions, score over the ranks at which the nodes live; plus 1 where less is better.

    ``lives``: (node, lo, hi, weight) as of a tree, or (rank, node).  The identity metric counts the ranks that some
    node with a score covers: the union of their runs, in order of where they start.
    """
    if "rank" in lives.columns:
        lives = lives.select("node", F.col("rank").alias("lo"), F.col("rank").alias("hi"), (1 / F.col("rank")).alias("weight"))
    keys = [c for c in scores.columns if c not in ("node", "score")]
    if metric == "identity":
        runs = scores.where("score <> 0").join(lives, "node").select(*keys, "lo", "hi").distinct()
        before = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
        seen = F.coalesce(F.max("hi").over(before), F.lit(0))
        new = F.greatest(F.lit(0), F.col("hi") - F.greatest(seen, F.col("lo") - 1))
        hits = runs.select(*keys, new.alias("new")).groupBy(*keys).agg(F.sum("new").cast("double").alias("score"))
        out = scores.select(*keys).distinct().join(hits, keys, "left").fillna(0.0, ["score"])
    else:
        out = scores.join(lives.select("node", "weight"), "node").groupBy(*keys).agg(F.sum(F.col("score") * F.col("weight")).alias("score"))
    return out.withColumn("score", F.col("score") + 1) if metrics.direction(metric) == "min" else out


def gap_corrected(scores: DataFrame, gap_fractions: DataFrame, cutoff: float, metric: str) -> DataFrame:
    """Positions with more gaps than the cutoff get the worst score.

    The worst is the maximum where less is better, else the least score that is not zero.
    """
    keys = [c for c in scores.columns if c != "score"]
    worst = F.max("score") if metrics.direction(metric) == "min" else F.min(F.when(F.col("score") != 0, F.col("score")))
    joined = scores.join(gap_fractions, keys, "left").crossJoin(F.broadcast(scores.agg(worst.alias("worst"))))  # one row
    return joined.select(*keys, F.when(F.coalesce("gap_fraction", F.lit(0.0)) > cutoff, F.col("worst")).otherwise(F.col("score")).alias("score"))


def finished(scores: DataFrame, metric: str, gap_fractions: DataFrame | None = None, gap_correction: float | None = None) -> DataFrame:
    """positions, score, rank, coverage, with the worst score where there are too many gaps."""
    if gap_correction is not None and gap_fractions is not None:
        scores = gap_corrected(scores, gap_fractions, gap_correction, metric)
    return ranked(scores, metrics.direction(metric))


def trace(packed: DataFrame, long: DataFrame, assigned: DataFrame, metric: str, pos_size: int, gap_fractions: DataFrame | None = None, gap_correction: float | None = None) -> DataFrame:
    """positions, score, rank, coverage, over groups that are given: ``packed`` and ``long`` carry the node of each row."""
    return finished(combine(node_scores(packed, long, metric, pos_size), assigned, metric), metric, gap_fractions, gap_correction)


def tree_trace(packed: DataFrame, nodes: DataFrame, metric: str, pos_size: int, ranks: list[int] | None = None, gap_fractions: DataFrame | None = None, gap_correction: float | None = None) -> DataFrame:
    """positions, score, rank, coverage, over the nodes of a tree whose leaves are the rows of ``packed`` (seq_idx, codes)."""
    scores = combine(rolled_scores(packed, nodes, metric, pos_size), tree.lives(nodes, ranks), metric)
    return finished(scores, metric, gap_fractions, gap_correction)
