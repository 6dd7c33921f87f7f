"""Predictions attached to a structure, the choice of the rows to judge, and whole evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import evaluation, ranking, structure
from .pairs import cut, importable, stored


def single_frame(positions: DataFrame, mapped: DataFrame) -> DataFrame:
    """(query, pos, aa, resno): every position of a query, with its place in the structure or null."""
    return positions.join(mapped.select("query", "pos", "resno"), ["query", "pos"], "left")


def residue_of(mapped: DataFrame, residues: DataFrame, positions: DataFrame) -> DataFrame:
    """(query, pos, resno, aa): the structure's residue for each of the positions, nulls where there is none."""
    return positions.join(mapped, ["query", "pos"], "left").join(residues.select("query", "resno", "aa"), ["query", "resno"], "left").select("query", "pos", "resno", "aa")


def position_of(mapped: DataFrame, sequence: DataFrame, residues: DataFrame) -> DataFrame:
    """(query, resno, pos, aa): the position in the sequence for each of the residues, nulls where there is none."""
    return residues.join(mapped, ["query", "resno"], "left").join(sequence.select("query", "pos", "aa"), ["query", "pos"], "left").select("query", "resno", "pos", "aa")


def with_predictions(frame: DataFrame, predictions: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Add rank, score and coverage by ``keys``, and true_prediction: a coverage of ``threshold`` at most."""
    found = predictions.select(*keys, "rank", "score", "coverage")
    return frame.join(found, keys, "left").withColumn("true_prediction", F.coalesce(F.col("coverage") <= threshold, F.lit(False)))


def scored(frame: DataFrame, order: str = "min", threshold: float = 0.5, digits: int = 9) -> DataFrame:
    """The same for predictions that are a column ``score`` of the frame itself: ranked where they are, without a join by
    keys.  Coverages are rounded to ``digits``."""
    got = ranking.ranked(frame, order).withColumn("coverage", F.round("coverage", digits))
    return got.withColumn("true_prediction", F.coalesce(F.col("coverage") <= threshold, F.lit(False)))


def _ends(frame: DataFrame) -> list[str]:
    return ["pos_i", "pos_j"] if "pos_i" in frame.columns else ["pos"]


def _placed(frame: DataFrame, by: list[str]) -> DataFrame:
    """Add place: the dense rank of the coverage."""
    places = ranking.ranked(frame.select(*by, F.col("coverage").alias("score")).distinct(), "min", 12, by)
    # stored, so that its size is known: where coverages are few, no row of the frame is shuffled to be joined
    places = stored(places.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("score").alias("_c"), F.col("rank").alias("place")))
    on = [frame[b] == places[f"_{b}"] for b in by] + [F.round(frame["coverage"], 12) == places["_c"]]
    return frame.join(places, on).drop("_c", *[f"_{b}" for b in by])


def position_coverage(frame: DataFrame, method: str = "Top") -> DataFrame:
    """(pos, pos_coverage, first) of the mapped positions: each by the best, median or mean place of the rows that hold it; and
    the first of these places."""
    ways = {"Top": F.min("place"), "Median": F.median("place"), "Mean": F.avg("place")}
    if method not in ways:
        raise ValueError(f"method must be one of {sorted(ways)}")
    ends = frame.select(F.explode(F.array(*_ends(frame))).alias("pos"), "place")
    each = ends.groupBy("pos").agg(ways[method].cast("double").alias("score"), F.min("place").alias("first"))
    return ranking.ranked(each, "min").select("pos", F.col("coverage").alias("pos_coverage"), "first")


def relevant(
    frame: DataFrame, length: int, n: int | None = None, k: float | None = None, coverage: float | None = None, categories: list[str] | None = None, method: str = "Top"
) -> DataFrame:
    """The rows to judge, with place: of the categories, mapped at all ends, and among the first places.

    The first places are ``n``, or ``length`` / ``k`` rounded down, or those before the first place that holds a position whose
    coverage among the mapped positions is above ``coverage``; without any, all of them.
    """
    if sum(x is not None for x in (n, k, coverage)) > 1:
        raise ValueError("give only one of n, k and coverage")
    rows = frame if categories is None or "Any" in categories else frame.where(F.col("category").isin(categories))
    mapped = ["res_i", "res_j"] if "res_i" in frame.columns else ["resno"]
    rows = _placed(rows.dropna(subset=mapped), [])
    if coverage is not None:
        found = stored(position_coverage(rows, method))  # a row for each position
        for end in _ends(rows):
            rows = rows.join(found.select(F.col("pos").alias(end), F.col("pos_coverage").alias(f"{end}_coverage")), end)
        # the first row that holds a position above the coverage is the first row of one of these positions
        limit = found.agg(F.min(F.when(F.col("pos_coverage") > coverage, F.col("first"))).alias("_limit"))
        return rows.crossJoin(F.broadcast(limit)).where(F.col("_limit").isNull() | (F.col("place") < F.col("_limit"))).drop("_limit")  # one row
    if n is None:
        n = int(length // k) if k is not None else None
    return rows if n is None else rows.where(F.col("place") <= n)


def key_recovery(frame: DataFrame, keys: DataFrame, length: int, method: str = "Top") -> DataFrame:
    """One row: auroc, auprc of finding the residues ``keys`` (resno) by the coverage of their positions."""
    rows = relevant(frame, length, coverage=1.0, method=method)
    ends = [("res_i", "pos_i_coverage"), ("res_j", "pos_j_coverage")] if "res_i" in frame.columns else [("resno", "pos_coverage")]
    parts = [rows.select(F.col(r).alias("resno"), F.col(c).alias("coverage")) for r, c in ends]
    each = cut((parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]).distinct())
    key = keys.select("resno", F.lit(1).alias("_key")).distinct()
    marked = each.join(key, "resno", "left").select(F.lit(1).alias("all"), (-F.col("coverage")).alias("score"), F.coalesce("_key", F.lit(0)).alias("truth"))
    return evaluation.auroc(marked, ["all"]).join(evaluation.auprc(marked, ["all"]), "all").select("auroc", "auprc")


def curve_points(rows: DataFrame, by: list[str], score: str = "score", truth: str = "truth") -> DataFrame:
    """by..., threshold, tpr, fpr, precision, recall at each distinct score: what ROC and precision plots draw."""
    at = evaluation.thresholds(rows, by, score, truth)
    return at.select(
        *by, F.col(score).alias("threshold"), F.try_divide("tp", "p").alias("tpr"), F.try_divide("fp", "n").alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "p").alias("recall"),
    )


def _first_seen(frame: DataFrame, length: int, method: str) -> tuple[DataFrame, DataFrame]:
    """(res, cut): the coverage at which each residue is first seen; (cut, seen): the largest coverage of the positions at each."""
    rows = relevant(frame, length, coverage=1.0, method=method)
    first = rows.select(F.explode(F.array("res_i", "res_j")).alias("res"), "coverage").groupBy("res").agg(F.min("coverage").alias("cut"))
    seen = rows.groupBy(F.col("coverage").alias("cut")).agg(F.max(F.greatest("pos_i_coverage", "pos_j_coverage")).alias("seen"))
    return stored(first), stored(seen)


def _summary(at: DataFrame, curve: DataFrame) -> DataFrame:
    order = Window.orderBy("cut")  # one row per distinct coverage
    seen = at.select("cut", F.max("seen").over(order).alias("x"))
    # a coverage that adds no residue keeps the z-score of the one before
    known = seen.join(curve.select("cut", "z_score"), "cut", "left").withColumn("z", F.last("z_score", ignorenulls=True).over(order)).dropna(subset=["z"])
    step = (F.col("x") - F.lag("x").over(order)) * (F.col("z") + F.lag("z").over(order)) / 2
    return known.select("z", step.alias("a")).agg(F.max("z").alias("max_z"), F.sum("a").alias("auc_z"))


def clustering_summary(frame: DataFrame, distances: DataFrame, length: int, biased: bool = True, method: str = "Top") -> DataFrame:
    """One row: max_z, auc_z of how far the residues of the best pairs cluster on the structure.

    Pairs are taken in order of coverage; at each coverage the residues seen so far have a z-score, and the curve runs
    over the largest coverage of their positions.  auc_z is its area by trapezoids; coverages without a z-score are left out.
    distances: (res_i, res_j, distance) of the structure; ``biased`` weighs a contact by its separation.
    """
    first, at = _first_seen(frame, length, method)
    return _summary(at, structure.clustering_curve(first, structure.contact_weights(distances, biased), first.count()))


def evaluate(frame: DataFrame, length: int, parts: int = 10, atoms: DataFrame | None = None) -> DataFrame:
    """A whole evaluation of pair predictions: for each set of separation categories its auroc and auprc, and for the
    first L, L/2, ... L/``parts`` places precision, recall and f1 of the confident predictions.

    category_set, auroc, auprc, top, n, precision, recall, f1; undefined precision, recall and f1 are 0.  With the
    ``atoms`` of the structure also max_biased_z, auc_biased_z, max_unbiased_z, auc_unbiased_z, which are the same in
    all rows: see :func:`clustering_summary`.

    Rows are counted by category, coverage and truth first: the sets of categories, which overlap, copy counts, not rows.
    """
    mapped = frame.dropna(subset=["res_i", "res_j"])
    counted = stored(mapped.groupBy("category", "coverage", "contact", "true_prediction").agg(F.count("*").alias("times")))
    rows = evaluation.in_category_sets(counted).withColumn("truth", F.col("contact").cast("int")).withColumn("score", -F.col("coverage"))
    areas = evaluation.auroc(rows, ["category_set"], times="times").join(evaluation.auprc(rows, ["category_set"], times="times"), "category_set")
    placed = _placed(rows, ["category_set"])
    ks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(length // k).alias("most")) for k in range(1, parts + 1)])).alias("t")
    tops = placed.where(F.col("place") <= length).select("category_set", "place", "truth", "true_prediction", "times", ks).where("place <= t.most")
    said, each = F.col("true_prediction").cast("int"), F.col("times")
    counts = tops.groupBy("category_set", "t.k").agg(F.sum(each).alias("n"), F.sum(said * F.col("truth") * each).alias("tp"), F.sum(said * each).alias("said"), F.sum(F.col("truth") * each).alias("p"))
    every = areas.crossJoin(F.broadcast(frame.sparkSession.range(1, parts + 1).select(F.col("id").cast("int").alias("k"))))  # ``parts`` rows
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(F.try_divide("tp", "said")), zero(F.try_divide("tp", "p"))
    got = every.join(counts, ["category_set", "k"], "left")
    top = F.when(F.col("k") == 1, "L").otherwise(F.concat(F.lit("L/"), F.col("k").cast("string")))
    shown = got.select(
        "category_set", "auroc", "auprc", top.alias("top"), F.coalesce("n", F.lit(0)).alias("n"), precision.alias("precision"), recall.alias("recall"),
        zero(F.try_divide(2 * precision * recall, precision + recall)).alias("f1"),
    )
    if atoms is None:
        return shown
    first, at = _first_seen(frame, length, "Top")
    size = first.count()
    for name, biased in (("biased", True), ("unbiased", False)):
        one = _summary(at, structure.summed_curve(first, atoms, size, biased)).select(F.col("max_z").alias(f"max_{name}_z"), F.col("auc_z").alias(f"auc_{name}_z"))
        shown = shown.crossJoin(F.broadcast(one))  # one row
    return shown


def best_chain(sequences: DataFrame, chains: DataFrame, score=None, gap_open: float = -10.0, gap_extend: float = -0.5) -> DataFrame:
    """(query, chain, score, pos, resno): the pairs aligned between each query and its best chain.

    sequences: (query, seq); chains: (query, chain, seq, resnos array<int>), resnos the residue numbers of seq.  The pairs of a
    query and a chain are spread over tasks and aligned in lots, all cells of two sequences in one task; of equal scores the
    first chain by name is kept, and only equal letters are mapped.
    """
    score = score or (lambda a, b: 5.0 if a == b else -4.0)

    def aligned(batches):
        import numpy as np
        import pandas as pd

        for t in batches:
            a, b = t["a"].tolist(), t["b"].tolist()
            totals, (k, i, j) = structure.global_alignments(a, b, score, gap_open, gap_extend)
            same = np.array([a[x][y] == b[x][z] for x, y, z in zip(k.tolist(), i.tolist(), j.tolist(), strict=True)], bool)
            order = np.argsort(k[same], kind="stable")
            ends = np.searchsorted(k[same][order], np.arange(1, len(t)))
            pos, place = (np.split(x[same][order].astype("int32"), ends) if len(t) else [] for x in (i, j))
            resno = [np.asarray(r)[p] for r, p in zip(t["resnos"], place, strict=True)]
            yield pd.DataFrame({"query": t["query"], "chain": t["chain"], "score": totals, "pos": pos, "resno": resno})

    pairs = sequences.select("query", F.col("seq").alias("a")).join(chains.select("query", "chain", F.col("seq").alias("b"), "resnos"), "query")
    spread = importable(pairs).repartition("query", "chain")
    got = spread.mapInPandas(aligned, "query string, chain string, score double, pos array<int>, resno array<int>")
    whole = F.struct("chain", "score", F.arrays_zip("pos", "resno").alias("met"))
    best = got.groupBy("query").agg(F.min_by(whole, F.struct((-F.col("score")).alias("s"), "chain")).alias("best"))
    met = best.select("query", "best.chain", "best.score", F.explode("best.met").alias("met"))
    return met.select("query", "chain", "score", "met.pos", "met.resno")
