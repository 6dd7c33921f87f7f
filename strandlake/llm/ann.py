"""Approximate nearest neighbours by inner product: stable projections under a kd-tree.

Largest inner product becomes smallest Euclidean distance when every row x gets one
more coordinate, sqrt(M^2 - |x|^2), M the largest norm, and every query gets 0 there.
A Gaussian (2-stable) projection to ``PROJECTED`` coordinates turns a squared distance
d^2 into d^2 times a chi-square variable.  Its axes are made orthogonal and of one length, which
keeps the mean and lessens the spread: the test below errs on the side of finding more.

The top of the kd-tree is fitted on the projections of a bounded sample (``SAMPLE`` rows) and
deals *every* row into one of at most ``CELLS`` cells; a cell of more than ``BLOCK`` rows is dealt to several
blocks by a hash of the id.  Each block has the rest of the tree over its projected rows.

For a query, the leaves of a block come in the order of their projected distance, and so do the
rows, whose own projected distance is far larger than that of their leaf's box.  Where a row is at
projected distance r and the k-th nearest verified row at distance d, a row nearer than that one would lie
nearer than r with probability F(r^2 / d^2), F the chi-square distribution; rows for which that
reaches ``CONFIDENCE`` are not verified on the original vectors, and the search stops at the first
leaf that is so far away.

A query first searches the cell that its projection is nearest to.  The k-th distance found there
goes on with it, and by the same test it visits only those other cells whose box is near enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import col, written

PROJECTED, CONFIDENCE, SEED = 16, 0.9, 5
#: Rows of one block (the lower part of the tree), about, and of one leaf.
BLOCK, LEAF = 10_000, 32
#: Cells of the upper part of the tree, at most, and rows that it is fitted on, at most.
CELLS, SAMPLE = 4096, 100_000
#: Queries that are searched at once.
TOGETHER = 256


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile for an even number m of degrees of freedom, by bisection of the closed form."""
    if m % 2 or not 0 < p < 1:
        raise ValueError("m must be even and 0 < p < 1")

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def axes_of(width: int, m: int, seed: int = SEED) -> np.ndarray:
    """Projection of vectors with their additional coordinate, which is the last row.

    Squared lengths grow m-fold on average.  Of fewer coordinates than ``m`` the axes are left as drawn.
    """
    drawn = np.random.default_rng(seed).normal(size=(width + 1, m))
    return drawn if m > width + 1 else np.linalg.qr(drawn)[0] * math.sqrt(width + 1)


def projected(vectors: np.ndarray, top: float, axes: np.ndarray, query: bool = False) -> np.ndarray:
    """Projections; ``top`` is the largest squared norm."""
    at = vectors @ axes[:-1]
    if not query:
        at += np.sqrt(np.maximum(top - (vectors * vectors).sum(axis=1), 0))[:, None] * axes[-1]
    return at


def gaps(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(at), len(low)))
    for axis in range(at.shape[1]):
        x = at[:, axis, None]
        out += np.maximum(np.maximum(low[:, axis] - x, x - high[:, axis]), 0) ** 2
    return out


class Cells:
    """Upper part of the tree: splits at medians of the widest axis, until there are ``cells`` parts."""

    def __init__(self, points: np.ndarray, cells: int):
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, lower node, upper node; a cell as -1 - its number
        self.cells = 0
        self.root = self._split(points, cells)

    def _split(self, points: np.ndarray, cells: int) -> int:
        spread = np.ptp(points, axis=0) if len(points) > 1 else np.zeros(1)
        if cells < 2 or not spread.max() > 0:
            self.cells += 1
            return -self.cells
        axis, left = int(spread.argmax()), cells // 2
        order = np.sort(points[:, axis])
        value = float(order[min(len(order) - 1, max(1, len(order) * left // cells))])
        below = points[:, axis] < value
        if not below.any() or below.all():
            value = float(np.nextafter(order[0], np.inf))
            below = points[:, axis] < value
        me = len(self.splits)
        self.splits.append((axis, value, 0, 0))
        self.splits[me] = (axis, value, self._split(points[below], left), self._split(points[~below], cells - left))
        return me

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.full(len(points), self.root)
        if self.splits:
            axis, value, lower, upper = (np.array(c) for c in zip(*self.splits, strict=True))
            while len(at := np.flatnonzero(node >= 0)):
                k = node[at]
                node[at] = np.where(points[at, axis[k]] < value[k], lower[k], upper[k])
        return -1 - node


class ProjectionTree:
    """kd-tree over projected rows, and the search with the stopping test."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, axes: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors, self.top, self.axes = ids, vectors, top, axes
        points = projected(vectors, top, axes)
        parts, leaves = [np.arange(len(ids))], []
        while parts:
            part = parts.pop()
            if len(part) <= leaf:
                leaves.append(part)
                continue
            spread = np.ptp(points[part], axis=0)
            order = np.argpartition(points[part, int(spread.argmax())], len(part) // 2)
            parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        self.leaves = np.full((len(leaves), leaf), -1)
        for k, part in enumerate(leaves):
            self.leaves[k, : len(part)] = part
        # leaf by leaf in single precision, the largest norm being 1: what a first look at a leaf reads
        self.scale = 1 / math.sqrt(top) if top > 0 else 1.0
        self.coarse = np.where((self.leaves >= 0)[:, :, None], vectors[self.leaves] * self.scale, 0).astype(np.float32)
        self.coarse_error = (vectors.shape[1] + 8) * 2.0**-23  # of a look, for vectors of norm 1 at most
        self.near = (points[self.leaves] * self.scale).astype(np.float32)
        self.near_square = np.where(self.leaves >= 0, np.einsum("lrm,lrm->lr", self.near, self.near), np.inf)
        self.verified = 0  # rows compared with a query on the original vectors, summed over all queries
        self.low = np.array([points[p].min(axis=0) for p in leaves])
        self.high = np.array([points[p].max(axis=0) for p in leaves])

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, quantile: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (queries x k) of the rows found, best first; id -1 where there are fewer.

        ``bound``: for each query a score that k rows elsewhere reach; lower ones need not be found.
        """
        n = len(queries)
        bound = np.full(n, -np.inf) if bound is None else bound
        at_query = projected(queries, self.top, self.axes, True)
        gap = gaps(at_query, self.low, self.high) * self.scale**2
        at_query *= self.scale
        query_square = (at_query * at_query).sum(axis=1)
        at_query = at_query.astype(np.float32)
        order = np.argsort(gap, axis=1, kind="stable")
        gap = np.take_along_axis(gap, order, axis=1)
        size_of = np.sqrt((queries * queries).sum(axis=1))
        norm = size_of**2 + self.top
        single = (queries / size_of[:, None]).astype(np.float32)
        unit = size_of / self.scale  # of a look
        best_id = np.full((n, k), -1)
        best = np.full((n, k), -np.inf)
        flat = self.coarse.reshape(-1, self.coarse.shape[2])

        def reach(of: np.ndarray) -> np.ndarray:
            """Squared projected distance up to which a nearer row may lie; infinite until k rows are found.

            The slack covers single precision, so that copies of a vector count as equally near.
            """
            far = norm[of] - 2 * np.maximum(best[of, -1], bound[of])
            return quantile * np.maximum(far, 0) * self.scale**2 + 1e-5 * (1 + query_square[of])

        alive, step, size = np.arange(n), 0, max(1, 128 // self.leaves.shape[1])
        alive = alive[gap[alive, 0] <= reach(alive)]
        while len(alive) and step < len(self.leaves):
            pick = order[alive, step : step + size]
            rows = self.leaves[pick].reshape(len(alive), -1)
            away = self.near_square[pick] - 2 * np.einsum("qlrm,qm->qlr", self.near[pick], at_query[alive])
            near = away.reshape(len(alive), -1) + query_square[alive, None] <= reach(alive)[:, None]
            near &= (rows >= 0) & (self.ids[rows] != ids[alive, None])
            one, col = np.nonzero(near)
            self.verified += len(one)
            place = pick[one, col // self.leaves.shape[1]] * self.leaves.shape[1] + col % self.leaves.shape[1]
            look = np.einsum("nd,nd->n", flat[place], single[alive[one]])
            least = np.maximum(best[alive, -1], bound[alive]) / unit[alive] - self.coarse_error
            better = near
            better[one, col] = look >= least[one]
            at = np.flatnonzero(better.any(axis=1))
            if len(at):  # only these queries have something to verify and merge
                q, (one, col) = alive[at], np.nonzero(better[at])
                found = np.full((len(at), better.shape[1]), -1)
                exact = np.full(found.shape, -np.inf)
                row = rows[at][one, col]
                found[one, col] = self.ids[row]
                # on the original vectors in double precision; the same sum wherever a vector stands, so equal vectors tie
                exact[one, col] = (self.vectors[row] * queries[q[one]]).sum(axis=1)
                all_id = np.concatenate((best_id[q], found), axis=1)
                all_score = np.concatenate((best[q], exact), axis=1)
                pick = np.lexsort((all_id, -all_score), axis=1)[:, :k]
                best_id[q] = np.take_along_axis(all_id, pick, axis=1)
                best[q] = np.take_along_axis(all_score, pick, axis=1)
            step += size
            if step < len(self.leaves):
                alive = alive[gap[alive, step] <= reach(alive)]
        best_id[np.isinf(best)] = -1
        return best_id, best


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part; v holds floats where the vectors do, doubles else.

    Null ids, and vectors that are null, zero, or hold null or non-finite components, take no part; of
    vectors of several lengths only those of the most frequent length (the longer, on a tie) do.
    """
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    of = df.schema[vec_col].dataType
    kind = "float" if isinstance(of, T.ArrayType) and isinstance(of.elementType, T.FloatType) else "double"
    rows = df.select(col(id_col).cast("long").alias("id"), col(vec_col).cast(f"array<{kind}>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
    return rows.where(F.size("v") == (size["s"] if size else 0))


def _flat(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1).astype(np.float64)


def _searched(dealt: DataFrame, k: int, quantile: float, top: float, axes: np.ndarray) -> DataFrame:
    """(query_id, id, score) over (block, kind, id, v, bound): in each block, rows (kind 0) come before queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, vectors, tree = None, [], [], None
        waiting: list[tuple[np.ndarray, ...]] = []

        def asked_now() -> pa.RecordBatch:
            q, v, bound = (np.concatenate(c) for c in zip(*waiting, strict=True))
            waiting.clear()
            found, score = tree.search(q, v, k, quantile, bound)
            ok = ~np.isinf(score)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(q, ok.sum(axis=1))), pa.array(found[ok]), pa.array(score[ok])], names=["query_id", "id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            block_no, kind, row_id = (b.column(i).to_numpy() for i in range(3))
            flat, bound = _flat(b.column(3), b.num_rows), b.column(4).to_numpy()
            cuts = np.append(np.flatnonzero((block_no[1:] != block_no[:-1]) | (kind[1:] != kind[:-1])) + 1, b.num_rows).tolist()
            at = 0
            for z in cuts:
                if block_no[at] != last:
                    if waiting:
                        yield asked_now()
                    last, ids, vectors, tree = block_no[at], [], [], None
                if kind[at] == 0:
                    ids.append(row_id[at:z]), vectors.append(flat[at:z])
                elif ids:
                    if tree is None:
                        tree = ProjectionTree(np.concatenate(ids), np.concatenate(vectors), top, axes)
                        vectors = []
                    for s in range(at, z, TOGETHER):
                        part = slice(s, min(z, s + TOGETHER))
                        waiting.append((row_id[part], flat[part], bound[part]))
                        if sum(len(w[0]) for w in waiting) >= TOGETHER:
                            yield asked_now()
                at = z
        if waiting:
            yield asked_now()

    return dealt.mapInArrow(run, "query_id bigint, id bigint, score double")


def nearest(
    df: DataFrame, query_where: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK,
    m: int = PROJECTED, confidence: float = CONFIDENCE, sample: int = SAMPLE, cells: int = CELLS,
) -> DataFrame:
    """query_id, rank (from 1), id, score: for each query the k rows of largest inner product found.

    Queries are the rows of ``query_where``, candidates all rows but those with the query's
    own id; ties go to the smaller id.  Rows that repeat an id are candidates each; a query that
    repeats is searched once, with the vector that sorts first.  Fewer rows than k: all of them.
    Which vectors take no part is said at ``usable``.  An empty table gives an empty result.  Other columns of ``df``,
    whatever their names, take no part.  The tree's upper part is fitted on the ``sample`` rows of smallest hash.
    """
    spark, rows = df.sparkSession, usable(df, id_col, vec_col)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    kind = rows.schema["v"].dataType.simpleString()
    count, top, width = rows.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    quantile = chi_square_quantile(confidence, m)
    axes = axes_of(width, m)
    parts = min(cells, -(-count // block))
    tree = Cells(np.zeros((0, m)), 1)
    if parts > 1:
        picked = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").toArrow()  # ``sample`` rows at most
        tree = Cells(projected(_flat(picked.column(0).combine_chunks(), picked.num_rows), top, axes), parts)
        del picked

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = tree.of(projected(_flat(b.column(1), b.num_rows), top, axes)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *b.columns], names=["cell", "id", "v"])

    indexed = written(rows.select("id", "v").mapInArrow(placed, f"cell int, id bigint, v {kind}"))
    names = [f"{n}{i}" for n in ("lo", "hi") for i in range(m)]

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, at = b.column(0).to_numpy(), projected(_flat(b.column(1), b.num_rows), top, axes)
                order = np.argsort(cell, kind="stable")
                cut = np.flatnonzero(np.diff(cell[order], prepend=-1))
                ends = np.concatenate([f.reduceat(at[order], cut, axis=0) for f in (np.minimum, np.maximum)], axis=1)
                cols = [pa.array(cell[order][cut]), pa.array(np.diff(np.append(cut, len(cell)))), *map(pa.array, np.ascontiguousarray(ends.T))]
                yield pa.RecordBatch.from_arrays(cols, names=["cell", "n", *names])

    of_batches = indexed.select("cell", "v").mapInArrow(boxed, "cell int, n bigint, " + ", ".join(f"{n} double" for n in names))
    ends = [(F.min if n[:2] == "lo" else F.max)(n).alias(n) for n in names]
    boxes = sorted(of_batches.groupBy("cell").agg(F.sum("n").alias("n"), *ends).collect())  # a row for each cell, ``cells`` at most
    if not boxes:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    numbers = np.array([r["cell"] for r in boxes])
    low, high = (np.array([[r[f"{n}{i}"] for i in range(m)] for r in boxes]) for n in ("lo", "hi"))
    # blocks of a cell have numbers in a row
    shares = np.array([-(-r["n"] // block) for r in boxes])
    first = np.cumsum(shares) - shares
    table = spark.createDataFrame(list(zip(numbers.tolist(), first.tolist(), shares.tolist(), strict=True)), "cell int, first bigint, share bigint")
    block_of = F.col("first") + F.pmod(F.xxhash64("id"), F.col("share"))
    held = indexed.join(F.broadcast(table), "cell").select(block_of.alias("block"), F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("bound"))
    asked = rows.where(query_where).groupBy("id").agg(F.min("v").alias("v"))

    def sent(home: bool):
        """Queries with the blocks that they visit: those of the nearest cell, or of all others that the test leaves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v, bound = _flat(b.column(1), b.num_rows), b.column(2).to_numpy()
                gap = gaps(projected(v, top, axes, True), low, high)
                go = np.zeros(gap.shape, bool)
                go[np.arange(len(v)), gap.argmin(axis=1)] = True
                if not home:
                    size = (v * v).sum(axis=1) + top
                    reach = quantile * np.maximum(size - 2 * bound, 0) + 1e-5 * size  # as in ProjectionTree.search
                    go = ~go & (gap <= reach[:, None])
                q, c = np.nonzero(go)
                row = np.repeat(q, shares[c])
                at = np.arange(len(row)) - np.repeat(np.cumsum(shares[c]) - shares[c], shares[c]) + np.repeat(first[c], shares[c])
                take = pa.array(row)
                cols = [pa.array(at), pa.array(np.ones(len(row), np.int32)), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take)]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "kind", "id", "v", "bound"])

        return run

    def searched(queries: DataFrame, home: bool) -> DataFrame:
        visits = queries.mapInArrow(sent(home), f"block bigint, kind int, id bigint, v {kind}, bound double")
        both = held.unionByName(visits)
        # by number, not by its hash: each task has as many blocks as any other
        dealt = both.repartitionByRange(min(int(shares.sum()), 100_000), "block") if shares.sum() > 1 else both.coalesce(1)
        return _searched(dealt.sortWithinPartitions("block", "kind", "id"), k, quantile, top, axes)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = searched(asked.withColumn("bound", F.lit(float("-inf"))), True)
    if len(boxes) > 1:
        found = written(found)
        kth = ranked(found).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
        again = asked.join(kth, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        found = found.unionByName(searched(again, False))
    return ranked(found).select("query_id", "rank", F.col("id").alias(id_col), "score")
