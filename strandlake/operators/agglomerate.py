"""Agglomeration of rows by their distances, on the cluster.

The distances are a table of one row for each cluster, with its distances to all others packed as bytes.  In a round,

* every cluster finds the clusters that are nearest to it, in one pass without a shuffle;
* clusters that are nearest to each other, and to no others, are merged at once, however many there are.  That gives
  the tree of merging one pair after another, as long as a merged cluster is never nearer to a third than both of its
  parts were, which holds for all five methods.  Where several are equally near, the whole set that they form is
  merged in the order of the method's tie rule, in one task that gets the set's own distances;
* columns of merged clusters are combined inside each row (Lance-Williams), and only the rows that merge are shuffled.

About a third of the clusters go in a round.  The last ``TAIL`` clusters are merged in one task.  The driver holds a
few numbers for each cluster (what is nearest to it, the merges), never distances of pairs.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TREE_NODE
from . import distance
from .pairs import cut, importable, stored

#: Clusters that one task merges to the end; the largest set of equally near clusters that one task merges.  Its distances
#: take 512 MB.  Distances of short texts take few values, so that thousands of rows tie in one set: where a set is larger
#: than this, pairs are merged one a round.
TAIL = 8192
#: Partners at the same least distance that a row names; a row with more waits for the pair that comes first.
NAMED = 32
#: Distances that differ by no more are equal.
EPS = 1e-12
#: Pairs that a task packs by row at once.
PACKED = 1 << 19
METHODS = ("upgma_first", "wpgma_last", "ward", "complete", "average")


def combined(method: str, x: np.ndarray, y: np.ndarray, si, sj, sk, d) -> np.ndarray:
    """Distances of a merged cluster from those of its parts (Lance-Williams); si, sj: sizes, sk: the others' sizes."""
    if method == "wpgma_last":
        return (x + y) / 2
    if method == "complete":
        return np.maximum(x, y)
    if method == "ward":
        return ((si + sk) * x + (sj + sk) * y - sk * d) / (si + sj + sk)
    return (si * x + sj * y) / (si + sj)


class _Nearest:
    """The least distance of each row to the rows before it (or after it), kept up while rows are merged."""

    def __init__(self, work: np.ndarray, before: bool):
        self.work, self.before = work, before
        self.least = np.array([self._of(k) for k in range(len(work))])

    def side(self, k: int) -> np.ndarray:
        return self.work[k, :k] if self.before else self.work[k, k + 1 :]

    def _of(self, k: int) -> float:
        side = self.side(k)
        return side.min() if side.size else np.inf

    def changed(self, i: int, j: int, old_i: np.ndarray, old_j: np.ndarray) -> None:
        """Row i has new distances and row j is gone; ``old_i`` and ``old_j`` are what they were."""
        held = np.minimum(old_i, old_j) <= self.least  # may have been the least
        self.least = np.where(held, self.least, np.minimum(self.least, np.where(self._sees(i), self.work[i], np.inf)))
        for k in np.flatnonzero(held & np.isfinite(self.least)).tolist():
            self.least[k] = self._of(k)
        self.least[i], self.least[j] = self._of(i), np.inf

    def _sees(self, i: int) -> np.ndarray:
        """Rows on whose side row i stands."""
        rows = np.arange(len(self.work))
        return rows > i if self.before else rows < i


def join_order(work: np.ndarray, size: np.ndarray, method: str, upto: float = np.inf) -> Iterator[tuple[int, int, float]]:
    """(i, j, distance) with i < j of one merge after another, while the least distance is at most ``upto``.

    upgma_first: distances averaged by size; of equal minima the lowest column, then row.
    wpgma_last: plain average of the two rows; of equal minima the last in row order.
    ward (of squares), complete, average: the first minimum in row order.  ``work`` is used up.

    Each row's least distance is kept, so a step looks at one number for each row, and again at those rows
    whose nearest cluster has been merged.
    """
    size = np.array(size, float)
    np.fill_diagonal(work, np.inf)
    near, last = _Nearest(work, method != "upgma_first"), method == "wpgma_last"
    alive = np.ones(len(work), bool)
    for _ in range(len(work) - 1):
        least = near.least.min()
        if least > upto:
            return
        hits = np.flatnonzero(near.least <= least + EPS)
        a = int(hits[-1] if last else hits[0])
        side = np.flatnonzero(near.side(a) <= least + EPS) + (0 if near.before else a + 1)
        b = int(side[-1] if last else side[0])
        i, j = min(a, b), max(a, b)
        least = float(work[i, j])
        yield i, j, least
        x, y = work[i].copy(), work[j].copy()
        alive[j] = False
        with np.errstate(invalid="ignore"):
            new = combined(method, x, y, size[i], size[j], size, least)
        new[~alive] = new[i] = np.inf
        work[i], work[:, i] = new, new
        work[j], work[:, j] = np.inf, np.inf
        near.changed(i, j, x, y)
        size[i] += size[j]


Merge = tuple[int, int, float]  # i < j, the places of the first leaves of both clusters; their distance


def tree_rows(merges: list[Merge], names: list[str], method: str) -> list[tuple]:
    """Nodes of a tree (parents first) from its merges in any order.

    They are put into the order in which one pair after another would have been merged: of those whose parts exist,
    the least distance comes first, and of equal ones what the tie rule names first.
    """
    n = len(names)
    children = defaultdict(list)  # of a leaf's place, the merges that its cluster takes part in, in order
    for k, (i, j, _) in enumerate(merges):
        children[i].append(k), children[j].append(k)
    tie = {"upgma_first": lambda i, j: (i, j), "wpgma_last": lambda i, j: (-j, -i)}.get(method, lambda i, j: (j, i))
    at = dict.fromkeys(children, 0)
    heap: list[tuple] = []

    def offer(x: int) -> None:
        """The next merge of x, if it is also the next one of its other part."""
        if at[x] < len(children[x]):
            k = children[x][at[x]]
            i, j, d = merges[k]
            if children[i][at[i]] == k == children[j][at[j]]:
                heapq.heappush(heap, (round(d, 11), tie(i, j), k))

    for k, (i, _, _) in enumerate(merges):
        if children[i][0] == k:
            offer(i)
    height = [0.0] * n
    label: list[tuple[str, int | None]] = [(name, None) for name in names]
    joins = []
    while heap:
        _, _, k = heapq.heappop(heap)
        i, j, d = merges[k]
        top, number = (np.sqrt(d) if method == "ward" else d) / 2, n - 1 - len(joins)
        joins.append((f"Inner{number}", label[i], label[j], max(top - height[i], 0.0), max(top - height[j], 0.0)))
        height[i], label[i] = top, (f"Inner{number}", number)
        at[i], at[j] = at[i] + 1, len(children[j])
        offer(i)
    nodes = [(label[0][0], None, label[0][1], n == 1, 0.0)] if n else []
    for name, *parts in reversed(joins):
        for (child, number), length in zip(parts[:2], parts[2:], strict=True):
            nodes.append((child, name, number, number is None, float(length)))
    return nodes


# -- on the cluster ---------------------------------------------------------------------------------


def _vectors(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(v, "<f8") for v in batch.column("v").to_pylist()]


def _out(x: list[int], v: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array([r.astype("<f8").tobytes() for r in v], pa.binary())], names=["x", "v"])


def _square(rows: Iterable[np.ndarray], n: int) -> np.ndarray:
    """A symmetric matrix of n rows: the two cells of a pair may differ in their last bits, by the order of sums.

    Filled row by row and made symmetric in place, so that it is held once."""
    m = np.empty((n, n))
    for k, row in enumerate(rows):
        m[k] = row
    for at in range(0, n, 512):
        low = np.minimum(m[at : at + 512, : at + 512], m[: at + 512, at : at + 512].T)
        m[at : at + 512, : at + 512], m[: at + 512, at : at + 512] = low, low.T
    return m


def distance_rows(pairs: DataFrame, ids: list[int], squared: bool, sizes: np.ndarray | None = None) -> DataFrame:
    """(x, v) from pairs (i, j, d) of all rows; x: the place of a row in the sorted ids, v: a double for each of them.

    Pairs are packed by row before they are shuffled: a piece of a row is a row of bytes.  ``squared``: distances of ward's
    method, which between rows with copies, merged before, grow with the ``sizes``."""
    places, n = np.array(ids, np.int64), len(ids)
    sizes = np.ones(n) if sizes is None else sizes

    def pieces(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        x, y = (np.searchsorted(places, k) for k in (i, j))
        known = (places[np.minimum(x, n - 1)] == i) & (places[np.minimum(y, n - 1)] == j)
        x, y, d = x[known], y[known], d[known]
        d = d**2 * (2 * sizes[x] * sizes[y] / (sizes[x] + sizes[y])) if squared else d
        x, y, d = np.concatenate((x, y)), np.concatenate((y, x)).astype("<i4"), np.concatenate((d, d)).astype("<f8")
        order = np.argsort(x, kind="stable")
        x, y, d = x[order], y[order].tobytes(), d[order].tobytes()
        at = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)] if len(x) else [0]
        parts = [[data[w * a : w * z] for a, z in zip(at, at[1:], strict=False)] for w, data in ((4, y), (8, d))]
        return pa.RecordBatch.from_arrays([pa.array(x[at[:-1]], pa.int32()), *[pa.array(c, pa.binary()) for c in parts]], names=["x", "y", "d"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
            if size >= PACKED:
                yield pieces(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield pieces(*map(np.concatenate, zip(*held, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, row = None, None
        for b in batches:
            for x, y, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held != x:
                    if held is not None:
                        yield _out([held], [row])
                    held, row = x, np.full(n, np.inf)
                row[np.frombuffer(y, "<i4")] = np.frombuffer(d, "<f8")
        if held is not None:
            yield _out([held], [row])

    cells = importable(pairs.select(*[F.col(c).cast("bigint") for c in "ij"], F.col("d").cast("double")))
    return cells.mapInArrow(pack, "x int, y binary, d binary").repartition("x").sortWithinPartitions("x").mapInArrow(run, "x int, v binary")


def _nearest(rows: DataFrame, live: np.ndarray, last: bool) -> list:
    """(x, least distance, the first clusters at that distance) of each cluster: a few numbers a row."""
    place = {int(x): k for k, x in enumerate(live)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, least, near = b.column("x").to_pylist(), [], []
            for x, v in zip(xs, _vectors(b), strict=True):
                v = v.copy()
                v[place[x]] = np.inf
                least.append(float(v.min()))
                tied = live[np.flatnonzero(v <= least[-1] + EPS)]
                near.append((tied[::-1] if last else tied)[: NAMED + 1].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int32()), pa.array(least), pa.array(near, pa.list_(pa.int32()))], names=["x", "d", "near"])

    return rows.mapInArrow(run, "x int, d double, near array<int>").collect()  # a row for each cluster


def _sets(near: list) -> list[tuple[list[int], float]]:
    """Sets of clusters that are all equally near to some in their set and nearer to none outside, with that distance."""
    up = {r["x"]: r["x"] for r in near}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    least = {r["x"]: r["d"] for r in near}
    waits = {r["x"] for r in near if len(r["near"]) > NAMED}  # not all partners are known, or one has a nearer one
    for r in near:
        for y in r["near"]:
            if least[y] < r["d"] - EPS:
                waits.add(r["x"])
            else:
                up[root(r["x"])] = root(y)
    held: dict[int, list[int]] = defaultdict(list)
    for x in up:
        held[root(x)].append(x)
    return [(sorted(xs), max(least[x] for x in xs)) for xs in held.values() if 1 < len(xs) <= TAIL and not waits.intersection(xs)]


def _merged_sets(rows: DataFrame, live: np.ndarray, sizes: np.ndarray, sets: list[tuple[list[int], float]], method: str) -> list[Merge]:
    """The merges of each set at its distance, in order; a set's own distances go to one task."""
    place = {int(x): k for k, x in enumerate(live)}
    of = {x: s for s, (xs, _) in enumerate(sets) for x in xs}

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(of[x], x, v[[place[y] for y in sets[of[x]][0]]]) for x, v in zip(b.column("x").to_pylist(), _vectors(b), strict=True) if x in of]
            cols = [pa.array([g[k] for g in got], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[2].tobytes() for g in got], pa.binary())], names=["s", "x", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            for s, v in zip(b.column("s").to_pylist(), _vectors(b), strict=True):
                held.append(v)
                xs, upto = sets[s]
                if len(held) == len(xs):
                    done = [(xs[i], xs[j], d) for i, j, d in join_order(_square(held, len(xs)), sizes[xs], method, upto + EPS)]
                    held = []
                    cols = [pa.array([s] * len(done), pa.int32()), pa.array(range(len(done)), pa.int32())]
                    cols += [pa.array([m[k] for m in done], pa.int32() if k < 2 else pa.float64()) for k in range(3)]
                    yield pa.RecordBatch.from_arrays(cols, names=["s", "k", "i", "j", "d"])

    dealt = rows.mapInArrow(own, "s int, x int, v binary").repartition("s").sortWithinPartitions("s", "x")
    found = dealt.mapInArrow(run, "s int, k int, i int, j int, d double").collect()  # merges, fewer than clusters
    return [(r["i"], r["j"], r["d"]) for r in sorted(found, key=lambda r: (r["s"], r["k"]))]


def _waves(merges: list[Merge], sizes: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Merges as arrays (i, j, d, size i, size j), those of a wave without a cluster in common."""
    size, when, waves = sizes.copy(), defaultdict(int), defaultdict(list)
    for i, j, d in merges:
        w = max(when[i], when[j])
        waves[w].append((i, j, d, size[i], size[j]))
        size[i] += size[j]
        when[i] = w + 1
    return [tuple(np.array(c, float if k > 1 else int) for k, c in enumerate(zip(*waves[w], strict=True))) for w in sorted(waves)]


def _updated(rows: DataFrame, live: np.ndarray, sizes: np.ndarray, merges: list[Merge], method: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The rows, clusters and sizes after the merges."""
    gone = {j for _, j, _ in merges}
    root: dict[int, int] = {}
    for i, j, _ in reversed(merges):
        root[j] = root.get(i, i)
        root.setdefault(i, i)
    waves = _waves(merges, sizes)
    place = np.zeros(len(sizes), int)
    place[live] = np.arange(len(live))
    stay = np.array([k for k, x in enumerate(live) if int(x) not in gone])
    after = sizes.copy()
    for i, j, _ in merges:
        after[i] += after[j]
    ways: dict[int, list[tuple[int, int, float, float, float]]] = defaultdict(list)
    size = sizes.copy()
    for i, j, d in merges:
        ways[root[i]].append((i, j, d, size[i], size[j]))
        size[i] += size[j]
    members = {r: {x for i, j, *_ in way for x in (i, j)} for r, way in ways.items()}
    columns = after[live[stay]]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Combine the columns of every row."""
        for b in batches:
            xs, out = b.column("x").to_pylist(), []
            for x, v in zip(xs, _vectors(b), strict=True):
                v = v.copy()
                for i, j, d, si, sj in waves:
                    v[place[i]] = combined(method, v[place[i]], v[place[j]], si, sj, sizes[x], d)
                out.append(v[stay].tobytes())
            cols = [pa.array(xs, pa.int32()), pa.array(out, pa.binary()), pa.array([root.get(x, -1) for x in xs], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["x", "v", "to"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Combine the rows of every merged cluster."""
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for x, v, to in zip(b.column("x").to_pylist(), _vectors(b), b.column("to").to_pylist(), strict=True):
                held[x] = v
                if len(held) == len(members[to]):
                    for i, j, d, si, sj in ways[to]:
                        held[i] = combined(method, held[i], held[j], si, sj, columns, d)
                    yield _out([to], [held[to]])
                    held = {}

    moved = cut(rows.mapInArrow(inside, "x int, v binary, to int"))
    merged = moved.where("to >= 0").repartition("to").sortWithinPartitions("to").mapInArrow(together, "x int, v binary")
    return cut(moved.where("to < 0").select("x", "v").unionByName(merged)), live[stay], after


def _tail(rows: DataFrame, live: np.ndarray, sizes: np.ndarray, method: str) -> list[Merge]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (v for b in batches for v in _vectors(b))  # TAIL rows of TAIL numbers at most
        first = next(rows, None)
        done = [] if first is None else list(join_order(_square(chain([first], rows), len(live)), sizes[live], method))
        cols = [pa.array([live[m[k]] for m in done], pa.int32()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([m[2] for m in done], pa.float64()), pa.array(range(len(done)), pa.int32())], names=["i", "j", "d", "k"])

    one = rows.repartition(1).sortWithinPartitions("x").mapInArrow(run, "i int, j int, d double, k int")
    return [(r["i"], r["j"], r["d"]) for r in sorted(one.collect(), key=lambda r: r["k"])]


def merge_rows(rows: DataFrame, n: int, method: str, tail: int = TAIL, sizes: np.ndarray | None = None) -> list[Merge]:
    """All n - 1 merges of the clusters in ``rows`` (x, v), of one row each or of ``sizes``."""
    live, sizes, merges = np.arange(n), np.ones(n) if sizes is None else sizes, []
    while len(live) > max(tail, 1):
        near = _nearest(rows, live, method == "wpgma_last")
        sets = _sets(near)
        now = [(xs[0], xs[1], d) for xs, d in sets if len(xs) == 2]
        if larger := [s for s in sets if len(s[0]) > 2]:
            now += _merged_sets(rows, live, sizes, larger, method)
        if not now:  # the one pair that comes first
            least = min(r["d"] for r in near)
            ends = [(r["x"], r["near"][0]) for r in near if r["d"] <= least + EPS]
            key = {"upgma_first": lambda p: (min(p), max(p)), "wpgma_last": lambda p: (-max(p), -min(p))}.get(method, lambda p: (max(p), min(p)))
            i, j = sorted(min(ends, key=key))
            now = [(i, j, least)]
        rows, live, sizes = _updated(rows, live, sizes, now, method)
        merges += now
    return merges + (_tail(rows, live, sizes, method) if n > 1 else [])


def copy_merges(groups: Iterable[list[int]], method: str) -> list[Merge]:
    """The merges of rows at distance 0, in the order of the tie rule; a group holds the rising places of equal rows."""
    merges = []
    for g in groups:
        merges += [(a, b, 0.0) for a, b in zip(g[-2::-1], g[:0:-1], strict=True)] if method == "wpgma_last" else [(g[0], b, 0.0) for b in g[1:]]
    return merges


def agglomerated(pairs: DataFrame, rows: DataFrame, method: str = "upgma_first", tail: int = TAIL) -> DataFrame:
    """The tree of the rows (seq_idx) by the distances of all their pairs (i, j, d), as nodes.

    Names of leaves are the rows' numbers; inner nodes are numbered so that rank r splits node r: the last merge is
    Inner1.  No rows give no nodes, one row a root that is a leaf.

    With a column ``first`` in ``rows``, the least number among the copies of a row, ``pairs`` are those of the first rows
    only.  Copies are at distance 0 of each other and equally far from all else, so they are merged before all others,
    without distances of their own.
    """
    if method not in METHODS:
        raise ValueError(f"no method {method!r}: {', '.join(METHODS)}")
    spark = rows.sparkSession
    first = "first" if "first" in rows.columns else "seq_idx"
    leaves = sorted(map(tuple, rows.select("seq_idx", F.col(first).alias("first")).distinct().collect()))  # the leaves' numbers
    groups: dict[int, list[int]] = defaultdict(list)
    for k, (_, of) in enumerate(leaves):
        groups[of].append(k)
    ids, merges = sorted(groups), copy_merges(groups.values(), method)
    if len(ids) > 1:
        sizes, places = np.array([float(len(groups[r])) for r in ids]), [groups[r][0] for r in ids]
        held = cut(distance_rows(pairs, ids, method == "ward", sizes))
        merges += [(places[i], places[j], d) for i, j, d in merge_rows(held, len(ids), method, tail, sizes)]
    return spark.createDataFrame(tree_rows(merges, [str(k) for k, _ in leaves], method), TREE_NODE)


def identity_tree(packed: DataFrame, method: str = "upgma_first", tail: int = TAIL) -> DataFrame:
    """The tree of the rows (seq_idx, codes) by their identity distance; equal rows meet the others once."""
    clean = F.coalesce((F.size("codes") > 0) & ~F.exists("codes", lambda c: c.isNull()), F.lit(False))
    alone = F.when(~clean, F.col("seq_idx")).alias("_alone")  # no distance, not even to its copies
    rows = stored(packed.select("seq_idx", "codes", alone))
    named = stored(rows.groupBy("codes", "_alone").agg(F.min("seq_idx").alias("first")))
    on = rows["codes"].eqNullSafe(named["codes"]) & rows["_alone"].eqNullSafe(named["_alone"])
    pairs = distance.identity_distance(named.select(F.col("first").alias("seq_idx"), "codes"))
    return agglomerated(pairs, rows.join(named, on).select("seq_idx", "first"), method, tail)
