"""Counts of all nodes of a tree, rolled up from the leaves, for tiles of two blocks of columns.

A row is not copied to each node above it.  The tree is cut into heavy paths: from a node on, a path follows the child
with the most leaves.  Walking a path upwards, one table of counts is kept and only the leaves of the other children are
added, so that a row is added once for each heavy path above it: n log n additions in any tree, a caterpillar too.  All
pairs of columns of a tile are counted at once, and the sums that entropies need follow each addition.

Transitions between two rows belong to the node at which the rows first meet, their lowest common ancestor: there the
rows of its children are counted across, and the counts of a finished path are added to the path above.  Where two children
are large, the pairs of their rows are not listed: each row of the smaller counts how many of the larger come before it.

A tile is a task's work: the codes of two blocks of ``BLOCK`` columns for all rows, and the tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import importable

#: Columns of a block.
BLOCK = 32
#: The same for transitions, which take longer, so that more tasks share the pairs of columns.
TRANSITION_BLOCK = 2
#: Pairs of rows that are listed to be counted.
PAIRS_LISTED = 4096
#: Result rows handed back at once.
OUT_ROWS = 50_000


class Paths:
    """A tree as heavy paths.  Leaves stand in one order, so that each node has a run of them."""

    def __init__(self, rows: list[dict]):
        self.names = [r["node"] for r in rows]
        at = {x: k for k, x in enumerate(self.names)}
        kids: list[list[int]] = [[] for _ in rows]
        roots = []
        for k, r in enumerate(rows):
            roots.append(k) if r["parent"] is None else kids[at[r["parent"]]].append(k)
        if len(roots) != 1:
            raise ValueError("a tree has one root")
        order, stack = [], roots[:]
        while stack:
            k = stack.pop()
            order.append(k)
            stack += kids[k]
        if len(order) != len(rows):
            raise ValueError("the parents of a tree form a loop")
        self.size = np.zeros(len(rows), int)
        for k in reversed(order):
            self.size[k] = sum(self.size[c] for c in kids[k]) if kids[k] else 1
        self.start = np.zeros(len(rows), int)
        heavy: dict[int, int] = {}
        for k in order:
            place = self.start[k]
            for c in kids[k]:
                self.start[c], place = place, place + self.size[c]
            if kids[k]:
                heavy[k] = max(kids[k], key=lambda c: self.size[c])
        self.leaves = [""] * int(self.size[roots[0]])
        for k in order:
            if not kids[k]:
                self.leaves[self.start[k]] = self.names[k]
        below = set(heavy.values())
        #: From the deepest on: (top, nodes from the leaf upwards, and of each its other children).
        self.paths: list[tuple[int, list[tuple[int, list[int]]]]] = []
        for top in reversed(order):
            if top not in below:
                way, k = [], top
                while True:
                    way.append((k, [c for c in kids[k] if c != heavy.get(k)]))
                    if k not in heavy:
                        break
                    k = heavy[k]
                self.paths.append((top, way[::-1]))

    def under(self, k: int) -> range:
        return range(self.start[k], self.start[k] + self.size[k])


def entropy_sums(tree: Paths, cells: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(node, number of distinct cells, sum of c ln c over them) for every row of ``cells`` (items x leaves, below width)."""
    items = np.arange(len(cells))
    c = np.arange(cells.shape[1] + 2, dtype=float)
    step = np.diff(c * np.log(np.maximum(c, 1)))  # what one more adds to c ln c
    counts = np.zeros((len(cells), width), np.int32)
    for _, way in tree.paths:
        kinds, total, added = np.zeros(len(cells), np.int64), np.zeros(len(cells)), []
        for z, (k, others) in enumerate(way):
            for x in [x for o in others for x in tree.under(o)] if z else tree.under(k):
                cell = cells[:, x]
                before = counts[items, cell]
                kinds += before == 0
                total += step[before]
                counts[items, cell] = before + 1
                added.append(x)
            yield k, kinds.copy(), total.copy()
        for x in added:
            counts[items, cells[:, x]] = 0


def _across(mine: np.ndarray, g: np.ndarray, theirs: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the transitions between two sets of rows: their numbers, in order, and groups below n.

    A transition goes from the smaller number to the larger, and its key is n times the one's group and the other's.  The rows of the
    smaller set are counted against the groups of the larger one: how many of those come before each of them.  Pairs of rows
    are only listed where that is less work.
    """
    if len(mine) < len(theirs):
        mine, g, theirs, h = theirs, h, mine, g
    if len(mine) * len(theirs) <= PAIRS_LISTED:
        before = mine[:, None] < theirs
        x, y = np.where(before, g[:, None], h), np.where(before, h, g[:, None])
        return np.unique(x * n + y, return_counts=True)
    kinds, own = np.unique(g, return_inverse=True)
    at = np.searchsorted(mine, theirs)
    upto = np.empty((len(theirs), len(kinds)), np.int64)
    held, last = np.zeros(len(kinds), np.int64), 0
    if len(mine) > 4 * len(theirs) or len(kinds) > 64:
        for k, z in enumerate(at.tolist()):
            held = held + np.bincount(own[last:z], minlength=len(kinds))
            upto[k], last = held, z
    else:
        for k in range(len(kinds)):
            upto[:, k] = np.append(0, np.cumsum(own == k))[at]
    total = np.bincount(own, minlength=len(kinds))
    seen, place = np.unique(h, return_inverse=True)
    by = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[by], np.arange(len(seen)))
    come, all_of = np.add.reduceat(upto[by], starts, axis=0), np.bincount(place)[:, None] * total
    keys = np.concatenate(((kinds * n + seen[:, None]).ravel(), (seen[:, None] * n + kinds).ravel()))
    counts = np.concatenate((come.ravel(), (all_of - come).ravel()))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.add.reduceat(counts, first)
    return keys[first][counts > 0], counts[counts > 0]


def transition_sums(tree: Paths, order: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int, float, float]]:
    """(node, matches, mismatches, sum of c ln c of the matches', of the mismatches' transitions) of two columns.

    ``order``: the rows' numbers; a transition goes from the smaller to the larger.
    """
    width = int(b.max(initial=0)) + 1
    seen, g = np.unique(a.astype(np.int64) * width + b, return_inverse=True)
    n = len(seen)
    first, second = seen // width, seen % width
    match = ((first[:, None] != first) == (second[:, None] != second)).ravel()
    log = lambda c: c * np.log(np.maximum(c, 1))
    done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    counts = np.zeros(n * n, np.int64)
    for top, way in tree.paths:
        touched, sums = [], np.zeros(4)
        held = np.zeros(0, np.int64)  # the leaves so far, by their numbers

        def add(keys: np.ndarray, more: np.ndarray) -> None:
            before = counts[keys]  # noqa: B023
            counts[keys] = before + more
            gain, is_match = log(before + more) - log(before), match[keys]  # noqa: B023
            sums[:] += more[is_match].sum(), more[~is_match].sum(), gain[is_match].sum(), gain[~is_match].sum()  # noqa: B023
            touched.append(keys)  # noqa: B023

        for rung, (k, others) in enumerate(way):
            for o in others:
                add(*done.pop(o))
                theirs = np.array(tree.under(o))
                theirs = theirs[np.argsort(order[theirs], kind="stable")]
                add(*_across(order[held], g[held], order[theirs], g[theirs], n))
                held = np.insert(held, np.searchsorted(order[held], order[theirs]), theirs)
            if not rung:
                held = np.array(tree.under(k))
            yield k, int(sums[0]), int(sums[1]), float(sums[2]), float(sums[3])
        keys = np.unique(np.concatenate(touched)) if touched else np.zeros(0, np.int64)
        done[top] = keys, counts[keys]
        counts[keys] = 0


def _blocks(packed: DataFrame, block: int) -> DataFrame:
    """(b, cells: seq_idx and the codes of the columns of block b, for all rows)."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("codes") - 1) / block).cast("int")), lambda b: F.struct(b.alias("b"), F.slice("codes", b * block + 1, F.lit(block)).alias("part")))
    cells = packed.where(F.size("codes") > 0).select("seq_idx", F.explode(parts).alias("x"))
    return cells.select("x.b", F.struct("seq_idx", "x.part").alias("cell")).groupBy("b").agg(F.collect_list("cell").alias("cells"))


def _tree_row(tree: DataFrame) -> DataFrame:
    return tree.agg(F.collect_list(F.struct("node", "parent")).alias("tree"))


def _held(tree: Paths, cells: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(rows' numbers, codes: leaves x columns) in the tree's order of leaves."""
    rows = {str(c["seq_idx"]): c for c in cells}
    own = [rows[x] for x in tree.leaves]
    return np.array([c["seq_idx"] for c in own]), np.array([c["part"] for c in own], np.int64)


def _tiles(packed: DataFrame, tree: DataFrame, block: int) -> DataFrame:
    """(p, q, left, right, tree) for the blocks p <= q."""
    cells = _blocks(packed, block)
    last = cells.agg(F.max("b").alias("_last"))
    left = cells.crossJoin(F.broadcast(last)).select(F.col("b").alias("p"), F.explode(F.sequence("b", "_last")).alias("q"), F.col("cells").alias("left"))  # one row
    right = cells.select(F.explode(F.sequence(F.lit(0), "b")).alias("p"), F.col("b").alias("q"), F.col("cells").alias("right"))
    tiles = left.join(right, ["p", "q"])
    tiles = tiles.repartition(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p", "q")  # a tile is small beside its work
    return importable(tiles.crossJoin(F.broadcast(_tree_row(tree))))  # one row, a tree's nodes


class _Out:
    """Rows of numbers for each node, handed back in batches."""

    def __init__(self, names: list[str], kinds: list[pa.DataType]):
        self.names, self.kinds, self.held, self.n = ["node", *names], kinds, [], 0

    def add(self, node: str, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((node, cols))
        self.n += len(cols[0])
        if self.n > OUT_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            nodes = pa.array([x for x, _ in self.held]).take(pa.array(np.repeat(np.arange(len(self.held)), [len(c[0]) for _, c in self.held])))
            cols = [pa.array(np.concatenate([c[k] for _, c in self.held])).cast(kind) for k, kind in enumerate(self.kinds)]
            yield pa.RecordBatch.from_arrays([nodes, *cols], names=self.names)
        self.held, self.n = [], 0


def _column_pairs(row: dict, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Columns of left and right that make the pairs of a tile, and their positions."""
    n, m = len(row["left"][0]["part"]), len(row["right"][0]["part"])
    i, j = np.triu_indices(n, 1) if row["p"] == row["q"] else (x.ravel() for x in np.indices((n, m)))
    return i, j, i + row["p"] * block, j + row["q"] * block


def pair_entropies(packed: DataFrame, tree: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, pos_i, pos_j, kinds (distinct pairs of codes), score (entropy) of all nodes and pairs of columns.

    ``packed``: one alignment (seq_idx, codes), whose rows are the leaves of ``tree`` by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(["pos_i", "pos_j", "kinds", "score"], [pa.int32(), pa.int32(), pa.int64(), pa.float64()])
        for row in (r for b in batches for r in b.to_pylist()):
            paths = Paths(row["tree"])
            (_, left), (_, right) = _held(paths, row["left"]), _held(paths, row["right"])
            i, j, pos_i, pos_j = _column_pairs(row, block)
            if len(i):
                width = int(right.max()) + 1
                cells = np.ascontiguousarray((left[:, i] * width + right[:, j]).T)
                for k, kinds, total in entropy_sums(paths, cells, int(cells.max()) + 1):
                    n = paths.size[k]
                    yield from out.add(paths.names[k], pos_i, pos_j, kinds, np.where(kinds == 1, 0.0, np.log(n) - total / n))
        yield from out.rest()

    return _tiles(packed, tree, block).mapInArrow(run, "node string, pos_i int, pos_j int, kinds bigint, score double")


def single_entropies(packed: DataFrame, tree: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, pos, kinds (distinct codes), score (entropy) of all nodes and columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(["pos", "kinds", "score"], [pa.int32(), pa.int64(), pa.float64()])
        for row in (r for b in batches for r in b.to_pylist()):
            paths = Paths(row["tree"])
            _, codes = _held(paths, row["cells"])
            pos = np.arange(codes.shape[1]) + row["b"] * block
            for k, kinds, total in entropy_sums(paths, np.ascontiguousarray(codes.T), int(codes.max()) + 1):
                n = paths.size[k]
                yield from out.add(paths.names[k], pos, kinds, np.where(kinds == 1, 0.0, np.log(n) - total / n))
        yield from out.rest()

    blocks = importable(_blocks(packed, block).crossJoin(F.broadcast(_tree_row(tree))))  # one row
    return blocks.mapInArrow(run, "node string, pos int, kinds bigint, score double")


def pair_transition_scores(packed: DataFrame, tree: DataFrame, block: int = TRANSITION_BLOCK) -> DataFrame:
    """node, pos_i, pos_j, m_cnt, mm_cnt, m_ent, mm_ent: transitions between all pairs of rows of every node.

    Both kinds share the depth n(n-1)/2 (1 for a single row, which has no transitions), so neither need sum to 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "pos_i", "pos_j", "m_cnt", "mm_cnt", "m_ent", "mm_ent"]
        for row in (r for b in batches for r in b.to_pylist()):
            paths = Paths(row["tree"])
            (order, left), (_, right) = _held(paths, row["left"]), _held(paths, row["right"])
            node_names, known = pa.array(paths.names), {}
            for i, j, pos_i, pos_j in zip(*_column_pairs(row, block), strict=True):
                same = left[:, i].tobytes(), right[:, j].tobytes()  # columns may repeat others
                if same not in known:
                    known[same] = np.array(list(transition_sums(paths, order, left[:, i], right[:, j])), float).reshape(-1, 5)
                found = known[same]
                nodes = found[:, 0].astype(int)
                n = paths.size[nodes]
                depth = np.maximum(n * (n - 1) / 2, 1.0)[:, None]
                cnt, total = found[:, 1:3], found[:, 3:5]
                ent = cnt / depth * np.log(depth) - total / depth
                at = [pa.array(np.full(len(nodes), x, np.int32)) for x in (pos_i, pos_j)]
                whole = [pa.array(np.ascontiguousarray(c)) for c in cnt.astype(np.int64).T]
                yield pa.RecordBatch.from_arrays([node_names.take(pa.array(nodes)), *at, *whole, *[pa.array(np.ascontiguousarray(c)) for c in ent.T]], names=names)

    return _tiles(packed, tree, block).mapInArrow(run, "node string, pos_i int, pos_j int, m_cnt bigint, mm_cnt bigint, m_ent double, mm_ent double")
