"""Trees: agglomeration, rank intervals, closures, traversals, annotation, Newick.

Trees are merged by :mod:`.agglomerate`; everything on a finished tree is a DataFrame.
Inner nodes are numbered so that rank r splits node r: the root is Inner1, and parents
have smaller numbers than their children.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import TREE_NODE
from .agglomerate import join_order, tree_rows
from .pairs import importable, numbered, stored

EULER = 0.57721566490153286061

#: node: (parent, inner number, leaf?, branch length)
Node = tuple[str, str | None, int | None, bool, float]


def agglomerate(d: np.ndarray, names: list[str], method: str = "upgma_first") -> list[Node]:
    """The tree of a small matrix of distances: :func:`agglomerate.agglomerated` in one piece."""
    work = np.array(d, float)
    merges = list(join_order(work**2 if method == "ward" else work, np.ones(len(names)), method))
    return tree_rows(merges, names, method)


def tree_frame(spark: SparkSession, nodes: list[Node]) -> DataFrame:
    return spark.createDataFrame(nodes, TREE_NODE)


#: An opening bracket, or a node: a closing bracket or nothing, a name that may be quoted, a length.
_TOKEN = r"\(|(\)?)\s*('(?:[^']|'')*'|[^(),:;'\s][^(),:;]*)?(?:\s*:\s*([^(),:;]+))?\s*(?=[,);]|$)"


def newick_trees(texts: DataFrame, by: str = "tree", text: str = "newick") -> DataFrame:
    """(by, node, parent, inner_no, is_leaf, branch_length) of many Newick texts at once.

    No recursion and no stack: brackets are counted along the text, so that the depth of each place is a running sum.
    A node that closes at a depth is the parent of what stands one deeper before it, up to the last one that closed
    there: the next closing bracket of that depth.  The sum of lengths above a node is a running sum too, an inner
    node's length being added at its opening bracket and taken off at its closing one.  Inner nodes are named by their
    distance from the root, then by where they open.  Brackets that do not match raise an error.
    """
    found = texts.select(by, F.posexplode(F.regexp_extract_all(F.trim(F.regexp_replace(text, r";\s*$", "")), F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    part = lambda g: F.regexp_extract("token", _TOKEN, g)
    opens, closes = F.col("token").startswith("("), F.col("token").startswith(")")
    marks = found.where("token <> ''").select(by, "pos", opens.alias("opens"), closes.alias("closes"), part(2).alias("label"), F.coalesce(part(3).try_cast("double"), F.lit(0.0)).alias("length"))
    along = Window.partitionBy(by).orderBy("pos")
    step = F.col("opens").cast("int") - F.col("closes").cast("int")
    placed = marks.withColumn("after", F.sum(step).over(along)).withColumn("level", F.col("after") - F.col("opens").cast("int"))  # of a bracket, outside it
    least, last = (f("after").over(Window.partitionBy(by)) for f in (F.min, lambda c: F.max_by(c, "pos")))
    wrong = (least < 0) | (last != 0)
    placed = placed.withColumn("level", F.when(wrong, F.raise_error(F.lit("unbalanced Newick string")).cast("int")).otherwise(F.col("level")))
    # the bracket that a closing one belongs to is the last opening one at its level, and the other way round
    # (what follows is looked up backwards: a frame that only grows is kept, one that only shrinks is read anew for each row)
    level = Window.partitionBy(by, "level")
    until, on = (level.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("pos"), F.desc("pos")))
    opened = F.last(F.when(F.col("opens"), F.col("pos")), ignorenulls=True).over(until)
    ends = F.last(F.when(F.col("closes"), F.col("length")), ignorenulls=True).over(on)
    matched = placed.select("*", opened.alias("start"), F.when(F.col("opens"), ends).when(F.col("closes"), -F.col("length")).otherwise(0.0).alias("gain"))
    summed = matched.withColumn("above", F.sum("gain").over(along))
    nodes = summed.where("NOT opens").withColumn("far", F.round(F.col("above") + F.col("length"), 9))
    # a node's parent is the next node that closes one level up
    parents = nodes.where("closes").select(by, (F.col("level") + 1).alias("level"), "pos", F.lit(True).alias("up"))
    line = nodes.select(by, "level", "pos", F.lit(False).alias("up")).unionByName(parents)
    following = level.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    of = line.withColumn("parent_pos", F.last(F.when(F.col("up"), F.col("pos")), ignorenulls=True).over(following)).where("NOT up").select(by, "pos", "parent_pos")
    number = F.row_number().over(Window.partitionBy(by).orderBy("far", "start"))
    inner = nodes.where("closes").select(by, "pos", number.alias("inner_no"))
    plain = F.regexp_replace(F.regexp_replace(F.trim("label"), "^'|'$", ""), "''", "'")
    named = nodes.join(inner, [by, "pos"], "left").select(
        by, "pos", F.when(F.col("closes"), F.concat(F.lit("Inner"), F.col("inner_no").cast("string"))).otherwise(plain).alias("node"), "inner_no", (~F.col("closes")).alias("is_leaf"), "length"
    )
    up = named.select(by, F.col("pos").alias("parent_pos"), F.col("node").alias("parent"))
    return named.join(of, [by, "pos"]).join(up, [by, "parent_pos"], "left").select(by, "node", "parent", F.col("inner_no").cast("int").alias("inner_no"), "is_leaf", F.col("length").alias("branch_length"))


def newick_texts(trees: DataFrame, by: str = "tree") -> DataFrame:
    """(by, newick) of trees (by, node, parent, branch_length); children in order of name.  One tree is one text, written by one task."""

    def run(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        rows = nodes[["node", "parent", "inner_no", "is_leaf", "branch_length"]].astype(object).where(nodes.notna(), None)
        return pd.DataFrame({by: [key[0]], "newick": [to_newick(list(rows.itertuples(index=False, name=None)))]})

    kind = trees.schema[by].dataType.simpleString()
    return importable(trees).groupBy(by).applyInPandas(run, f"{by} {kind}, newick string")


def to_newick(nodes: list[Node]) -> str:
    """Newick text; children in order of name.  A stack holds what is still to be written, so depth does not matter."""
    children: dict[str | None, list[Node]] = defaultdict(list)
    for x in sorted(nodes, key=lambda x: x[0], reverse=True):
        children[x[1]].append(x)
    plain = re.compile(r"[^(),:;'\s][^(),:;']*")
    quoted = lambda name: name if plain.fullmatch(name) else "'" + name.replace("'", "''") + "'"
    out: list[str] = []
    stack: list[Node | str] = [children[None][0]]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        mark = f"{quoted(x[0])}:{x[4]:.6f}"
        if not children[x[0]]:
            out.append(mark)
            continue
        stack.append(")" + mark)
        for k, c in enumerate(children[x[0]]):  # the last by name lies deepest
            stack += [c, ","] if k + 1 < len(children[x[0]]) else [c]
        out.append("(")
    return "".join(out) + ";"


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor, node, steps, length): every node with each node above it and itself.

    By doubling: with jumps of 1, 2, 4, ... steps, a tree of any depth takes as many rounds as the logarithm of its
    depth.  Every round is written to the checkpoint folder.  A loop among the parents raises an error.
    """
    jump = tree.where("parent IS NOT NULL").select("node", F.col("parent").alias("to"), F.lit(1).alias("steps"), F.col("branch_length").cast("double").alias("length"))
    jump = stored(jump)
    above = tree.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("steps"), F.lit(0.0).alias("length"))
    total = lambda a, b: (F.col(a) + F.col(b)).alias(a)
    left, before = jump.count(), None
    while left:
        if left == before:  # of a tree, fewer nodes have a node twice as far above them
            raise ValueError("the parents of a tree form a loop")
        on = jump.select(F.col("node").alias("ancestor"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("length").alias("_length"))
        further = above.join(on, "ancestor").select(F.col("_to").alias("ancestor"), "node", total("steps", "_steps"), total("length", "_length"))
        above = stored(above.unionByName(further))
        jump = stored(jump.join(on.withColumnRenamed("ancestor", "to"), "to").select("node", F.col("_to").alias("to"), total("steps", "_steps"), total("length", "_length")))
        left, before = jump.count(), left
    return above


def leaves_under(tree: DataFrame) -> DataFrame:
    """(node, leaf) for every node."""
    leaf = tree.where("is_leaf").select(F.col("node").alias("leaf"))
    return closure(tree).join(leaf, F.col("node") == F.col("leaf")).select(F.col("ancestor").alias("node"), "leaf")


def rank_intervals(tree: DataFrame) -> DataFrame:
    """node, first_rank, last_rank: the ranks at which a node is a group of its own.

    Rank r has r groups; going to r + 1 splits inner node r.  So a node lives from one past its
    parent's number to its own number; a leaf to the number of leaves.
    """
    up = tree.select(F.col("node").alias("parent"), F.col("inner_no").alias("up_no"))
    leaves = tree.agg(F.count_if("is_leaf").alias("n"))
    joined = tree.join(up, "parent", "left").crossJoin(F.broadcast(leaves))  # one row
    return joined.select("node", (F.coalesce("up_no", F.lit(0)) + 1).alias("first_rank"), F.coalesce("inner_no", "n").cast("int").alias("last_rank"))


def assignment(tree: DataFrame, ranks: list[int] | None = None) -> DataFrame:
    """rank, grp (from 1, by node name), node; custom ranks always include 1, and 0 is an error."""
    if ranks is not None and min(ranks) < 1:
        raise ValueError("ranks start at 1")
    spans = rank_intervals(tree).where("first_rank <= last_rank")
    rows = spans.select(F.explode(F.sequence("first_rank", "last_rank")).alias("rank"), "node")
    if ranks is not None:
        rows = rows.where(F.col("rank").isin(sorted({1, *ranks})))
    return rows.withColumn("grp", F.row_number().over(Window.partitionBy("rank").orderBy("node")))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: a list for small n, beyond it the asymptotic series, which is exact to the last bits there."""
    few = list(accumulate((1 / k for k in range(1, 33)), initial=0.0))
    x = n.cast("double")
    series = F.ln(x) + EULER + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(n < len(few), F.get(F.array(*map(F.lit, few)), n.cast("int"))).otherwise(series)


def lives(tree: DataFrame, ranks: list[int] | None = None) -> DataFrame:
    """node, lo, hi, weight: the run of ranks at which a node is a group of its own, and the sum of 1/rank over them.

    Nothing is exploded: the weight is a difference of two harmonic numbers.  With chosen ``ranks`` (1 is always among
    them), lo and hi count those in order.
    """
    if ranks is not None and min(ranks) < 1:
        raise ValueError("ranks start at 1")
    spans = rank_intervals(tree).where("first_rank <= last_rank")
    first, last = F.col("first_rank"), F.col("last_rank")
    if ranks is None:
        return spans.select("node", first.alias("lo"), last.alias("hi"), (harmonic(last) - harmonic(first - 1)).alias("weight"))
    listed = F.array(*[F.lit(r) for r in sorted({1, *ranks})])
    inside = F.filter(listed, lambda r: (r >= first) & (r <= last))
    lo = F.size(F.filter(listed, lambda r: r < first)) + 1
    weight = F.aggregate(inside, F.lit(0.0), lambda s, r: s + 1 / r)
    return spans.where(F.size(inside) > 0).select("node", lo.alias("lo"), (lo + F.size(inside) - 1).alias("hi"), weight.alias("weight"))


def node_weights(tree: DataFrame, ranks: list[int] | None = None) -> DataFrame:
    """node, weight: sum of 1/r over the ranks at which the node lives."""
    return lives(tree, ranks).select("node", "weight")


def from_root(tree: DataFrame) -> DataFrame:
    """node, distance and number of steps from the root: jumps double until all have come to a root.

    One row for each node in each round, also in a tree that is one long line.  Nodes with a parent that is not in
    the table do not appear; a loop among the parents raises an error.
    """
    rooted = F.col("parent").isNull()
    length = F.when(rooted, 0.0).otherwise(F.col("branch_length").cast("double"))
    jump = stored(tree.select("node", F.col("parent").alias("to"), F.when(rooted, 0).otherwise(1).alias("level"), length.alias("distance")))
    left, before = jump.where("to IS NOT NULL").count(), None
    while left:
        if left == before:
            raise ValueError("the parents of a tree form a loop")
        on = jump.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("level").alias("_level"), F.col("distance").alias("_distance"))
        total = [(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("level", "distance")]
        further = jump.join(on, "to").select("node", F.col("_to").alias("to"), *total)
        jump = stored(jump.where("to IS NULL").unionByName(further))
        left, before = jump.where("to IS NOT NULL").count(), left
    return jump.select("node", F.round("distance", 9).alias("distance"), "level")


def top_down(tree: DataFrame) -> DataFrame:
    """node, distance from the root, place in the order (distance, name)."""
    return numbered(from_root(tree).drop("level"), "place", "distance", "node")


def bottom_up(tree: DataFrame) -> DataFrame:
    """node, distance from the root, place: from the farthest to the nearest, a parent only after its first child.

    Of the nodes that may come next (all leaves, and parents of what has come) the farthest comes, by name on a tie.
    A node's key is its place by (-distance, name), a number.  On each way up from a leaf some node has the largest key; a node comes
    together with the least of those over the leaves below it, and of the nodes that come with one key, which all
    stand above its owner, the deeper comes first.  These least largest keys are gathered by doubling jumps, so no
    task walks a tree, and lengths may be zero or negative.  Inner nodes without a leaf below them do not appear.
    """
    far = numbered(from_root(tree).withColumn("near", -F.col("distance")), "key", "near", "node").drop("near")
    keyed = stored(tree.select("node", "parent", "is_leaf").join(far, "node"))
    above = keyed.select(F.col("node").alias("parent"), F.col("key").alias("most"))
    jump = stored(keyed.join(above, "parent").select("node", F.col("parent").alias("to"), "most"))
    least = stored(keyed.where("is_leaf").select("node", F.col("key").alias("least")))
    while not jump.isEmpty():
        reached = jump.join(least, "node").select(F.col("to").alias("node"), F.greatest("least", "most").alias("least"))
        least = stored(least.unionByName(reached).groupBy("node").agg(F.min("least").alias("least")))
        on = jump.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("most").alias("_most"))
        jump = stored(jump.join(on, "to").select("node", F.col("_to").alias("to"), F.greatest("most", "_most").alias("most")))
    rows = keyed.join(least, "node").select("node", "distance", "least", (-F.col("level")).alias("depth"))
    return numbered(rows, "place", "least", "depth").select("node", "distance", "place")


def annotate(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """leaf, annotation: its own label, else that of the nearest node above it with labelled leaves.

    Several labels there give 'AMBIGUOUS:a,b'.
    """
    up = closure(tree)
    leaf = tree.where("is_leaf").select(F.col("node").alias("leaf"))
    above = up.join(leaf, up["node"] == leaf["leaf"]).select("leaf", "ancestor", "steps")
    known = above.join(labels.select("leaf", "label").dropna(), "leaf").groupBy("ancestor").agg(F.array_sort(F.collect_set("label")).alias("found"))
    best = above.join(known, "ancestor").groupBy("leaf").agg(F.min_by("found", "steps").alias("found"))
    text = F.when(F.size("found") == 1, F.col("found")[0]).otherwise(F.concat(F.lit("AMBIGUOUS:"), F.array_join("found", ",")))
    return best.select("leaf", text.alias("annotation"))


def by_rank(tree: DataFrame) -> DataFrame:
    """rank, node: the nodes that are the groups of each rank, one more at each rank."""
    return assignment(tree).select("rank", "node")
