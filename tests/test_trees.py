"""Agglomeration on the cluster, counts rolled up a tree, and runs of ranks, against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.operators import agglomerate, columns, frequency, rollup, trace, tree
from strandlake.schemas import TREE_NODE


def pairs_of(spark, d):
    i, j = np.triu_indices(len(d), 1)
    rows = spark.createDataFrame(pd.DataFrame({"seq_idx": np.arange(len(d))}))
    return spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "d": d[i, j]})), rows


def distances(kind, n, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "apart":
        x = rng.random((n, 3))
        return np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    x = rng.integers(0, 3, (n, 6 if kind == "ties" else 3))  # many equal distances; many copies
    return (x[:, None] != x).mean(-1)


def same_tree(got, want):
    got, want = sorted(map(tuple, got)), sorted(want)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert [x[4] for x in got] == pytest.approx([x[4] for x in want], abs=1e-9)


@pytest.mark.parametrize("kind", ["apart", "ties", "copies"])
@pytest.mark.parametrize("method", ["upgma_first", "wpgma_last", "ward"])
def test_rounds_on_the_cluster_give_the_tree_of_one_merge_at_a_time(spark, kind, method):
    d = distances(kind, 40)
    got = agglomerate.agglomerated(*pairs_of(spark, d), method, tail=12).collect()
    same_tree(got, tree.agglomerate(d, [str(k) for k in range(40)], method))


def test_pairs_wait_where_more_partners_tie_than_a_row_names(spark, monkeypatch):
    monkeypatch.setattr(agglomerate, "NAMED", 2)
    d = np.ones((7, 7)) - np.eye(7)
    got = agglomerate.agglomerated(*pairs_of(spark, d), "average", tail=4).collect()
    same_tree(got, tree.agglomerate(d, [str(k) for k in range(7)], "average"))


def test_trees_of_few_rows(spark):
    pairs = spark.createDataFrame([(4, 9, 0.5)], "i bigint, j bigint, d double")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "seq_idx bigint")
    assert sorted(map(tuple, agglomerate.agglomerated(pairs, rows(4, 9)).collect())) == [("4", "Inner1", None, True, 0.25), ("9", "Inner1", None, True, 0.25), ("Inner1", None, 1, False, 0.0)]
    assert list(map(tuple, agglomerate.agglomerated(pairs.limit(0), rows(4)).collect())) == [("4", None, None, True, 0.0)]
    assert agglomerate.agglomerated(pairs.limit(0), rows()).count() == 0
    with pytest.raises(ValueError):
        agglomerate.agglomerated(pairs, rows(4, 9), "median")


def caterpillar(n):
    nodes = [("Inner1", None, 1, False, 0.0)]
    for k in range(1, n):
        nodes.append((str(k - 1), f"Inner{k}", None, True, 1.0))
        nodes.append((f"Inner{k + 1}", f"Inner{k}", k + 1, False, 1.0) if k < n - 1 else (str(n - 1), f"Inner{k}", None, True, 1.0))
    return nodes


def trees(n):
    return {"agglomerated": tree.agglomerate(distances("ties", n), [str(k) for k in range(n)]), "caterpillar": caterpillar(n), "star": [("root", None, 1, False, 0.0)] + [(str(k), "root", None, True, 1.0) for k in range(n)]}


@pytest.fixture(scope="module")
def alignment(spark):
    rng = random.Random(5)
    rows = [(k, [rng.randrange(1 + c % 4) for c in range(7)]) for k in range(18)]
    return spark.createDataFrame(rows, "seq_idx bigint, codes array<int>")


def close(got, want, keys):
    got, want = ({tuple(r[k] for k in keys): [v for c, v in r.asDict().items() if c not in keys] for r in x.collect()} for x in (got, want))
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


@pytest.mark.parametrize("shape", ["agglomerated", "caterpillar", "star"])
def test_rolled_up_counts_equal_counts_of_copied_rows(spark, alignment, shape):
    nodes = tree.tree_frame(spark, trees(18)[shape])
    under = tree.leaves_under(nodes).select("node", F.col("leaf").cast("bigint").alias("seq_idx"))
    member = alignment.join(under, "seq_idx")
    single, pair = ["node", "pos"], ["node", "pos_i", "pos_j"]
    close(rollup.single_entropies(alignment, nodes, 3).drop("kinds"), frequency.single_scores(columns.residues(member, "node"), "plain_entropy"), single)
    close(rollup.pair_entropies(alignment, nodes, 3).drop("kinds"), frequency.pair_scores(member, columns.residues(member, "node"), "plain_entropy"), pair)
    kinds = rollup.pair_entropies(alignment, nodes, 4).select(*pair, (F.col("kinds") > 1).cast("double").alias("score"))
    close(kinds, frequency.pair_scores(member, columns.residues(member, "node"), "identity"), pair)
    shape_of = ["node", "pos_i", "pos_j", "m_cnt", "mm_cnt", "m_ent", "mm_ent"]
    close(rollup.pair_transition_scores(alignment, nodes, 3).select(shape_of), frequency.transition_scores(member).select(shape_of), pair)


@pytest.mark.parametrize("metric,size", [("identity", 1), ("plain_entropy", 1), ("normalized_mutual_information", 2), ("filtered_average_product_corrected_mutual_information", 2), ("mismatch_diversity", 2)])
@pytest.mark.parametrize("ranks", [None, [2, 5, 9]])
def test_tree_traces_equal_traces_over_given_groups(spark, alignment, metric, size, ranks):
    nodes = tree.tree_frame(spark, trees(18)["agglomerated"])
    under = tree.leaves_under(nodes).select("node", F.col("leaf").cast("bigint").alias("seq_idx"))
    member = alignment.join(under, "seq_idx").select("node", "seq_idx", "codes")
    want = trace.combine(trace.node_scores(member, columns.residues(member, "node"), metric, size), tree.assignment(nodes, ranks), metric)
    got = trace.combine(trace.rolled_scores(alignment, nodes, metric, size), tree.lives(nodes, ranks), metric)
    close(got, want, ["pos"] if size == 1 else ["pos_i", "pos_j"])


def test_work_grows_little_in_a_caterpillar(monkeypatch):
    n, added = 3000, 0
    paths = rollup.Paths([{"node": x[0], "parent": x[1]} for x in caterpillar(n)])
    added = sum(len(paths.under(o)) for _, way in paths.paths for _, others in way for o in others)
    assert added < 2 * n and len(paths.leaves) == n
    balanced = [{"node": str(k), "parent": str((k - 1) // 2) if k else None} for k in range(2047)]
    paths = rollup.Paths(balanced)
    assert sum(len(paths.under(o)) for _, way in paths.paths for _, others in way for o in others) == 1024 * 10 // 2


def test_malformed_trees_are_refused():
    for rows in ([("a", None), ("b", None)], [("a", None), ("b", "c"), ("c", "b")], []):
        with pytest.raises(ValueError):
            rollup.Paths([{"node": x, "parent": y} for x, y in rows])


def test_harmonic_numbers(spark):
    ns = [0, 1, 2, 31, 32, 33, 34, 100, 12345]
    got = spark.createDataFrame([(n,) for n in ns], "n int").select(tree.harmonic(F.col("n"))).collect()
    assert [r[0] for r in got] == pytest.approx([sum(1 / k for k in range(1, n + 1)) for n in ns], rel=1e-14)


def test_runs_of_ranks_equal_exploded_ranks(spark):
    nodes = tree.tree_frame(spark, trees(18)["agglomerated"])
    for ranks in (None, [4, 17]):
        want = tree.assignment(nodes, ranks).groupBy("node").agg(F.sum(1 / F.col("rank")).alias("w"), F.count("*").alias("n"))
        got = tree.lives(nodes, ranks).select("node", F.col("weight").alias("w"), (F.col("hi") - F.col("lo") + 1).alias("n"))
        close(got, want, ["node"])
    with pytest.raises(ValueError):
        tree.lives(nodes, [0])
    assert spark.createDataFrame([], TREE_NODE).count() == 0


def slow_bottom_up(nodes):
    """One node after another from a heap."""
    by_name = {x[0]: x for x in nodes}

    def far(name):
        x = by_name[name]
        return 0.0 if x[1] is None else far(x[1]) + x[4]

    key = {n: (-round(far(n), 9), n) for n in by_name}
    heap, seen, out = [key[x[0]] for x in nodes if x[3]], {x[0] for x in nodes if x[3]}, []
    while heap:
        heap.sort()
        out.append(heap.pop(0)[1])
        up = by_name[out[-1]][1]
        if up is not None and up not in seen:
            seen.add(up)
            heap.append(key[up])
    return out


@pytest.mark.parametrize("lengths", [(0.0, 1.0), (0.0, 0.0, 0.0, 1.0), (0.5, 1.0, 2.0), (-1.0, 0.0, 1.0)])
def test_traversals_match_a_heap(spark, lengths):
    """Lengths of zero, where a parent waits for its first child, and negative ones, where a parent is farther than its child."""
    rng = random.Random(len(lengths) + lengths.count(0.0))
    names = [f"n{k}" for k in rng.sample(range(100, 999), 60)]
    parent = {names[k]: names[rng.randrange(max(0, k - 6), k)] for k in range(1, 60)}
    inner = set(parent.values())
    nodes = [(n, parent.get(n), k + 1 if n in inner else None, n not in inner, rng.choice(lengths)) for k, n in enumerate(names)]
    frame = spark.createDataFrame(nodes, tree.TREE_NODE)
    assert [r["node"] for r in tree.bottom_up(frame).orderBy("place").collect()] == slow_bottom_up(nodes)
    down = tree.top_down(frame).orderBy("place").collect()
    assert [(r["distance"], r["node"]) for r in down] == sorted((r["distance"], r["node"]) for r in down)
    assert [r["place"] for r in down] == list(range(1, 61))


def test_traversals_of_a_long_line_and_of_no_tree(spark):
    nodes = [(f"n{k:04}", f"n{k - 1:04}" if k else None, k + 1 if k < 1500 else None, k == 1500, 0.0) for k in range(1501)]
    frame = spark.createDataFrame(nodes, tree.TREE_NODE)
    assert [r["node"] for r in tree.bottom_up(frame).orderBy("place").collect()] == [x[0] for x in reversed(nodes)]
    assert [r["node"] for r in tree.top_down(frame).orderBy("place").collect()] == [x[0] for x in nodes]
    assert tree.bottom_up(frame.limit(0)).count() == tree.top_down(frame.limit(0)).count() == 0
    loop = spark.createDataFrame([("a", "b", 1, False, 1.0), ("b", "a", 2, False, 1.0)], tree.TREE_NODE)
    with pytest.raises(ValueError, match="loop"):
        tree.top_down(loop)


def test_a_set_of_ties_beyond_a_thousand_is_merged_by_one_task(spark, monkeypatch):
    """Names of few letters: nearly all rows tie, which took a round for each pair."""
    n = 1100
    digits = np.array([[int(c) for c in f"{k:04d}"] for k in range(n)])
    d = (digits[:, None, :] != digits[None, :, :]).mean(axis=2)
    rounds = []
    monkeypatch.setattr(agglomerate, "_nearest", lambda *a: rounds.append(1) or [])
    got = agglomerate.agglomerated(*pairs_of(spark, d), "upgma_first").collect()
    merges = list(agglomerate.join_order(d.copy(), np.ones(n), "upgma_first"))
    assert not rounds and len(got) == 2 * n - 1
    want = agglomerate.tree_rows(merges, [str(k) for k in range(n)], "upgma_first")
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in want]


def test_square_of_rows_that_differ_in_their_last_bits():
    m = np.random.default_rng(1).random((1300, 1300))
    assert (agglomerate._square(iter(m), 1300) == np.minimum(m, m.T)).all()


@pytest.mark.parametrize("sizes", [(40, 3), (30, 25), (3, 40), (60, 1), (0, 5)])
@pytest.mark.parametrize("n", [3, 80])
def test_transitions_across_sets_are_counted_without_listing_pairs(monkeypatch, sizes, n):
    rng = np.random.default_rng(sum(sizes) + n)
    rows = rng.permutation(sum(sizes) * 3)[: sum(sizes)]
    mine, theirs = np.sort(rows[: sizes[0]]), np.sort(rows[sizes[0] :])
    g, h = rng.integers(0, n, len(mine)), rng.integers(0, n, len(theirs))
    listed = rollup._across(mine, g, theirs, h, n)
    monkeypatch.setattr(rollup, "PAIRS_LISTED", 0)
    counted = rollup._across(mine, g, theirs, h, n)
    assert [x.tolist() for x in counted] == [x.tolist() for x in listed]
    assert counted[1].sum() == len(mine) * len(theirs)


def test_distances_are_packed_by_row_before_they_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(agglomerate, "PACKED", 7)
    d = distances("apart", 9)
    got = {r["x"]: np.frombuffer(r["v"]) for r in agglomerate.distance_rows(pairs_of(spark, d)[0], list(range(9)), True).collect()}
    np.fill_diagonal(d, np.inf)
    assert sorted(got) == list(range(9)) and all((got[k] == d[k] ** 2).all() for k in got)
    assert agglomerate.distance_rows(pairs_of(spark, d)[0], list(range(5)), True).count() == 5  # rows that are not leaves take no part


@pytest.mark.parametrize("method", agglomerate.METHODS)
def test_copies_of_rows_are_merged_without_distances_of_their_own(spark, monkeypatch, method):
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 3, (9, 5))
    x = kinds[rng.integers(0, 9, 45)]
    d = (x[:, None] != x).mean(-1)
    want = tree.agglomerate(d, [str(k) for k in range(45)], method)
    met, sized = [], agglomerate.merge_rows
    monkeypatch.setattr(agglomerate, "merge_rows", lambda rows, n, *more: met.append(n) or sized(rows, n, *more))
    packed = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "seq_idx bigint, codes array<int>")
    for tail in (agglomerate.TAIL, 3):
        same_tree(agglomerate.identity_tree(packed, method, tail).collect(), want)
    assert met == [len(np.unique(x, axis=0))] * 2
