"""Work on all pairs is done inside tiles: values against plain Python, and tiles spread over tasks."""

import itertools
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.operators import compare, distance, frequency, pairs, prediction, ranking, structure

SCORES = [[random.Random(7 * a + b).choice([-2.0, 0.0, 1.0, 3.0]) for b in range(4)] for a in range(4)]  # not symmetric
GAP = 3


def alignment(n, width=7):
    rng = random.Random(n)
    return {k: [rng.randrange(4) for _ in range(width)] for k in rng.sample(range(1000), n)}


def packed(spark, rows):
    return spark.createDataFrame(list(rows.items()), "seq_idx bigint, codes array<int>")


@pytest.mark.parametrize("block", [4, 1024])
def test_distances_of_pairs_equal_plain_sums(spark, monkeypatch, block):
    monkeypatch.setattr(distance, "BLOCK", block)
    rows = alignment(19)
    table = packed(spark, rows)
    every = list(itertools.combinations(sorted(rows), 2))
    got = {(r["i"], r["j"]): r["d"] for r in distance.substitution_distance(table, SCORES, GAP).collect()}
    assert sorted(got) == every
    for i, j in every:
        cells = [(a, b) for a, b in zip(rows[i], rows[j], strict=True) if GAP not in (a, b)]
        most = max(sum(SCORES[a][a] for a, _ in cells), sum(SCORES[b][b] for _, b in cells))
        assert got[i, j] == pytest.approx(1 - sum(SCORES[a][b] for a, b in cells) / most if most else 1.0)
    cut = distance.similarity_threshold(SCORES)
    for r in distance.trace_similarity(table, SCORES, GAP).collect():
        a, b = rows[r["i"]], rows[r["j"]]
        short = min(sum(x != GAP for x in s) for s in (a, b))
        assert r["identity"] == pytest.approx(sum(x == y != GAP for x, y in zip(a, b, strict=True)) / short)
        assert r["pseudo_distance"] == pytest.approx(1 - sum(GAP not in (x, y) and SCORES[x][y] >= cut for x, y in zip(a, b, strict=True)) / short)


def test_identity_is_counted_without_listing_pairs(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 5)
    rows = alignment(23)
    table = packed(spark, rows | {2000: [1, None, 0, 0, 0, 0, 0], 2001: [1, 2]})
    listed = distance.identity_distance(table)
    want = {(r["d"], r["n"]) for r in listed.groupBy("d").agg(F.count("*").alias("n")).collect()}
    got = distance.identity_counts(table).groupBy("d").agg(F.sum("n").alias("n")).collect()
    assert {(r["d"], r["n"]) for r in got} == want
    assert sum(n for d, n in want if d is None) == 23 + 24


def test_status_at_two_columns_needs_no_grouping_of_pairs(spark):
    table = packed(spark, alignment(17)).withColumn("node", F.lit("root"))
    want = frequency.pair_status(frequency.match_status(table), 2, 5)
    got = frequency.pair_status_at(table, 2, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_rows_of_the_sets_meet(spark, monkeypatch):
    rows = alignment(40)
    table = packed(spark, rows).withColumn("node", F.lit("root"))
    ids = sorted(rows)
    a, b = set(ids[::3]), set(ids[::4])  # some rows are in both
    sets = [spark.createDataFrame([(k,) for k in s] * 2, "seq_idx bigint") for s in (a, b)]
    met, tiled = [], pairs.tiled
    monkeypatch.setattr(frequency, "tiled", lambda cells, *more: met.append({r[0] for r in cells.select("seq_idx").collect()}) or tiled(cells, *more))
    both = list(itertools.combinations(ids, 2))
    status = lambda found: sorted((p, s, t, 1 if rows[s][p] == rows[t][p] else -1) for s, t in found for p in range(7))
    got = [sorted(map(tuple, f(table, *use).select("pos", "s", "t", "status").collect())) for f, use in ((frequency.triangle, sets[:1]), (frequency.rectangle, sets))]
    assert got[0] == status((s, t) for s, t in both if s in a and t in a)
    assert got[1] == status((s, t) for s, t in both if s in a and t in b or s in b and t in a)
    assert met == [a, a | b]


@pytest.mark.parametrize("ordered", [7, 4096])
def test_codes_of_ordered_rows_are_counted_without_pairs(spark, monkeypatch, small, ordered):
    from strandlake import queries

    monkeypatch.setattr(frequency, "ORDERED", ordered)
    rows = alignment(40)
    rows[2000] = rows[min(rows)][:3]  # a shorter one meets the others where it has columns
    want = {}
    for s, t in itertools.combinations(sorted(rows), 2):
        for p, (a, b) in enumerate(zip(rows[s], rows[t], strict=False)):
            want[p, a, b] = want.get((p, a, b), 0) + 1
    got = frequency.ordered_counts(packed(spark, rows).withColumn("node", F.lit("root"))).collect()
    assert {(r["pos"], r["a"], r["b"]): r["cnt"] for r in got} == want

    def listed(*args, **more):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(distance, "row_pairs", listed)
    assert queries.QUERIES["substitution_table"](spark, small).count() > 0


def test_tiles_are_not_put_together_by_their_size(spark):
    table = packed(spark, alignment(40))
    assert distance.row_pairs(table).rdd.getNumPartitions() == 2  # spark.sql.shuffle.partitions of the tests


def chain(spark, n, lost=()):
    rng = random.Random(n)
    atoms = [("A", k, name, *(rng.uniform(-6, 6) for _ in "xyz")) for k in range(n) if k not in lost for name in ("CA", "CB", "X")[: 1 + k % 3]]
    return spark.createDataFrame(atoms, "chain string, resno int, atom_name string, x double, y double, z double")


@pytest.mark.parametrize("size", [4, 512])
def test_frame_from_atoms_equals_frame_joined_with_distances(spark, monkeypatch, size):
    monkeypatch.setattr(structure, "RESIDUES", size)
    atoms = chain(spark, 17, lost=(3, 8))
    spots = spark.createDataFrame([("A", k, "ACDE"[k % 4]) for k in range(19)], "query string, pos int, aa string")
    mapped = spots.where("pos % 5 <> 1").select("query", "pos", F.least("pos", F.lit(14)).alias("resno"))  # 14 more than once, 3 and 8 without atoms
    far = structure.residue_distances(atoms).withColumnRenamed("chain", "query")
    want = structure.pair_frame(spots, mapped, far, 4.0)
    got = structure.atom_frame(spots, mapped, atoms, 4.0)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 19 * 18 // 2


def test_tiles_of_a_frame_are_runs_listed_in_order(spark, monkeypatch):
    monkeypatch.setattr(structure, "RESIDUES", 8)
    atoms = chain(spark, 41, lost=(3,))
    spots = spark.createDataFrame([("A", k, "ACDE"[k % 4]) for k in range(41)], "query string, pos int, aa string")
    mapped = spots.select("query", "pos", F.col("pos").alias("resno"))
    parts = structure.atom_frame(spots, mapped, atoms, 4.0).select("pos_i", "pos_j").rdd.glom().collect()
    rows = [r for part in parts for r in part]
    assert sorted(map(tuple, rows)) == list(itertools.combinations(range(41), 2))
    # runs of 8 positions, the last of 1: a tile lists the pairs of a position together, so that no run is met again
    runs = [k for part in parts for k, _ in itertools.groupby((r["pos_i"], r["pos_j"] // 8) for r in part)]
    assert len(runs) == len(set(runs))
    one = structure.atom_frame(spots.where("pos = 5"), mapped, atoms, 4.0)
    assert one.count() == 0


def test_distances_within_a_cutoff_are_those_of_all(spark):
    atoms = chain(spark, 21)
    every = structure.residue_distances(atoms)
    for below, where in ((False, "distance <= 4"), (True, "distance < 4")):
        want = sorted(map(tuple, every.where(where).collect()))
        assert want and sorted(map(tuple, structure.residue_distances(atoms, within=4.0, below=below).collect())) == want
    assert every.rdd.getNumPartitions() == 2  # not put together by the small size of the atoms


def test_scores_in_the_frame_rank_as_joined_ones_do(spark):
    frame = spark.createDataFrame([(i, j, float((3 * i + 5 * j) % 7)) for i, j in itertools.combinations(range(12), 2)], "pos_i int, pos_j int, score double")
    scores = ranking.ranked(frame, "min").withColumn("coverage", F.round("coverage", 9))
    want = prediction.with_predictions(frame.drop("score"), scores, ["pos_i", "pos_j"])
    got = prediction.scored(frame).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_sums_over_ranges(spark):
    rows = spark.createDataFrame([(k % 2, float(k), k) for k in range(50)] + [(0, None, 7)], "g int, v double, n int")
    got = {(r["g"], r["v"]): r["s"] for r in pairs.running(rows, "v", ["g"], {"s": "n"}).collect()}
    assert got == {(0, None): 7} | {(k % 2, float(k)): sum(range(k % 2, k + 1, 2)) + (7 if k % 2 == 0 else 0) for k in range(50)}


def test_copies_of_rows_are_not_paired(spark):
    rng = random.Random(4)
    kinds = [[rng.randrange(2) for _ in range(10)] for _ in range(12)]
    table = packed(spark, {k: rng.choice(kinds) for k in range(60)})
    distinct = distance.distinct_rows(table)
    assert distinct.count() <= 12 and distinct.agg(F.sum("copies")).first()[0] == 60
    assert distance.near_rows(distinct, 0.8).count() <= 66
    want = distance.effective_size(distance.near_rows(table, 0.8), table, 0.8).first()[0]
    assert distance.effective_size_of_distinct(distance.near_rows(distinct, 0.8), distinct, 0.8).first()[0] == pytest.approx(want)
    want = sorted(map(tuple, distance.redundancy_filter(distance.near_rows(table, 0.8), table, 0.8).collect()))
    assert want and sorted(map(tuple, distance.redundancy_filter(distance.near_rows(distinct, 0.8), distinct, 0.8).collect())) == want
    none = spark.createDataFrame([(1, None), (2, None)], "seq_idx bigint, codes array<int>")
    assert distance.distinct_rows(none).count() == 2


@pytest.mark.parametrize("size", [4, 1024])
def test_frames_are_counted_inside_tiles(spark, monkeypatch, size):
    monkeypatch.setattr(structure, "SUMMED", size)
    atoms = chain(spark, 37, lost=(3, 8))
    atoms = atoms.union(atoms.selectExpr("'B'", "resno + 1000", "atom_name", "CASE WHEN resno <> 9 THEN x END", "y", "z"))
    spots = spark.createDataFrame([(c, k, "ACDE"[k % 4]) for c, o in (("A", 0), ("B", 1000)) for k in range(o, o + 39)], "query string, pos int, aa string")
    mapped = spots.where("pos % 5 <> 1").select("query", "pos", F.expr("least(pos, IF(query = 'A', 30, 1030))").alias("resno"))
    values = ["query", "separation", "category", "contact"]
    want = structure.atom_frame(spots, mapped, atoms, 4.0).groupBy(*values).agg(F.count("*").alias("n"))
    got = structure.frame_counts(spots, mapped, atoms, 4.0)
    assert got.where("contact").count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert structure.frame_counts(spots.limit(0), mapped, atoms, 4.0).count() == 0


@pytest.mark.parametrize("biased", [True, False])
def test_contacts_are_summed_inside_tiles(spark, monkeypatch, biased):
    monkeypatch.setattr(structure, "SUMMED", 6)
    atoms = chain(spark, 41)
    first = spark.createDataFrame([(k, k * 7 % 5) for k in range(0, 45, 2)], "res int, cut int")  # some never seen, some without atoms
    contacts = structure.contact_weights(structure.residue_distances(atoms, within=structure.TOUCH, below=True), biased)
    sums = structure.contact_sums(atoms, first, biased)
    assert tuple(structure.summed_background(sums).first()) == pytest.approx(tuple(structure.clustering_background(contacts).first()))
    want = sorted(map(tuple, structure.clustering_curve(first, contacts, 45).collect()))
    got = sorted(map(tuple, structure.summed_curve(first, atoms, 45, biased).collect()))
    assert len(got) == 5 and [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2:] == pytest.approx(w[2:]) for g, w in zip(got, want, strict=True))
    whole = structure.contact_sums(atoms.limit(0), first, biased)
    assert tuple(structure.summed_background(whole).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("name", ["separation_categories", "auroc_by_category_set", "clustering_curve", "clustering_background"])
def test_queries_that_count_pairs_list_none(spark, monkeypatch, small, name):
    from strandlake import queries

    def listed(*args, **more):
        raise AssertionError("pairs are listed")

    for f in ("residue_distances", "atom_frame"):
        monkeypatch.setattr(structure, f, listed)
    assert queries.QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize("name", ["evaluation_frame", "relevant_by_coverage", "key_residue_recovery"])
def test_queries_that_judge_pairs_store_them_once(spark, monkeypatch, small, name):
    from strandlake import queries

    sizes, stored = [], pairs.stored

    def counted(df):
        got = stored(df)
        sizes.append(got.count())
        return got

    for module in (prediction, ranking):
        monkeypatch.setattr(module, "stored", counted)
    queries.QUERIES[name](spark, small).count()
    listed = queries.QUERIES["pair_frame"](spark, small).count()
    assert sum(n >= 0.5 * listed for n in sizes) == 1


@pytest.mark.parametrize("name", ["residue_coverage_curve", "pair_to_single_median", "pair_to_single_top"])
def test_queries_that_rank_distances_list_no_pairs(spark, monkeypatch, small, name):
    from strandlake import queries

    def listed(*args, **more):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(structure, "atom_frame", listed)
    assert queries.QUERIES[name](spark, small).count() > 0


def test_ranks_among_scores_in_bins(spark):
    rng = random.Random(4)
    values = [rng.randrange(60) / 7 for _ in range(500)] + [float("nan"), 1e6, -3.0]
    scores = spark.createDataFrame([(v,) for v in values], "score double")
    order = sorted({round(v, 9) for v in values if v == v}) + [float("nan")]
    got = ranking.ranks_of(scores, scores, 503).collect()
    assert len(got) == len(order)
    assert all(order[r["rank"] - 1] == r["score"] or r["score"] != r["score"] and r["rank"] == len(order) for r in got)


def test_least_distances_with_even_and_uneven_residues():
    rng = random.Random(6)
    for most in (1, 3, 40):  # 40: one large residue among small ones
        atoms = [[{c: rng.uniform(-5, 5) for c in "xyz"} for _ in range(k)] for k in (most, 2, 1, 2, 1, 1, 2)]
        table = pa.table({"p": pa.array([*atoms, None])})
        ((_, d),) = structure._least(table, table)
        for i, p in enumerate(atoms):
            assert list(d[i, :7]) == pytest.approx([min(math.dist(list(u.values()), list(v.values())) for u in p for v in q) for q in atoms])
        assert all(math.isnan(x) for x in d[7])


@pytest.mark.parametrize("nulls", [False, True])
def test_copies_of_near_rows_are_listed_after_they_met(spark, monkeypatch, nulls):
    monkeypatch.setattr(distance, "COPIES", 3)
    rng = random.Random(11)
    kinds = [[rng.randrange(2) for _ in range(6)] for _ in range(9)] + ([[None, 1, 0, 1, 0, 1]] if nulls else [])
    table = packed(spark, {k: rng.choice(kinds) for k in range(50)} | {99: None})
    for least in (0.8, 1.0):
        met = []
        with monkeypatch.context() as m:
            m.setattr(distance, "tiled", lambda r, *a: met.append(r) or pairs.tiled(r, *a))
            got = sorted(map(tuple, distance.near_rows_and_copies(table, least).collect()))
        assert got and got == sorted(map(tuple, distance.near_rows(table, least).collect()))
        assert met[0].select("seq_idx").distinct().count() <= len(kinds)  # copies do not meet


def test_rows_that_differ_in_one_column_meet_without_others(spark):
    rng = random.Random(5)
    table = packed(spark, {k: [0] * 6 + [rng.randrange(10) for _ in range(4)] for k in range(300)})
    rows = {r["seq_idx"]: r["codes"] for r in table.collect()}
    want = sorted((i, j) for i, j in itertools.combinations(sorted(rows), 2) if sum(a != b for a, b in zip(rows[i], rows[j], strict=True)) <= 1)
    frame = distance.near_rows(table, 0.9)
    assert sorted((r["i"], r["j"]) for r in frame.collect()) == want
    assert "slice" in frame._jdf.queryExecution().analyzed().toString()  # keys without one column, not blocks


def test_larger_tables_are_joined_in_more_partitions(spark, monkeypatch):
    monkeypatch.setattr(compare, "JOINED", 100)
    rows = spark.range(1000).selectExpr("id % 90 * 3 AS a", "id % 70 * 5 AS b")
    got = compare.dense_positions(rows, "a", "b")
    assert got.rdd.getNumPartitions() == 10  # with 2 as spark.sql.shuffle.partitions
    place = {v: k for k, v in enumerate(sorted({3 * k for k in range(90)} | {5 * k for k in range(70)}))}
    found = got.collect()
    assert len(found) == 1000 and all((r["a_index"], r["b_index"]) == (place[r["a"]], place[r["b"]]) for r in found)


def test_transitions_are_counted_in_ranges_of_rows(spark, monkeypatch):
    rows = {k: [None if c == 3 else c for c in r] for k, r in alignment(60, 4).items()}
    table = packed(spark, rows).withColumn("node", F.explode(F.array(F.lit("root"), F.concat(F.lit("g"), F.col("seq_idx") % 3))))
    want = {}
    for node in ("root", "g0", "g1", "g2"):
        some = [rows[k] for k in sorted(rows) if node == "root" or k % 3 == int(node[1])]
        for (s, t), (i, j) in itertools.product(itertools.combinations(some, 2), itertools.combinations(range(4), 2)):
            key = (node, i, j, s[i], s[j], t[i], t[j])  # a null code is a code as well
            want[key] = want.get(key, 0) + 1
    for most in (7, 4096):
        monkeypatch.setattr(frequency, "ORDERED", most)
        got = {tuple(r)[:7]: r["cnt"] for r in frequency.pair_transitions(table).select("node", "pos_i", "pos_j", "a", "b", "c", "d", "cnt").collect()}
        assert got == want
    monkeypatch.setattr(frequency, "ORDERED", 7)
    same = packed(spark, {k: [1, 2] for k in range(70)}).withColumn("node", F.lit("root"))
    held = []
    monkeypatch.setattr(frequency, "stored", lambda t: held.append(pairs.stored(t)) or held[0])
    assert frequency.pair_transitions(same).first()["cnt"] == 70 * 69 // 2
    assert held[0].agg(F.max(F.size("rows"))).first()[0] <= 10  # no array of all rows
