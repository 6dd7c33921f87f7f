"""Hand-computed vectors and brute force for operators that the queries cannot pin down alone."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import alphabets, metrics
from strandlake.operators import columns, compare, dataset, distance, evaluation, frequency, pairs, prediction, ranking, structure, trace, tree
from strandlake.plans import presets
from strandlake.sources import reports, text
from strandlake.streaming import streams

BLOCK = ["MET---", "M-TREE", "M-FREE"]
CODES = alphabets.mapping(alphabets.EXTENDED_PROTEIN)
GAP = CODES["-"]


def block(spark, rows=BLOCK):
    frame = spark.createDataFrame(list(enumerate(rows)), "seq_idx bigint, seq string")
    return columns.encode(frame, CODES).drop("seq").withColumn("node", F.lit("root"))


def test_mapping_and_words():
    m = alphabets.mapping("ACGT", "T")
    assert m["A"] == 0 and m["-"] == m["."] == m["*"] == 3 and m["T"] == 4
    assert alphabets.multi_position("AB", 2) == ["AA", "AB", "BA", "BB"]
    assert alphabets.reverse(m)[3] == "-"
    with pytest.raises(ValueError):
        alphabets.letters_of("RNA")


def test_unknown_letter_raises(spark):
    with pytest.raises(Exception, match="unknown character"):
        block(spark, ["M1"]).collect()


def test_column_entropy_of_the_block(spark):
    cells = columns.residues(block(spark), "node")
    got = {r["pos"]: r["score"] for r in frequency.single_scores(cells, "plain_entropy").collect()}
    e = -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3))
    assert [round(got[p], 12) for p in range(6)] == [0.0] + [round(e, 12)] * 5


def test_identity_distance_counts_equal_gaps(spark):
    got = {(r["i"], r["j"]): r["d"] for r in distance.identity_distance(block(spark)).collect()}
    assert got[(1, 2)] == pytest.approx(1 / 6)


@pytest.mark.parametrize(
    "scores, order, ranks, cover",
    [
        ([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9], "min", [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]),
        ([0, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9], "min", [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10], [1, 2, 3, 4, 5, 7, 7, 8, 9, 10, 11]),
        ([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9], "min", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10], [1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 11]),
        ([9, 9, 1], "max", [1, 1, 2], [2, 2, 3]),
    ],
)
def test_rank_and_coverage(spark, scores, order, ranks, cover):
    frame = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "pos int, score double")
    got = sorted(ranking.ranked(frame, order).collect(), key=lambda r: r["pos"])
    assert [r["rank"] for r in got] == ranks
    assert [round(r["coverage"] * len(scores)) for r in got] == cover


def test_pairs_to_positions(spark):
    pairs = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 3, 4), (2, 4, 5), (3, 4, 6)], "pos_i int, pos_j int, rank int")
    got = sorted(ranking.pairs_to_positions(pairs, "Top").collect(), key=lambda r: r["pos"])
    assert [r["rank"] for r in got] == [1, 1, 2, 3] and [r["coverage"] for r in got] == [0.5, 0.5, 0.75, 1.0]
    with pytest.raises(ValueError):
        ranking.pairs_to_positions(pairs, "Best")


def test_ratio_edges(spark):
    frame = spark.createDataFrame([(2.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 3.0)], "mm double, m double")
    got = [r[0] for r in frame.select(metrics.ratio(F.col("mm"), F.col("m"))).collect()]
    assert got == [2.0, math.tan(math.pi / 2), 0.0, 0.0]
    with pytest.raises(ValueError):
        metrics.check("mismatch_diversity", 1)


def brute_transitions(rows):
    out = {}
    for i, j in itertools.combinations(range(len(rows[0])), 2):
        m, mm = [], []
        for s, t in itertools.combinations(range(len(rows)), 2):
            a, b = rows[s], rows[t]
            (m if (a[i] == b[i]) == (a[j] == b[j]) else mm).append((a[i], a[j], b[i], b[j]))
        depth = max(len(rows) * (len(rows) - 1) / 2, 1)
        ent = lambda x: -sum(x.count(k) / depth * math.log(x.count(k) / depth) for k in set(x))  # noqa: E731, B023
        out[(i, j)] = (len(m), len(mm), ent(m), ent(mm))
    return out


@pytest.mark.parametrize("rows", [BLOCK, ["MET---"], ["ACA", "AGA", "CGA", "CCC", "AGA", "GGA"]])
def test_transitions_against_brute_force(spark, rows):
    got = frequency.transition_scores(block(spark, rows)).collect()
    want = brute_transitions(rows)
    assert len(got) == len(want)
    for r in got:
        assert (r["m_cnt"], r["mm_cnt"], r["m_ent"], r["mm_ent"]) == pytest.approx(want[(r["pos_i"], r["pos_j"])])


def test_transition_order_matters(spark):
    forward = frequency.pair_transitions(block(spark, ["AA", "CA"])).collect()
    assert [(r["a"], r["c"]) for r in forward] == [(CODES["A"], CODES["C"])]


def random_distances(n, seed):
    d = np.random.default_rng(seed).random((n, n))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    return d


def leaves(nodes):
    below = {x[0]: {x[0]} if x[3] else set() for x in nodes}
    parent = {x[0]: x[1] for x in nodes}
    for x in nodes:
        if x[3]:
            p = x[1]
            while p:
                below[p].add(x[0])
                p = parent[p]
    return below


def test_upgma_heights_are_mean_leaf_distances():
    d = random_distances(9, 3)
    names = [f"s{i}" for i in range(9)]
    nodes = tree.agglomerate(d, names, "upgma_first")
    below = leaves(nodes)
    height = {x[0]: 0.0 for x in nodes}
    for x in nodes:
        if not x[3]:
            a, b = (c for c in nodes if c[1] == x[0])
            mean = np.mean([d[names.index(p), names.index(q)] for p in below[a[0]] for q in below[b[0]]])
            height[x[0]] = mean / 2
    for x in nodes:
        if x[1]:
            assert height[x[1]] - height[x[0]] == pytest.approx(x[4])


@pytest.mark.parametrize("method", ["upgma_first", "wpgma_last", "ward", "complete", "average"])
def test_inner_numbers_rise_away_from_the_root(method):
    nodes = tree.agglomerate(random_distances(12, 5), [f"s{i}" for i in range(12)], method)
    number = {x[0]: x[2] for x in nodes}
    assert sorted(n for n in number.values() if n) == list(range(1, 12))
    assert all(number[x[1]] < x[2] for x in nodes if x[1] and x[2])


def test_rank_intervals_equal_splitting_one_node_per_rank(spark):
    nodes = tree.agglomerate(random_distances(12, 7), [f"s{i}" for i in range(12)])
    frame = tree.tree_frame(spark, nodes)
    got = {}
    for r in tree.assignment(frame).collect():
        got.setdefault(r["rank"], set()).add(r["node"])
    children = {}
    for x in nodes:
        children.setdefault(x[1], []).append(x[0])
    live = {children[None][0]}
    for rank in range(1, 13):
        assert got[rank] == live
        split = f"Inner{rank}"
        if split in live:
            live = live - {split} | set(children[split])
    with pytest.raises(ValueError):
        tree.assignment(frame, [0, 2])
    assert {r["rank"] for r in tree.assignment(frame, [3]).select("rank").distinct().collect()} == {1, 3}


def test_newick_round_trip(spark):
    nodes = tree.agglomerate(random_distances(8, 9), [f"s{i}" for i in range(8)])
    text = spark.createDataFrame([("t", tree.to_newick(nodes))], "tree string, newick string")
    back = [(r["node"], r["parent"], r["inner_no"], r["is_leaf"], r["branch_length"]) for r in tree.newick_trees(text).collect()]
    assert sorted(map(tuple, map(sorted, leaves(nodes).values()))) == sorted(map(tuple, map(sorted, leaves(back).values())))
    assert {x[0]: round(x[4], 6) for x in back if x[3]} == {x[0]: round(x[4], 6) for x in nodes if x[3]}


def test_full_trace_equals_ranks_one_by_one(spark):
    rng = random.Random(4)
    rows = ["".join(rng.choice("ACD") for _ in range(5)) for _ in range(7)]
    packed = block(spark, rows).drop("node")
    got = {r["pos"]: r["score"] for r in presets.run(packed, GAP, presets.Settings("single", "plain_entropy")).collect()}
    d = np.array([[np.mean([a != b for a, b in zip(x, y, strict=True)]) for y in rows] for x in rows])
    nodes = tree.agglomerate(d, [str(i) for i in range(7)])
    below, live = leaves(nodes), {"Inner1"}
    want = dict.fromkeys(range(5), 1.0)
    for rank in range(1, 8):
        for node in live:
            for p in range(5):
                col = [rows[int(i)][p] for i in below[node]]
                want[p] += -sum(col.count(c) / len(col) * math.log(col.count(c) / len(col)) for c in set(col)) / rank
        split = f"Inner{rank}"
        if split in live:
            live = live - {split} | {x[0] for x in nodes if x[1] == split}
    assert got == pytest.approx({p: round(v, 9) for p, v in want.items()}, abs=1e-8)


def test_presets():
    assert presets.preset("entropy").gap_correction == 0.6
    assert presets.preset("transitions").pos_size == 2
    with pytest.raises(ValueError):
        presets.preset("other")
    with pytest.raises(ValueError):
        presets.Settings("single", "mutual_information")


@pytest.mark.parametrize("seed", range(3))
def test_redundancy_filter_equals_the_greedy_walk(spark, seed):
    rng = random.Random(seed)
    order = list(range(12))
    links = [(i, j, rng.random()) for i, j in itertools.combinations(order, 2)]
    frame = spark.createDataFrame(links, "i bigint, j bigint, d double")
    rows = spark.createDataFrame([(i,) for i in order], "seq_idx bigint")
    near = {}
    for i, j, d in links:
        if round(1 - d, 12) > 0.8:
            near.setdefault(i, set()).add(j)
            near.setdefault(j, set()).add(i)
    for query in (None, 5):
        got = sorted(r[0] for r in distance.redundancy_filter(frame, rows, 0.8, query).collect())
        assert got == sorted(distance.greedy_redundancy(order, near, query))


@pytest.mark.parametrize("biased", [True, False])
def test_clustering_background_equals_brute_force(spark, biased):
    rng = random.Random(8)
    rows = [("A", i, j, rng.random() * 8) for i, j in itertools.combinations(range(9), 2)]
    frame = spark.createDataFrame(rows, "chain string, res_i int, res_j int, distance double")
    edges = [(i, j, float(j - i) if biased else 1.0) for _, i, j, d in rows if d < structure.TOUCH]
    want = [0.0, 0.0, 0.0]
    for (a, b, w), (c, d, v) in itertools.product(edges, edges):
        want[2 - len({a, b} & {c, d})] += w * v
    got = structure.clustering_background(structure.contact_weights(frame, biased)).first()
    assert (got["case1"], got["case2"], got["case3"]) == pytest.approx(tuple(want))


def test_atom_choice_falls_back(spark):
    rows = [("A", 1, "N", 0.0, 0.0, 0.0), ("A", 1, "CA", 1.0, 0.0, 0.0), ("A", 2, "N", 5.0, 0.0, 0.0), ("A", 2, "CB", 7.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, "chain string, resno int, atom_name string, x double, y double, z double")
    got = [structure.residue_distances(atoms, m).first()["distance"] for m in ("Any", "CA", "CB")]
    assert got == [4.0, 4.0, 6.0]
    with pytest.raises(ValueError):
        structure.atoms_for(atoms, "CG")


def test_global_alignment_maps_around_a_gap():
    score = lambda a, b: 5.0 if a == b else -4.0
    total, pairs = structure.global_alignment("METREE", "MEEE", score, -10, -0.5)
    assert pairs[0] == (0, 0) and pairs[-1] == (5, 3) and len(pairs) == 4
    assert total == pytest.approx(5 * 4 - 10.5)


def test_auc_of_ties(spark):
    rows = spark.createDataFrame([("x", 3.0, 1), ("x", 2.0, 1), ("x", 2.0, 0), ("x", 1.0, 0)], "k string, score double, truth int")
    assert evaluation.auroc(rows, ["k"]).first()["auroc"] == pytest.approx(0.875)


def test_hypergeometric(spark):
    counts = spark.createDataFrame([(20, 7, 5, 3), (20, 7, 5, 0)], "population bigint, keys bigint, drawn bigint, overlap bigint")
    got = {r["overlap"]: r["p_value"] for r in evaluation.hypergeometric_sf(counts).collect()}
    want = sum(math.comb(7, k) * math.comb(13, 5 - k) for k in range(3, 6)) / math.comb(20, 5)
    assert got[3] == pytest.approx(want) and got[0] == pytest.approx(1.0)
    rows = [(500, 120, 60, 25), (500, 480, 60, 58), (40, 7, 5, 6), (4000, 2000, 900, 451)]
    large = spark.createDataFrame(rows, "population bigint, keys bigint, drawn bigint, overlap bigint")
    for r in evaluation.hypergeometric_sf(large).collect():
        n, k, d, x = r["population"], r["keys"], r["drawn"], r["overlap"]
        want = sum(math.comb(k, i) * math.comb(n - k, d - i) for i in range(x, min(k, d) + 1)) / math.comb(n, d)
        assert r["p_value"] == pytest.approx(want, rel=1e-9)


def test_fasta_keeps_marks_inside_headers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">seq1 x>y\nMET\n---\n>seq2\nM-TREE\n")
    got = sorted(text.read_fasta(spark, str(tmp_path / "a.fa")).collect(), key=lambda r: r["seq_idx"])
    assert [(r["seq_id"], r["seq"]) for r in got] == [("seq1", "MET---"), ("seq2", "M-TREE")]
    with pytest.raises(ValueError):
        text.require_query(text.read_fasta(spark, str(tmp_path / "a.fa")), "seq9")


def test_structure_lines(spark):
    lines = [
        "ATOM      1  N   MET A   1      11.104  13.207   2.100  1.00 20.00           N",
        "ATOM      2  CA  GLU A   2      12.560  13.329   2.285  1.00 20.00           C",
        "HETATM    3  O   HOH A   3      12.000  13.000   2.000  1.00 20.00           O",
        "DBREF  1ABC A    1   110  UNP    P12345   NAME_HUMAN       1    110",
    ]
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    atoms = text.atom_rows(rows)
    assert text.residue_sequence(atoms).collect()[0].asDict() == {"chain": "A", "length": 2, "seq": "ME"}
    ref = text.dbref_rows(rows).first()
    assert (ref["db"], ref["db_acc"], ref["seq_begin"], ref["db_seq_end"]) == ("UNP", "P12345", 1, 110)
    assert text.external_accessions(text.dbref_rows(rows)).first()["accession"] == "P12345"


def test_blast_xml(spark):
    xml = (
        "<BlastOutput><BlastOutput_iterations><Iteration><Iteration_query-def>q1</Iteration_query-def><Iteration_hits>"
        "<Hit><Hit_id>h1</Hit_id><Hit_hsps><Hsp><Hsp_evalue>0.01</Hsp_evalue><Hsp_identity>8</Hsp_identity><Hsp_align-len>10</Hsp_align-len><Hsp_hseq>MET</Hsp_hseq></Hsp>"
        "<Hsp><Hsp_evalue>0.5</Hsp_evalue><Hsp_identity>2</Hsp_identity><Hsp_align-len>9</Hsp_align-len><Hsp_hseq>MEE</Hsp_hseq></Hsp></Hit_hsps></Hit>"
        "</Iteration_hits></Iteration></BlastOutput_iterations></BlastOutput>"
    )
    got = text.blast_hits(spark.createDataFrame([(xml,)], "value string")).collect()
    assert [(r["query"], r["hit_id"], r["identities"]) for r in got] == [("q1", "h1", 8), ("q1", "h1", 2)]


def test_protein_list_is_strict(spark):
    ok = spark.createDataFrame([("1abcA",), ("",)], "value string")
    assert [(r["pdb_id"], r["chain"]) for r in text.protein_list(ok).collect()] == [("1abc", "A")]
    with pytest.raises(Exception, match="not a chain id"):
        text.protein_list(spark.createDataFrame([("abcd1",)], "value string")).collect()


def test_score_files(spark):
    rows = spark.createDataFrame([("2 1 0.5",), ("% note",), ("3 1 0.25",)], "value string")
    got = sorted(map(tuple, text.coupling_scores(rows).collect()))
    assert got == [(0, 1, 0.5), (0, 2, 0.25)]
    assert text.symmetric(text.coupling_scores(rows), "score").count() == 4


def test_frequency_file_round_trip(spark, tmp_path):
    counts = frequency.single_counts(columns.residues(block(spark), "node"))
    report = reports.frequency_report(counts, F.char(F.col("code") + 65))
    report.write.csv(str(tmp_path / "f"), sep="\t", header=True)
    back = text.frequency_csv(spark, str(tmp_path / "f"), 3)
    assert sorted((r["pos"], r["cnt"]) for r in back.collect()) == sorted((r["pos"], r["cnt"]) for r in counts.collect())
    with pytest.raises(ValueError):
        text.frequency_csv(spark, str(tmp_path / "f"), 4)


def test_existing_text_is_left_alone(spark, tmp_path):
    frame = spark.createDataFrame([("seq1", "MET")], "seq_id string, seq string")
    for _ in range(2):
        reports.write_text(reports.fasta_text(frame), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_empty_alignment(spark):
    empty = block(spark).limit(0)
    assert frequency.single_scores(columns.residues(empty, "node"), "plain_entropy").count() == 0
    assert frequency.transition_scores(empty).count() == 0
    assert distance.identity_distance(empty).count() == 0


def test_gap_checks_switch_on_size(spark):
    cells = columns.residues(block(spark))
    assert {r["seq_idx"] for r in columns.gap_evaluation(cells, GAP, size_cutoff=15, share_cutoff=0.4).collect() if r["keep"]} == {1, 2}
    assert columns.gap_evaluation(cells, GAP, size_cutoff=2).where("keep").count() == 3


def test_merge_is_a_monoid(spark):
    counts = frequency.single_counts(columns.residues(block(spark), "node"))
    one, two = counts.where("pos < 3"), counts.where("pos >= 3")
    assert sorted(frequency.merge(one, two).collect()) == sorted(frequency.merge(two, one).collect())
    assert sorted(frequency.merge(counts, counts.limit(0)).collect()) == sorted(frequency.merge(counts).collect())


def test_components_against_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    up = list(range(60))
    for _ in range(60):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["root"] for r in compare.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: up[n] for link in links for n in link}


def test_stream_equals_batch(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.col("source").alias("header"))
    stream = streams.stream_parquet(spark, f"{small}/documents*.parquet", spark.read.parquet(f"{small}/documents.parquet").schema)
    out = streams.filtered_records(stream.select("doc_id", F.col("source").alias("header")))
    q = out.writeStream.format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("kept").count() == dataset.usable_headers(docs).count()


def test_trace_counts_ranks_with_any_difference(spark):
    scores = spark.createDataFrame([("a", 0, 0.0), ("b", 0, 1.0), ("a", 1, 0.0), ("b", 1, 0.0)], "node string, pos int, score double")
    assigned = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "rank int, node string")
    got = {r["pos"]: r["score"] for r in trace.combine(scores, assigned, "identity").collect()}
    assert got == {0: 3.0, 1: 1.0}


# -- pairs in tiles, running sums, deep trees --------------------------------------------------------


def test_rows_meet_once_in_tiles(spark, monkeypatch):
    rows = spark.createDataFrame([(n, i, [i]) for n in "ab" for i in range(23)], "node string, seq_idx bigint, codes array<int>")
    for size in (4, 512):
        monkeypatch.setattr(distance, "tiled", lambda r, key, by, size=size: pairs.tiled(r, key, by, size))
        got = sorted((r["node"], r["i"], r["j"], r["a"][0], r["b"][0]) for r in distance.row_pairs(rows, "node").collect())
        assert got == [(n, i, j, i, j) for n in "ab" for i, j in itertools.combinations(range(23), 2)]
        assert distance.row_pairs(rows.where("node = 'a'").drop("node")).count() == 253


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_over_ranges(spark, descending):
    rng = random.Random(3)
    rows = [("x" if k % 3 else None, float(v), rng.randrange(5)) for k, v in enumerate(rng.sample(range(1000), 200))]
    frame = spark.createDataFrame(rows, "k string, v double, n bigint")
    got = {(r["k"], r["v"]): (r["s"], r["c"]) for r in pairs.running(frame.withColumn("one", F.lit(1)), "v", ["k"], {"s": "n", "c": "one"}, descending).collect()}
    for key in ("x", None):
        total = 0
        for c, (_, v, n) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1], reverse=descending), 1):
            total += n
            assert got[key, v] == (total, c)


def test_closure_of_a_deep_tree(spark):
    """A caterpillar of 150 leaves: deeper than a recursive query goes."""
    nodes = [("n0", None, 0.0, False)] + [(f"n{k}", f"n{k - 1}", 0.5, False) for k in range(1, 150)] + [(f"l{k}", f"n{k}", 1.0, True) for k in range(150)]
    frame = spark.createDataFrame([(n, p, None, leaf, b) for n, p, b, leaf in nodes], tree.TREE_NODE)
    got = tree.closure(frame)
    assert got.count() == 150 * 151 // 2 + sum(k + 2 for k in range(150))
    far = got.where("ancestor = 'n0' AND node = 'l149'").first()
    assert (far["steps"], far["length"]) == (150, pytest.approx(149 * 0.5 + 1))
    assert tree.leaves_under(frame).where("node = 'n100'").count() == 50
    loop = spark.createDataFrame([("a", "b", None, False, 1.0), ("b", "a", None, False, 1.0)], tree.TREE_NODE)
    with pytest.raises(ValueError, match="loop"):
        tree.closure(loop)


def slow_agglomeration(d, method):
    """Joins of pairs (sets of leaves, height), by looking at all pairs in each step."""
    n = len(d)
    work = {(i, j): float(d[i, j]) ** (2 if method == "ward" else 1) for j in range(n) for i in range(j)}
    sets, size, out = {i: {i} for i in range(n)}, dict.fromkeys(range(n), 1), []
    get = lambda a, b: work[min(a, b), max(a, b)]
    for _ in range(n - 1):
        live = [(a, b) for a, b in work if a in sets and b in sets]
        least = min(work[p] for p in live)
        near = [p for p in live if work[p] <= least + 1e-12]
        i, j = max(near, key=lambda p: (p[1], p[0])) if method == "wpgma_last" else min(near) if method == "upgma_first" else min(near, key=lambda p: (p[1], p[0]))
        least = work[i, j]
        out.append((frozenset(sets[i]), frozenset(sets[j]), (math.sqrt(least) if method == "ward" else least) / 2))
        for x in sets:
            if x in (i, j):
                continue
            a, b = get(i, x), get(j, x)
            if method == "wpgma_last":
                new = (a + b) / 2
            elif method == "complete":
                new = max(a, b)
            elif method == "ward":
                new = ((size[i] + size[x]) * a + (size[j] + size[x]) * b - size[x] * least) / (size[i] + size[j] + size[x])
            else:
                new = (size[i] * a + size[j] * b) / (size[i] + size[j])
            work[min(i, x), max(i, x)] = new
        sets[i] |= sets.pop(j)
        size[i] += size[j]
    return out


@pytest.mark.parametrize("method", ["upgma_first", "wpgma_last", "ward", "complete", "average"])
def test_agglomeration_equals_looking_at_all_pairs(method):
    for seed in range(6):
        d = random_distances(14, seed)
        if seed % 2:
            d = np.round(d * 4) / 4  # many ties
            np.fill_diagonal(d, 0)
        nodes = tree.agglomerate(d, [str(i) for i in range(14)], method)
        below, kids = leaves(nodes), {}
        for x in nodes:
            kids.setdefault(x[1], []).append(x[0])
        want = slow_agglomeration(d, method)
        for step, (a, b, _) in enumerate(want):
            node = f"Inner{13 - step}"
            assert {frozenset(map(int, below[c])) for c in kids[node]} == {a, b}


def test_bottom_up_waits_for_a_first_child(spark):
    nodes = [("root", None, 1, False, 0.0), ("a", "root", 2, False, 1.0), ("x", "a", None, True, 5.0), ("y", "a", None, True, 1.0), ("b", "root", 3, False, 0.0), ("z", "b", None, True, 0.0), ("w", "b", None, True, 0.0)]
    got = [r["node"] for r in tree.bottom_up(spark.createDataFrame(nodes, tree.TREE_NODE)).orderBy("place").collect()]
    assert got == ["x", "y", "a", "root", "w", "b", "z"]


def test_settings_of_a_trace_are_read(spark):
    with pytest.raises(ValueError, match="distance model"):
        presets.Settings(distance_model="other")
    with pytest.raises(ValueError, match="score table"):
        presets.Settings(distance_model="substitution")
    with pytest.raises(ValueError, match="polymer"):
        presets.Settings(polymer="RNA")
    rows = ["ACDA", "ACDC", "AAA-", "CCC-", "CCD-", "CAA-"]
    packed = block(spark, rows).drop("node")
    size = max(CODES.values()) + 1
    table = tuple(tuple(4.0 if a == b else 1.0 if abs(a - b) == 1 else -1.0 for b in range(size)) for a in range(size))
    got = {m: {r["pos"]: r["score"] for r in presets.run(packed, GAP, presets.Settings("single", "plain_entropy", distance_model=m, scores=table)).collect()} for m in ("substitution", "trace")}
    assert got["substitution"].keys() == got["trace"].keys() == set(range(4))
    pair = presets.Settings("pair", "plain_entropy", gap_correction=0.3)
    scores = {(r["pos_i"], r["pos_j"]): r["score"] for r in presets.run(packed, GAP, pair).collect()}
    assert len(scores) == 6
    share = {(r["pos_i"], r["pos_j"]): r["gap_fraction"] for r in columns.pair_gap_share(block(spark, ["A--", "C--", "ACA"]), GAP).collect()}
    assert share == {(0, 1): 0.0, (0, 2): 0.0, (1, 2): pytest.approx(2 / 3)}


def test_near_residues_equal_all_distances_within_the_cutoff(spark):
    rng = random.Random(4)
    rows = [(c, k // 3, f"A{k % 3}", *(rng.uniform(-9, 9) for _ in range(3))) for c in "AB" for k in range(60)]
    atoms = spark.createDataFrame(rows, "chain string, resno int, atom_name string, x double, y double, z double")
    want = {(r["chain"], r["res_i"], r["res_j"], round(r["distance"], 9)) for r in structure.residue_distances(atoms).where("distance <= 4").collect()}
    got = [(r["chain"], r["res_i"], r["res_j"], round(r["distance"], 9)) for r in structure.near_residues(atoms, 4.0).collect()]
    assert set(got) == want and len(got) == len(want)
    brute = {}
    for a, b in itertools.combinations(rows, 2):
        if a[0] == b[0] and a[1] != b[1]:
            key = (a[0], min(a[1], b[1]), max(a[1], b[1]))
            brute[key] = min(brute.get(key, 99.0), math.dist(a[3:], b[3:]))
    assert want == {(*k, round(v, 9)) for k, v in brute.items() if v <= 4}


def test_best_chain_is_the_one_that_scores_most(spark):
    sequences = spark.createDataFrame([("q", "METREE")], "query string, seq string")
    chains = spark.createDataFrame([("q", "A", "MEEE", [5, 6, 9, 10]), ("q", "B", "METREE", [1, 2, 3, 4, 5, 7]), ("q", "C", "METREE", [11, 12, 13, 14, 15, 16])], "query string, chain string, seq string, resnos array<int>")
    got = sorted((r["chain"], r["pos"], r["resno"]) for r in prediction.best_chain(sequences, chains).collect())
    assert got == [("B", 0, 1), ("B", 1, 2), ("B", 2, 3), ("B", 3, 4), ("B", 4, 5), ("B", 5, 7)]


def test_best_chain_without_equal_letters_leaves_no_worse_chain(spark):
    sequences = spark.createDataFrame([("q", "AA"), ("r", "A")], "query string, seq string")
    chains = spark.createDataFrame([("q", "X", "CC", [1, 2]), ("q", "Y", "AGGGGGGGG", [*range(1, 10)]), ("r", "Z", "A", [9])], "query string, chain string, seq string, resnos array<int>")
    assert list(map(tuple, prediction.best_chain(sequences, chains).collect())) == [("r", "Z", 5.0, 0, 9)]  # X scores -8, Y -12


def test_relevant_takes_one_limit(spark):
    frame = spark.createDataFrame([(0, 1, 5, 6, "Short", 0.5), (0, 2, 5, None, "Short", 0.25)], "pos_i int, pos_j int, res_i int, res_j int, category string, coverage double")
    assert prediction.relevant(frame, 10).count() == 1
    assert prediction.relevant(frame, 10, n=0).count() == 0
    with pytest.raises(ValueError):
        prediction.relevant(frame, 10, n=1, k=2)
    with pytest.raises(ValueError):
        prediction.position_coverage(frame, "Best")


def test_bad_methods_and_depths_raise(spark):
    counts = frequency.single_counts(columns.residues(block(spark), "node"))
    with pytest.raises(ValueError):
        frequency.with_depth(counts, -1)
    with pytest.raises(ValueError):
        text.score_file(spark.createDataFrame([("1 1 A",)], "value string"), "other")
    with pytest.raises(ValueError):
        distance.distances(block(spark), "other")
    assert alphabets.identity_matrix("AC") == {("A", "A"): 1.0, ("A", "C"): 0.0, ("C", "A"): 0.0, ("C", "C"): 1.0}


def test_checked_hits_raise(spark):
    frame = spark.createDataFrame([(0.5, 0.9), (0.99, 0.9)], "identity double, fraction double")
    with pytest.raises(Exception, match="breaks its thresholds"):
        dataset.checked_thresholds(frame, 0.7, 0.6, 1.0).collect()


def test_tables_in_files(spark, tmp_path):
    (tmp_path / "ranks.tsv").write_text("% note\nPosition\tRho\tRank 1 Entropy\tRank 2 Entropy\n1\t0.5\t0.25\t0.75\n")
    got = sorted((r["Position"], r["rank"], r["entropy"]) for r in text.rank_table(spark, str(tmp_path / "ranks.tsv")).collect())
    assert got == [(1, 1, 0.25), (1, 2, 0.75)]
    (tmp_path / "d.tsv").write_text("name\ta\tb\na\t0\t0.5\nb\t0.5\t0\n")
    assert sorted((r["i"], r["j"], r["d"]) for r in text.square_matrix(spark, str(tmp_path / "d.tsv")).collect())[1] == ("a", "b", 0.5)
    (tmp_path / "c.csv").write_text("i,A_i,j,A_j,fn,cn,segment_i,segment_j,probability\n3,A,1,C,0,0.5,x,y,0.9\n")
    assert text.read_couplings_csv(spark, str(tmp_path / "c.csv")).first().asDict() == {"i": 0, "j": 2, "cn": 0.5, "probability": 0.9}
    rows = spark.createDataFrame([("f", k, v) for k, v in enumerate(["Rank 1", "a", "Rank 2", "b"])], "f string, n int, value string")
    assert [r["table_no"] for r in text.stacked_tables(rows, "f", "n", "value", "Rank").orderBy("n").collect()] == [1, 1, 2, 2]
    flat = spark.createDataFrame([("ID x\nSQ   SEQUENCE 5 AA\n     MET RE\n//",)], "v string")
    assert flat.select(text.flat_file_sequence(F.col("v"))).first()[0] == "METRE"
    chains = spark.createDataFrame([("A", "ME", "MET", "M")], "chain string, seq string, unp_seq string, gb_seq string")
    assert text.chain_sequence(chains, "UNP").first()["seq"] == "MET"
    with pytest.raises(ValueError):
        text.chain_sequence(chains, "XYZ")
