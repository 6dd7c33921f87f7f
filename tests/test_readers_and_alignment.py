"""Split FASTA files, the FASTA sink, Newick at any depth, wavefront alignment, near rows, exact signed ranks."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import distance, evaluation, structure, tree
from strandlake.plans import data_set
from strandlake.sources import reports, text

# -- FASTA ----------------------------------------------------------------------------------------


def whole_file(content):
    """(description, sequence) of the records of a text, read in one piece."""
    out = []
    for line in content.splitlines():
        if line.startswith(">"):
            out.append([line[1:].rstrip(), ""])
        elif out:
            out[-1][1] += "".join(line.split())
    return [tuple(x) for x in out]


def fasta(rng, n, end="\n"):
    rows = []
    for k in range(n):
        rows.append(f">s{k} about > that {'x' * rng.randrange(30)}")
        rows += ["".join(rng.choice("ACDEF-") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(4))]
    return end.join(rows) + end * rng.randrange(2)


@pytest.mark.parametrize("size", [7, 64, 100, 333, 1 << 20])
def test_a_file_read_by_many_tasks_equals_the_whole_file(spark, tmp_path, size):
    rng = random.Random(size)
    contents = {"a.fa": fasta(rng, 60), "b.fa": fasta(rng, 25, "\r\n"), "c.fa": "a note\nand more\n" + fasta(rng, 12), "d.fa": "", "e.fa": ">only\nMET", "f.fa": "no record\n"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = text.read_fasta(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, content in contents.items():
        rows = sorted((r for r in got if r["aln_id"].endswith(name)), key=lambda r: r["seq_idx"])
        assert [r["seq_idx"] for r in rows] == list(range(len(rows)))
        assert [(r["description"], r["seq"]) for r in rows] == whole_file(content)
        assert all(r["seq_id"] == r["description"].split()[0] for r in rows)


@pytest.mark.parametrize("files", [1, 5])
def test_fasta_sink_keeps_the_order_of_rows(spark, tmp_path, files):
    rows = [(f"aln{k % 3}", k // 3, f"s{k}", "ACD" * (k % 4 + 1)) for k in range(90)]
    frame = spark.createDataFrame(random.Random(files).sample(rows, 90), "aln_id string, seq_idx int, seq_id string, seq string").repartition(7)
    reports.write_fasta(frame, str(tmp_path / "out"), files)
    for aln in ("aln0", "aln1", "aln2"):
        parts = sorted((tmp_path / "out" / f"aln_id={aln}").glob("part-*"))
        content = "".join(p.read_text() for p in parts)
        assert whole_file(content) == [(r[2], r[3]) for r in sorted(rows) if r[0] == aln]
        assert len(parts) == 1 or files > 1
    back = text.read_fasta(spark, str(tmp_path / "out" / "*"))
    assert back.count() == 90
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        reports.write_fasta(frame, str(tmp_path / "out"), files)


def test_a_failed_write_leaves_nothing_to_read(spark, tmp_path):
    bad = F.when(F.col("seq_idx") == 40, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.lit("ACD"))
    frame = spark.range(80).select(F.lit("a").alias("aln_id"), F.col("id").cast("int").alias("seq_idx"), F.lit("s").alias("seq_id")).withColumn("seq", bad)
    with pytest.raises(Exception, match="broken row"):
        reports.write_fasta(frame, str(tmp_path / "out"), 3)
    assert not list((tmp_path / "out").glob("aln_id=*/part-*")) and not (tmp_path / "out" / "_SUCCESS").exists()


# -- Newick ----------------------------------------------------------------------------------------


def below(rows):
    """{node: leaves under it} of (node, parent, is_leaf) rows."""
    parent = {n: p for n, p, _ in rows}
    out = {n: set() for n in parent}
    for n, _, leaf in rows:
        x = n if leaf else None
        while x is not None:
            out[x].add(n)
            x = parent[x]
    return out


def test_many_trees_are_read_at_once_and_written_back(spark):
    rng = np.random.default_rng(3)
    made = {}
    for t in range(6):
        n = 3 + 4 * t
        x = rng.random((n, 2))
        nodes = tree.agglomerate(np.sqrt(((x[:, None] - x) ** 2).sum(-1)), [f"s{i}" if i % 3 else f"odd '{i}' (x)" for i in range(n)], tree.agglomerate.__defaults__[0])
        made[f"t{t}"] = nodes
    rows = [(k, *x) for k, nodes in made.items() for x in nodes]
    frame = spark.createDataFrame(rows, "tree string, node string, parent string, inner_no int, is_leaf boolean, branch_length double")
    texts = tree.newick_texts(frame)
    back = tree.newick_trees(texts).collect()
    for k, nodes in made.items():
        mine = [r for r in back if r["tree"] == k]
        want = below([(x[0], x[1], x[3]) for x in nodes])
        got = below([(r["node"], r["parent"], r["is_leaf"]) for r in mine])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        assert {r["node"]: round(r["branch_length"], 6) for r in mine if r["is_leaf"]} == {x[0]: round(x[4], 6) for x in nodes if x[3]}
        assert sorted(r["inner_no"] for r in mine if not r["is_leaf"]) == list(range(1, len([x for x in nodes if not x[3]]) + 1))
        far, parent, length = {}, {r["node"]: r["parent"] for r in mine}, {r["node"]: r["branch_length"] for r in mine}
        for r in mine:
            x, d = r["node"], 0.0
            while x is not None:
                d, x = d + length[x], parent[x]
            far[r["node"]] = round(d, 9)
        inner = sorted((r["inner_no"], far[r["node"]]) for r in mine if not r["is_leaf"])
        assert [d for _, d in inner] == sorted(d for _, d in inner)


def test_newick_forms(spark):
    texts = [("a", "(x:1,y:2.5e-1,'it''s; (z)')r:3;"), ("b", "((p,q)i, (u , v:4) )"), ("c", "leaf:2;"), ("d", "((a:1)b:1)c;")]
    got = {}
    for r in tree.newick_trees(spark.createDataFrame(texts, "tree string, newick string")).collect():
        got.setdefault(r["tree"], {})[r["node"]] = (r["parent"], r["branch_length"])
    assert got["a"] == {"x": ("Inner1", 1.0), "y": ("Inner1", 0.25), "it's; (z)": ("Inner1", 0.0), "Inner1": (None, 3.0)}
    assert got["b"]["p"][0] == got["b"]["q"][0] != got["b"]["u"][0] == got["b"]["v"][0] and got["b"]["v"][1] == 4.0
    assert got["c"] == {"leaf": (None, 2.0)} and got["d"] == {"a": ("Inner2", 1.0), "Inner2": ("Inner1", 1.0), "Inner1": (None, 0.0)}
    for bad in ("((a,b);", "(a,b));"):
        with pytest.raises(Exception, match="unbalanced"):
            tree.newick_trees(spark.createDataFrame([("x", bad)], "tree string, newick string")).collect()


def test_a_tree_of_many_levels(spark):
    n = 20_000
    deep = "(" * n + "x0:1" + "".join(f",x{k}:1):1" for k in range(1, n + 1)) + ";"
    frame = tree.newick_trees(spark.createDataFrame([("deep", deep)], "tree string, newick string"))
    rows = {r["node"]: (r["parent"], r["branch_length"]) for r in frame.collect()}
    assert len(rows) == 2 * n + 1 and rows["Inner1"][0] is None and rows["x0"][0] == f"Inner{n}"
    assert all(rows[f"Inner{k}"][0] == f"Inner{k - 1}" for k in range(2, n + 1))
    nodes = [(k, p, None, k[0] == "x", d) for k, (p, d) in rows.items()]
    assert tree.to_newick(nodes).count("(") == n


def test_a_tree_of_many_leaves_on_one_level_has_no_shrinking_frames(spark):
    n = 3_000
    frame = tree.newick_trees(spark.createDataFrame([("wide", "((" + ",".join(f"x{k}:{k}" for k in range(n)) + ")a:2,y:1)r:1;")], "tree string, newick string"))
    plan = frame._jdf.queryExecution().analyzed().toString()
    starts = re.findall(r"specifiedwindowframe\(RowFrame, ([^,]+), unboundedfollowing", plan)
    assert set(starts) <= {"unboundedpreceding$()"}  # any other is read anew for each row: the square of the leaves
    rows = {r["node"]: (r["parent"], r["branch_length"]) for r in frame.collect()}
    assert rows == {f"x{k}": ("Inner2", float(k)) for k in range(n)} | {"Inner2": ("Inner1", 2.0), "y": ("Inner1", 1.0), "Inner1": (None, 1.0)}


# -- alignment ----------------------------------------------------------------------------------------


def all_alignments(a, b, score, gap_open, gap_extend):
    """The best score over all ways to align two short strings."""

    def walk(i, j, state):
        if i == len(a) and j == len(b):
            return 0.0
        ways = []
        if i < len(a) and j < len(b):
            ways.append(score(a[i], b[j]) + walk(i + 1, j + 1, 0))
        if i < len(a):
            ways.append((gap_extend if state == 1 else gap_open) + walk(i + 1, j, 1))
        if j < len(b):
            ways.append((gap_extend if state == 2 else gap_open) + walk(i, j + 1, 2))
        return max(ways)

    return walk(0, 0, 0)


def scored(a, b, pairs, score, gap_open, gap_extend):
    total, i, j, state = 0.0, 0, 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        gaps = [(1, x - i), (2, y - j)]
        orders = []
        for way in (gaps, gaps[::-1]):
            t, s = 0.0, state
            for kind, n in way:
                for _ in range(n):
                    t, s = t + (gap_extend if s == kind else gap_open), kind
            orders.append(t)
        total += max(orders)
        i, j = x + 1, y + 1
        if x < len(a):
            total, state = total + score(a[x], b[y]), 0
    return total


@pytest.mark.parametrize("held", [1, 3, 256])
def test_alignment_scores_most_of_all_alignments(monkeypatch, held):
    monkeypatch.setattr(structure, "HELD", held)
    rng = random.Random(held)
    score = lambda x, y: 2.0 if x == y else -1.5
    for _ in range(60):
        a, b = ("".join(rng.choice("ACD") for _ in range(rng.randrange(6))) for _ in range(2))
        total, pairs = structure.global_alignment(a, b, score, -2.0, -0.5)
        assert total == pytest.approx(all_alignments(a, b, score, -2.0, -0.5))
        assert total == pytest.approx(scored(a, b, pairs, score, -2.0, -0.5))


def test_what_is_chosen_does_not_depend_on_how_much_is_held(monkeypatch):
    rng = random.Random(8)
    score = lambda x, y: 5.0 if x == y else -4.0
    for n, m in ((40, 35), (17, 60), (0, 9), (9, 0), (0, 0), (50, 50)):
        a, b = ("".join(rng.choice("AC") for _ in range(k)) for k in (n, m))
        found = []
        for held in (1, 2, 7, 10_000):
            monkeypatch.setattr(structure, "HELD", held)
            found.append(structure.global_alignment(a, b, score))
        assert all(f == found[0] for f in found)


def test_alignment_of_protein_length_takes_seconds():
    rng = random.Random(2)
    a = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(2000))
    b = a[:700] + a[760:1500] + "ACD" * 20 + a[1500:]
    began = time.process_time()
    total, pairs = structure.global_alignment(a, b, lambda x, y: 5.0 if x == y else -4.0)
    assert len(pairs) == 1940 and total == pytest.approx(1940 * 5 - 2 * (10 + 59 * 0.5)) and time.process_time() - began < 60


def test_lots_of_alignments_equal_single_ones_and_take_a_fraction(monkeypatch):
    rng = random.Random(12)
    score = lambda x, y: 5.0 if x == y else -4.0
    texts = ["".join(rng.choice("ACD") for _ in range(rng.choice([0, 1, 5, 6, 9]))) for _ in range(160)]
    a, b = texts[:80], texts[80:]
    one = [structure.global_alignment(x, y, score) for x, y in zip(a, b, strict=True)]
    for held, cells in ((256, 50_000), (3, 50_000), (2, 12)):
        monkeypatch.setattr(structure, "HELD", held)
        monkeypatch.setattr(structure, "LOT_CELLS", cells)
        totals, (k, i, j) = structure.global_alignments(a, b, score)
        assert [(t, list(zip(i[k == x].tolist(), j[k == x].tolist(), strict=True))) for x, t in enumerate(totals.tolist())] == one
    monkeypatch.undo()
    a, b = ([f"Supplier#{rng.randrange(10**9):09d}"[o:] for _ in range(20_000)] for o in (0, 6))
    began = time.process_time()
    structure.global_alignments(a, b, score)
    assert time.process_time() - began < 20  # one at a time: about 60


# -- near rows ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("least", [1.0, 0.9, 0.75, 0.5, 0.0])
@pytest.mark.parametrize("size", [4, 512])
def test_near_rows_are_the_pairs_of_enough_identity(spark, monkeypatch, least, size):
    tiled = distance.tiled
    monkeypatch.setattr(distance, "tiled", lambda r, key, by: tiled(r, key, by, size))
    rng = random.Random(4)
    base = [rng.randrange(3) for _ in range(12)]
    rows = []
    for k in range(40):
        codes = list(base) if k % 4 else [rng.randrange(3) for _ in range(12)]
        for c in rng.sample(range(12), k % 5):
            codes[c] = rng.randrange(3)
        rows.append((k, codes))
    packed = spark.createDataFrame(rows, "seq_idx bigint, codes array<int>")
    got = sorted((r["i"], r["j"], round(r["d"], 9)) for r in distance.near_rows(packed, least).collect())
    want = []
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        d = sum(x != y for x, y in zip(a, b, strict=True)) / 12
        if 1 - d >= least - 1e-12:
            want.append((i, j, round(d, 9)))
    assert got == sorted(want)
    assert distance.near_rows(packed.limit(0), least).count() == 0


# -- signed ranks ----------------------------------------------------------------------------------------


def test_exact_signed_ranks_equal_all_signs(spark):
    rng = random.Random(6)
    rows = [(g, float(rng.randrange(6)), float(rng.randrange(6))) for g in range(8) for _ in range(2 + g)] + [(99, 1.0, 1.0)]
    got = {r["g"]: r for r in evaluation.signed_rank(spark.createDataFrame(rows, "g int, a double, b double"), ["g"]).collect()}
    assert 99 not in got
    for g in range(8):
        d = [a - b for k, a, b in rows if k == g and a != b]
        if not d:
            assert g not in got
            continue
        size = sorted(map(abs, d))
        rank = {v: np.mean([k + 1 for k, s in enumerate(size) if s == v]) for v in set(size)}
        ranks = [rank[abs(x)] for x in d]
        w = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
        least = min(w, sum(ranks) - w)
        hits = sum(sum(r for r, s in zip(ranks, signs, strict=True) if s) <= least for signs in itertools.product((0, 1), repeat=len(d)))
        assert got[g]["statistic"] == least and got[g]["p_exact"] == pytest.approx(min(1.0, 2 * hits / 2 ** len(d))) and got[g]["p_value"] == got[g]["p_exact"]


def test_many_pairs_take_the_normal_approximation(spark):
    rows = [(1, float(k), k + (1.6 if k % 2 else -1.4) * (1 + k / 100)) for k in range(60)]
    frame = spark.createDataFrame(rows, "g int, a double, b double")
    r, s = (evaluation.signed_rank(frame, ["g"], most).first() for most in (50, 60))
    assert r["p_exact"] is None and r["p_value"] == pytest.approx(2 * 0.5 * __import__("math").erfc(abs(r["z"]) / 2**0.5))
    assert s["p_value"] == s["p_exact"] == pytest.approx(r["p_value"], rel=0.1)


# -- the plan of a data set --------------------------------------------------------------------------


def test_data_set_plan(spark):
    seq = "ACDEFGHIKL"
    ids = spark.createDataFrame([("p1", seq), ("p2", seq), ("p3", "LLLLLLLLLL")], "id string, seq string")
    rows = [  # hit, number, definition, expect, identities, length, row
        ("h1", 1, "good", 0.01, 9, 10, "ACDEFGHIKA"), ("h1", 2, "a worse part of it", 0.01, 6, 10, "ACDEFGAAAA"), ("h2", 3, "too near to h1", 0.01, 9, 10, "ACDEFGHIKA"),
        ("h3", 4, "(Fragment)", 0.01, 9, 10, "ACDEFGHIKC"), ("h4", 5, "expect", 0.9, 9, 10, "ACDEFGHIKC"), ("h5", 6, "short", 0.01, 4, 4, "ACDE------"),
        ("h6", 7, "a letter", 0.01, 9, 10, "ACDEFGHIKX"), ("h7", 8, "far", 0.01, 5, 10, "ACDEF-----"), ("h8", 9, "too unlike", 0.01, 2, 10, "AC--------"),
    ]
    hits = spark.createDataFrame([(seq, *r) for r in rows], "seq string, hit_id string, hit_no bigint, definition string, expect double, identities int, align_length int, sbjct string")
    letters = "ACDEFGHIKL"
    made = data_set.build(ids, hits, {c: k for k, c in enumerate(letters + "-")}, letters)
    assert sorted((r["hit_id"], r["seq_idx"]) for r in made.best.collect()) == [("h1", 1), ("h2", 3), ("h7", 8)]
    assert sorted(r["hit_id"] for r in made.kept.collect()) == ["h1", "h7"] and made.filtered.count() == 4
    assert sorted((r["id"], r["hits"], r["filtered"], r["aligned"]) for r in made.summary.collect()) == [("p1", 9, 3, 2), ("p2", 9, 3, 2), ("p3", 0, 0, 0)]
    none = data_set.build(ids, hits.limit(0), {c: k for k, c in enumerate(letters)}, letters)
    assert none.kept.count() == 0 and none.summary.count() == 3
