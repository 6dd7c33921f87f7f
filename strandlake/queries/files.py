"""Queries on parsing (lines made from the driver's tables), statuses of pairs of rows, and annotation steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, dataset, evaluation, frequency, tree
from ..operators.pairs import shared_folder
from ..sources import reports, text
from .inputs import NAMES, named, one_node, query, table

# -- fixed-width and delimited lines --------------------------------------------------------------


def _atom_lines(spark, sf_dir):
    v, e = F.col("vec_id"), F.col("embedding")
    names = F.array(*map(F.lit, ["ALA", "CYS", "ASP", "GLU", "HOH"]))
    xyz = [(F.floor(e[k].cast("double") * 1000) / 100) for k in range(3)]
    line = F.format_string("%-6s%5d  %-3s%1s%3s %1s%4d    %8.3f%8.3f%8.3f", F.lit("ATOM"), v % 100000, F.when(v % 5 == 0, "CA").otherwise("N"), F.lit(" "), names[(F.floor(v / 5) % 5).cast("int")], F.char(65 + F.col("label")), F.floor(v / 5) % 10000, *xyz)
    return table(spark, sf_dir, "embeddings").select("label", line.alias("value"))


_ATOM_SQL = """a AS (SELECT chr(65 + label) AS chain, CAST(vec_id // 5 % 10000 AS INTEGER) AS resno, (['ALA', 'CYS', 'ASP', 'GLU', 'HOH'])[vec_id // 5 % 5 + 1] AS resname,
    (['A', 'C', 'D', 'E'])[vec_id // 5 % 5 + 1] AS aa, floor(CAST(embedding[1] AS DOUBLE) * 1000) / 100 AS x FROM embeddings)"""


@query("pdb_atoms", f"WITH {_ATOM_SQL} SELECT chain, resno, resname, aa, count(*) AS atoms, round(sum(x), 2) AS x FROM a WHERE resname <> 'HOH' GROUP BY ALL")
def pdb_atoms(spark, sf_dir):
    atoms = text.atom_rows(_atom_lines(spark, sf_dir))
    return atoms.groupBy("chain", "resno", "resname", "aa").agg(F.count("*").alias("atoms"), F.round(F.sum("x"), 2).alias("x"))


@query("chain_sequences", f"WITH {_ATOM_SQL} SELECT chain, count(*) AS length, string_agg(aa, '' ORDER BY resno) AS seq FROM (SELECT DISTINCT chain, resno, aa FROM a WHERE resname <> 'HOH') GROUP BY chain")
def chain_sequences(spark, sf_dir):
    return text.residue_sequence(text.atom_rows(_atom_lines(spark, sf_dir)))


@query("dbref_parse", """SELECT chr(65 + s_nationkey) AS chain_id, CAST(s_suppkey % 1000 AS INTEGER) AS seq_begin, CAST(s_suppkey % 1000 + 50 AS INTEGER) AS seq_end,
    CASE WHEN s_suppkey % 3 = 0 THEN 'PDB' ELSE 'UNP' END AS db, 'P' || (s_suppkey % 7) AS db_acc, CAST(s_suppkey % 500 AS INTEGER) AS db_seq_begin FROM supplier""")
def dbref_parse(spark, sf_dir):
    k = F.col("s_suppkey")
    db = F.when(k % 3 == 0, "PDB").otherwise("UNP")
    line = F.format_string("DBREF  1ABC %1s %4d  %4d  %-6s %-8s %-12s %5d  %5d", F.char(65 + F.col("s_nationkey")), k % 1000, k % 1000 + 50, db, F.concat(F.lit("P"), (k % 7).cast("string")), F.lit("NAME_X"), k % 500, k % 500 + 50)
    got = text.dbref_rows(table(spark, sf_dir, "supplier").select(line.alias("value")))
    return got.select("chain_id", "seq_begin", "seq_end", "db", "db_acc", "db_seq_begin")


@query("external_accessions", """SELECT 'UNP' AS db, chr(65 + s_nationkey) AS chain_id, 'P' || s_nationkey AS accession, CAST(min(s_suppkey % 500) AS INTEGER) AS first, CAST(max(s_suppkey % 500 + 50) AS INTEGER) AS last
    FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY s_nationkey""")
def external_accessions(spark, sf_dir):
    k = F.col("s_suppkey")
    refs = table(spark, sf_dir, "supplier").select(
        F.when(k % 3 == 0, "PDB").otherwise("UNP").alias("db"), F.char(65 + F.col("s_nationkey")).alias("chain_id"), F.concat(F.lit("P"), F.col("s_nationkey").cast("string")).alias("db_acc"),
        (k % 500).cast("int").alias("db_seq_begin"), (k % 500 + 50).cast("int").alias("db_seq_end"),
    )
    return text.external_accessions(refs)


@query("protein_list_parse", "SELECT '1a' || chr(97 + p_size % 26) || chr(CAST(97 + p_partkey % 26 AS INTEGER)) || chr(65 + p_size % 26) AS id, '1a' || chr(97 + p_size % 26) || chr(CAST(97 + p_partkey % 26 AS INTEGER)) AS pdb_id, chr(65 + p_size % 26) AS chain FROM part")
def protein_list_parse(spark, sf_dir):
    c = lambda base, name: F.char(base + F.col(name) % 26)
    ids = F.concat(F.lit("1a"), c(97, "p_size"), c(97, "p_partkey"), c(65, "p_size"))
    return text.protein_list(table(spark, sf_dir, "part").select(ids.alias("value")))


@query("coupling_scores", "SELECT CAST(least(l_partkey, l_suppkey) - 1 AS INTEGER) AS i, CAST(greatest(l_partkey, l_suppkey) - 1 AS INTEGER) AS j, count(*) AS n, round(sum(l_quantity), 6) AS score FROM lineitem GROUP BY ALL")
def coupling_scores(spark, sf_dir):
    line = F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("string"))
    got = text.coupling_scores(table(spark, sf_dir, "lineitem").select(line.alias("value")))
    return got.groupBy("i", "j").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


@query("stockholm_scan", "SELECT 'F' || n_regionkey AS family, 'n' || n_nationkey AS seq_id, upper(n_name) || lower(n_name) AS seq FROM nation")
def stockholm_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    name = lambda x: x["n_name"]
    part = lambda change: F.array_join(F.transform("r", lambda x: F.concat(F.lit("n"), x["n_nationkey"].cast("string"), F.lit("  "), change(name(x)))), "\n")
    record = F.concat(F.lit("# STOCKHOLM 1.0\n#=GF AC   F"), F.col("n_regionkey").cast("string"), F.lit("\n"), part(F.upper), F.lit("\n\n"), part(F.lower), F.lit("\n//\n"))
    return text.stockholm_rows(rows.select(record.alias("value")), "value")


@query("header_values", "SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(round(l_discount, 2)), 6) AS identity FROM lineitem GROUP BY ALL")
def header_values(spark, sf_dir):
    header = F.concat(F.lit(">x HSP_identity="), F.round("l_discount", 2).cast("string"), F.lit(" HSP_taxonomy=y"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.header_value(header, "HSP_identity").cast("double").alias("v"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("identity"))


@query("lineage_levels", "SELECT r_name || '; ' || n_name || '.' AS line, CAST(2 AS INTEGER) AS levels, n_name AS lowest FROM nation JOIN region ON n_regionkey = r_regionkey")
def lineage_levels(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = both.select(F.concat("r_name", F.lit("; "), "n_name", F.lit(".")).alias("line"))
    taxa = text.lineage(F.col("line"))
    return rows.select("line", F.size(taxa).alias("levels"), F.element_at(taxa, -1).alias("lowest"))


@query("fasta_files", "SELECT 'nation' || s_nationkey AS alignment, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS seq_idx, s_name AS seq_id, s_name || ' in ' || s_nationkey AS description, upper(substr(s_name, 1, 4)) AS seq FROM supplier")
def fasta_files(spark, sf_dir):
    """Alignments written as files, in order, and read back by ranges of bytes."""
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("aln_id"), F.col("s_suppkey").alias("seq_idx"),
        F.concat("s_name", F.lit(" in "), F.col("s_nationkey").cast("string")).alias("seq_id"), F.upper(F.substring("s_name", 1, 4)).alias("seq"),
    )
    folder = shared_folder(spark)
    reports.write_fasta(rows, folder, 1)  # one file for an alignment, whose rows the reader numbers
    got = text.read_fasta(spark, f"{folder}/*")
    name = F.regexp_extract("aln_id", "aln_id=([^/]+)", 1)
    return got.select(name.alias("alignment"), "seq_idx", "seq_id", "description", "seq")


@query("newick_trees", """WITH c AS (SELECT n_regionkey AS r, n_nationkey AS n, c_custkey AS k, round(abs(c_acctbal) / 1000, 6) AS len FROM customer JOIN nation ON n_nationkey = c_nationkey),
    i AS (SELECT r, n, row_number() OVER (PARTITION BY r ORDER BY n) + 1 AS no FROM (SELECT DISTINCT r, n FROM c))
    SELECT 'region' || r AS tree, 'c' || k AS node, 'Inner' || no AS parent, NULL::INTEGER AS inner_no, len AS branch_length FROM c JOIN i USING (r, n)
    UNION ALL SELECT 'region' || r, 'Inner' || no, 'Inner1', CAST(no AS INTEGER), 0.5 FROM i UNION ALL SELECT DISTINCT 'region' || r, 'Inner1', NULL, 1, 1 FROM i""")
def newick_trees(spark, sf_dir):
    """Customers under nations under regions, as one Newick text for each region, read back."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    both = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    leaf = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(":"), F.round(F.abs("c_acctbal") / 1000, 6).cast("decimal(20,6)").cast("string"))
    inside = lambda items, end: F.concat(F.lit("("), F.array_join(items, ","), F.lit(f"){end}"))
    nations = both.groupBy("n_regionkey", "n_nationkey").agg(inside(F.collect_list(leaf), "n:0.5").alias("part"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "part"))), lambda x: x["part"])
    regions = nations.groupBy("n_regionkey").agg(F.concat(inside(ordered, "r:1"), F.lit(";")).alias("newick"))
    trees = tree.newick_trees(regions.select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("tree"), "newick"))
    return trees.select("tree", "node", "parent", "inner_no", "branch_length")


# -- statuses of pairs of rows ---------------------------------------------------------------------


@query("match_status", f"WITH {NAMES} SELECT x.pos, x.seq_idx AS s, y.seq_idx AS t, CASE WHEN x.code = y.code THEN 1 ELSE -1 END AS status, x.code AS from_code, y.code AS to_code FROM names x JOIN names y ON x.pos = y.pos AND x.seq_idx < y.seq_idx")
def match_status(spark, sf_dir):
    return frequency.match_status(one_node(named(spark, sf_dir))).drop("node")


@query("pair_status", f"""WITH {NAMES} SELECT x.seq_idx AS s, y.seq_idx AS t, count(*) FILTER (x.code = y.code) IN (0, 2) AS is_match
    FROM names x JOIN names y ON x.pos = y.pos AND x.seq_idx < y.seq_idx WHERE x.pos IN (16, 17) GROUP BY ALL""")
def pair_status(spark, sf_dir):
    return frequency.pair_status_at(one_node(named(spark, sf_dir)), 16, 17).drop("node")


# -- annotation and summaries ------------------------------------------------------------------------


@query("family_statistics", "SELECT p_brand AS family, count(DISTINCT p_type) AS types, min(p_size) AS first, max(p_size) AS last FROM part GROUP BY p_brand")
def family_statistics(spark, sf_dir):
    return compare.group_statistics(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_size").withColumnRenamed("p_brand", "family")


@query("unit_conversion", "SELECT DISTINCT event_type, round(value / 60, 6) AS minutes, round(value / 3600, 6) AS hours FROM events")
def unit_conversion(spark, sf_dir):
    got = compare.timings(table(spark, sf_dir, "events"), "event_type", "value")
    return got.select("event_type", F.round("minutes", 6).alias("minutes"), F.round("hours", 6).alias("hours")).dropDuplicates()


@query("checked_hits", "SELECT count(*) AS n, round(min(1 - l_discount), 6) AS lowest FROM lineitem")
def checked_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((1 - F.col("l_discount")).alias("identity"), F.lit(1.0).alias("fraction"))
    return dataset.checked_thresholds(rows, 0.7, 0.5, 1.0).agg(F.count("*").alias("n"), F.round(F.min("identity"), 6).alias("lowest"))


@query("methods_by_pairs", """WITH v AS (SELECT l_suppkey AS k, l_returnflag AS m, round(avg(l_extendedprice), 6) AS x FROM lineitem GROUP BY ALL), p AS (SELECT a.m AS m1, b.m AS m2, round(a.x - b.x, 9) AS d FROM v a JOIN v b ON a.k = b.k AND a.m < b.m),
    z AS (SELECT m1, m2, abs(d) AS a, count(*) AS t, count(*) FILTER (d > 0) AS up FROM p WHERE d <> 0 GROUP BY ALL), r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY m1, m2 ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rank FROM z)
    SELECT m1, m2, CAST(sum(t) AS BIGINT) AS n, round(least(sum(rank * up), sum(rank * (t - up))), 6) AS statistic FROM r GROUP BY ALL""")
def methods_by_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("m")).agg(F.round(F.avg("l_extendedprice"), 6).alias("x"))
    a = v.select("k", F.col("m").alias("m1"), F.col("x").alias("a"))
    b = v.select("k", F.col("m").alias("m2"), F.col("x").alias("b"))
    got = evaluation.signed_rank(a.join(b, "k").where("m1 < m2"), ["m1", "m2"])
    return got.select("m1", "m2", "n", F.round(F.col("statistic").cast("double"), 6).alias("statistic"))


@query("methods_complete", "SELECT o_custkey FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1) WHERE n = (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def methods_complete(spark, sf_dir):
    return compare.having_all(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


_FEW = """d AS (SELECT s_nationkey AS g, round(s_acctbal - s_suppkey % 10 * 1000, 9) AS d FROM supplier),
    m AS (SELECT g, abs(d) AS a, d > 0 AS up FROM d WHERE d <> 0), r AS (SELECT g, up, CAST(2 * rank() OVER (PARTITION BY g ORDER BY a) - 1 + count(*) OVER (PARTITION BY g, a) AS INTEGER) AS r2 FROM m)"""


@query("signed_rank_exact", f"""WITH {_FEW}, s AS (SELECT g, list(r2) AS rs, count(*) AS n, sum(r2) FILTER (up) AS w, sum(r2) AS total FROM r GROUP BY g), t AS (SELECT g, rs, n, least(coalesce(w, 0), total - coalesce(w, 0)) AS least FROM s),
    signs AS (SELECT g, n, least, list_sum(list_transform(range(1, n + 1), lambda k: CASE WHEN (x >> (k - 1)) & 1 = 1 THEN rs[k] ELSE 0 END)) AS w FROM (SELECT *, unnest(range(CAST(pow(2, n) AS BIGINT))) AS x FROM t))
    SELECT g AS nation, CAST(n AS BIGINT) AS n, round(max(least) / 2, 6) AS statistic, round(least(1, 2 * count(*) FILTER (w <= least) / count(*)), 6) AS p_exact FROM signs GROUP BY g, n""")
def signed_rank_exact(spark, sf_dir):
    """Exact p-values; the SQL tries all signs, so its work doubles with each supplier of a nation."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("a"), (F.col("s_suppkey") % 10 * 1000).cast("double").alias("b"))
    got = evaluation.signed_rank(rows, ["nation"])
    return got.select("nation", "n", F.round(F.col("statistic").cast("double"), 6).alias("statistic"), F.round("p_exact", 6).alias("p_exact"))
