"""Queries on columns of alignments, and on pairs of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alphabets, metrics
from ..operators import columns, frequency, ranking, trace
from ..sources import reports
from .inputs import GAP, NAME_LETTERS, NAMES, NODES, RESIDUE, embedded, long, named, one_node, query, r6, sql6, table, two_rank_assignment, two_ranks

ENTROPY = "ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt)"


def ranked_sql(body: str, keys: str, order: str) -> str:
    """score (9 decimals), dense rank and coverage over a table ``body`` of (keys, score)."""
    return f"""
        SELECT {keys}, score, CAST(dense_rank() OVER (ORDER BY score {order}) AS INTEGER) AS rank,
               round(cume_dist() OVER (ORDER BY score {order}), 6) AS coverage
        FROM (SELECT {keys}, round(score, 9) AS score FROM ({body}))"""


def shown(df, *keys):
    return df.select(*keys, "score", F.col("rank").cast("int").alias("rank"), F.round("coverage", 6).alias("coverage"))


SINGLE = f"SELECT pos, {ENTROPY} AS score FROM (SELECT pos, code, count(*) AS cnt FROM residue GROUP BY ALL) GROUP BY pos"


@query("plain_entropy_single", f"WITH {RESIDUE} " + ranked_sql(SINGLE, "pos", "ASC"))
def plain_entropy_single(spark, sf_dir):
    scores = frequency.single_scores(long(one_node(embedded(spark, sf_dir)), "node"), "plain_entropy")
    return shown(ranking.ranked(scores, "min"), "pos")


IDENTITY = "SELECT pos, CAST(CASE WHEN count(DISTINCT code) > 1 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM names GROUP BY pos"


@query("identity_single", f"WITH {NAMES} " + ranked_sql(IDENTITY, "pos", "ASC"))
def identity_single(spark, sf_dir):
    scores = frequency.single_scores(long(one_node(named(spark, sf_dir)), "node"), "identity")
    return shown(ranking.ranked(scores, "min"), "pos")


@query("column_counts", f"WITH {RESIDUE} SELECT pos, code, count(*) AS cnt FROM residue GROUP BY ALL")
def column_counts(spark, sf_dir):
    return frequency.single_counts(long(one_node(embedded(spark, sf_dir)), "node")).select("pos", "code", "cnt")


@query("column_frequencies", f"""WITH {RESIDUE} SELECT pos, code, cnt, CAST(sum(cnt) OVER (PARTITION BY pos) AS BIGINT) AS depth,
    round(cnt / sum(cnt) OVER (PARTITION BY pos), 6) AS frequency FROM (SELECT pos, code, count(*) AS cnt FROM residue GROUP BY ALL)""")
def column_frequencies(spark, sf_dir):
    counts = frequency.single_counts(long(one_node(embedded(spark, sf_dir)), "node")).drop("node")
    return frequency.with_frequency(counts, ["pos"]).select("pos", "code", "cnt", "depth", F.round("frequency", 6).alias("frequency"))


@query("frequency_merge", f"WITH {RESIDUE} SELECT pos, code, count(*) AS cnt FROM residue GROUP BY ALL")
def frequency_merge(spark, sf_dir):
    by_label = long(embedded(spark, sf_dir).withColumn("node", F.col("label")), "node")
    counts = frequency.single_counts(by_label)
    return frequency.merge(counts.where("node % 2 = 0").drop("node"), counts.where("node % 2 <> 0").drop("node"))


@query("pair_counts", f"""WITH {RESIDUE} SELECT x.pos AS pos_i, y.pos AS pos_j, x.code AS a, y.code AS b, count(*) AS cnt
    FROM residue x JOIN residue y ON x.seq_idx = y.seq_idx AND x.pos < y.pos GROUP BY ALL""")
def pair_counts(spark, sf_dir):
    return frequency.pair_counts(one_node(embedded(spark, sf_dir))).drop("node")


@query("frequency_report", f"""WITH {RESIDUE}, c AS (SELECT pos, code, count(*) AS cnt FROM residue GROUP BY ALL)
    SELECT pos AS "Position", CAST(count(*) AS INTEGER) AS "Variability", string_agg(chr(65 + code), ',' ORDER BY code) AS "Characters",
           string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY code) AS "Counts" FROM c GROUP BY pos""")
def frequency_report(spark, sf_dir):
    counts = frequency.single_counts(long(one_node(embedded(spark, sf_dir)), "node"))
    return reports.frequency_report(counts, F.char(F.col("code") + 65)).drop("Frequencies")


@query("variability", f"""WITH {RESIDUE} SELECT pos, string_agg(DISTINCT chr(65 + code), ',' ORDER BY chr(65 + code)) AS characters,
    CAST(count(DISTINCT code) AS INTEGER) AS variability FROM residue GROUP BY pos""")
def variability(spark, sf_dir):
    return columns.variability(long(embedded(spark, sf_dir)), F.char(F.col("code") + 65))


@query("consensus_majority", f"""WITH {RESIDUE} SELECT pos, code, cnt FROM (SELECT pos, code, cnt, row_number() OVER (PARTITION BY pos ORDER BY cnt DESC, code) AS r
    FROM (SELECT pos, code, count(*) AS cnt FROM residue GROUP BY ALL)) WHERE r = 1""")
def consensus_majority(spark, sf_dir):
    return columns.consensus(long(embedded(spark, sf_dir)))


@query("usable_positions", f"""WITH {RESIDUE} SELECT pos, round(avg(CAST(code = {GAP} AS INT)), 6) AS gap_fraction, CAST(sum(CAST(code <> {GAP} AS INT)) AS BIGINT) AS evidence
    FROM residue GROUP BY pos HAVING avg(CAST(code = {GAP} AS INT)) <= 0.15""")
def usable_positions(spark, sf_dir):
    return columns.usable_positions(long(embedded(spark, sf_dir)), GAP, 0.15).withColumn("gap_fraction", F.round("gap_fraction", 6))


@query("gap_free_columns", f"""WITH {RESIDUE}, q AS (SELECT pos FROM residue WHERE seq_idx = (SELECT min(vec_id) FROM embeddings) AND code <> {GAP}),
    n AS (SELECT pos AS old, CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER) AS pos FROM q)
    SELECT seq_idx, n.pos, code FROM residue JOIN n ON residue.pos = n.old""")
def gap_free_columns(spark, sf_dir):
    packed = embedded(spark, sf_dir)
    first = packed.agg(F.min("seq_idx").alias("first"))
    cells = long(packed).crossJoin(F.broadcast(first))  # one row
    return columns.without_query_gaps(cells, F.col("seq_idx") == F.col("first"), GAP).select("seq_idx", "pos", "code")


@query("subset_rows", f"WITH {RESIDUE} SELECT seq_idx, pos, code FROM residue WHERE seq_idx IN (SELECT doc_id FROM labels WHERE quality = 1)")
def subset_rows(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("seq_idx"))
    return long(columns.sub_alignment(embedded(spark, sf_dir), ids, "seq_idx"))


@query("subset_columns", f"""WITH {RESIDUE}, n AS (SELECT n_nationkey * 2 AS old, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS pos FROM nation)
    SELECT seq_idx, n.pos, code FROM residue JOIN n ON residue.pos = n.old""")
def subset_columns(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 2).alias("pos"))
    return columns.subset_columns(long(embedded(spark, sf_dir)), wanted).select("seq_idx", "pos", "code")


@query("alphabet_encode", f"WITH {NAMES} SELECT * EXCLUDE (nation) FROM names")
def alphabet_encode(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq_idx"), F.col("s_name").alias("seq"))
    return columns.residues(columns.encode(rows, alphabets.mapping(NAME_LETTERS)))


@query("good_sequences", "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '^[ -~\\n]*$')")
def good_sequences(spark, sf_dir):
    printable = "".join(map(chr, range(32, 127))).replace("-", "") + "\n"
    return columns.good_sequences(table(spark, sf_dir, "documents"), printable, "text").select("doc_id", "lang")


@query("comparable_rows", f"""WITH {RESIDUE} SELECT x.pos AS pos_i, y.pos AS pos_j, CAST(sum(CAST(x.code <> {GAP} AND y.code <> {GAP} AS INT)) AS BIGINT) AS n
    FROM residue x JOIN residue y ON x.seq_idx = y.seq_idx AND x.pos < y.pos GROUP BY ALL""")
def comparable_rows(spark, sf_dir):
    return columns.comparable_rows(embedded(spark, sf_dir), GAP)


@query("gap_z_scores", f"""WITH {RESIDUE}, g AS (SELECT seq_idx, count(*) FILTER (code = {GAP}) AS gaps FROM residue GROUP BY seq_idx),
    m AS (SELECT avg(gaps) AS m, stddev_pop(gaps) AS s FROM g)
    SELECT seq_idx, gaps, round((gaps - m) / s, 6) AS z_score, (gaps - m) / s < 2 AS keep FROM g, m""")
def gap_z_scores(spark, sf_dir):
    return columns.gap_z_scores(long(embedded(spark, sf_dir)), GAP, 2.0).withColumn("z_score", F.round("z_score", 6))


@query("gap_consensus_disagreement", f"""WITH {RESIDUE}, c AS (SELECT pos, code FROM (SELECT pos, code, row_number() OVER (PARTITION BY pos ORDER BY count(*) DESC, code) AS r
    FROM residue GROUP BY pos, code) WHERE r = 1)
    SELECT seq_idx, round(avg(CAST((x.code = {GAP}) <> (c.code = {GAP}) AS INT)), 6) AS share, avg(CAST((x.code = {GAP}) <> (c.code = {GAP}) AS INT)) < 0.15 AS keep
    FROM residue x JOIN c USING (pos) GROUP BY seq_idx""")
def gap_consensus_disagreement(spark, sf_dir):
    return columns.gap_disagreement(long(embedded(spark, sf_dir)), GAP, 0.15).withColumn("share", F.round("share", 6))


# -- pairs of columns -------------------------------------------------------------------------------

PAIRS = NODES + """,
single AS (SELECT node, pos, ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt) AS h FROM (SELECT node, pos, code, count(*) AS cnt FROM member GROUP BY ALL) GROUP BY ALL),
pairs AS (SELECT x.node, x.pos AS pos_i, y.pos AS pos_j, x.code AS a, y.code AS b, count(*) AS cnt
    FROM member x JOIN member y ON x.node = y.node AND x.seq_idx = y.seq_idx AND x.pos < y.pos GROUP BY ALL),
joint AS (SELECT node, pos_i, pos_j, ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt) AS h, count(*) AS kinds FROM pairs GROUP BY ALL),
mi AS (SELECT j.node, pos_i, pos_j, a.h AS h_i, b.h AS h_j, a.h + b.h - j.h AS mi FROM joint j
    JOIN single a ON a.node = j.node AND a.pos = pos_i JOIN single b ON b.node = j.node AND b.pos = pos_j),
ends AS (SELECT node, pos, avg(mi) AS m FROM (SELECT node, pos_i AS pos, mi FROM mi UNION ALL SELECT node, pos_j, mi FROM mi) GROUP BY ALL),
whole AS (SELECT node, avg(mi) AS m FROM mi GROUP BY node),
apc AS (SELECT mi.node, pos_i, pos_j, mi, mi - CASE WHEN round(w.m, 12) <> 0 THEN a.m * b.m / w.m ELSE 0 END AS score FROM mi
    JOIN ends a ON a.node = mi.node AND a.pos = pos_i JOIN ends b ON b.node = mi.node AND b.pos = pos_j JOIN whole w ON w.node = mi.node)"""

_PAIR_SQL = {
    "identity": "SELECT pos_i, pos_j, CAST(CASE WHEN kinds > 1 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM joint WHERE node = 'root'",
    "plain_entropy": "SELECT pos_i, pos_j, h AS score FROM joint WHERE node = 'root'",
    "mutual_information": "SELECT pos_i, pos_j, mi AS score FROM mi WHERE node = 'root'",
    "normalized_mutual_information": "SELECT pos_i, pos_j, CASE WHEN round(h_i, 12) = 0 AND round(h_j, 12) = 0 THEN 1 ELSE mi / ((h_i + h_j) / 2) END AS score FROM mi WHERE node = 'root'",
    "average_product_corrected_mutual_information": "SELECT pos_i, pos_j, score FROM apc WHERE node = 'root'",
    "filtered_average_product_corrected_mutual_information": "SELECT pos_i, pos_j, CASE WHEN mi <= 1e-4 THEN 0 ELSE score END AS score FROM apc WHERE node = 'root'",
}


def _pair_query(metric):
    def run(spark, sf_dir):
        packed = one_node(embedded(spark, sf_dir))
        scores = frequency.pair_scores(packed, long(packed, "node"), metric)
        return shown(ranking.ranked(scores, metrics.direction(metric)), "pos_i", "pos_j")

    return run


for _metric, _body in _PAIR_SQL.items():
    _order = "DESC" if metrics.direction(_metric) == "max" else "ASC"
    query(f"{_metric}_pair", f"WITH {PAIRS} " + ranked_sql(_body, "pos_i, pos_j", _order))(_pair_query(_metric))

# -- transitions ---------------------------------------------------------------------------------------

TRANSITIONS = NAMES + """,
member AS (SELECT {node} AS node, seq_idx, pos, code FROM names{more}),
p AS (SELECT x.node, x.seq_idx, x.pos AS pos_i, y.pos AS pos_j, x.code AS a, y.code AS b FROM member x JOIN member y ON x.node = y.node AND x.seq_idx = y.seq_idx AND x.pos < y.pos),
t AS (SELECT s.node, s.pos_i, s.pos_j, (s.a = t.a) = (s.b = t.b) AS is_match, count(*) AS cnt
    FROM p s JOIN p t ON s.node = t.node AND s.pos_i = t.pos_i AND s.pos_j = t.pos_j AND s.seq_idx < t.seq_idx GROUP BY s.node, s.pos_i, s.pos_j, s.a, s.b, t.a, t.b),
d AS (SELECT node, greatest(count(*) * (count(*) - 1) / 2, 1) AS depth FROM (SELECT DISTINCT node, seq_idx FROM member) GROUP BY node),
grid AS (SELECT DISTINCT node, pos_i, pos_j FROM p),
raw AS (SELECT node, pos_i, pos_j, sum(cnt) FILTER (is_match) AS m_cnt, sum(cnt) FILTER (NOT is_match) AS mm_cnt,
    0 - sum(cnt / depth * ln(cnt / depth)) FILTER (is_match) AS m_ent, 0 - sum(cnt / depth * ln(cnt / depth)) FILTER (NOT is_match) AS mm_ent
    FROM t JOIN d USING (node) GROUP BY ALL),
tr AS (SELECT node, pos_i, pos_j, coalesce(m_cnt, 0)::DOUBLE AS m_cnt, coalesce(mm_cnt, 0)::DOUBLE AS mm_cnt, coalesce(m_ent, 0) AS m_ent, coalesce(mm_ent, 0) AS mm_ent
    FROM grid LEFT JOIN raw USING (node, pos_i, pos_j))"""


def _ratio(x: str, y: str) -> str:
    return f"CASE WHEN {y} <> 0 THEN {x} / {y} WHEN {x} <> 0 THEN {metrics.VERTICAL!r} ELSE 0 END"


_TRANSITION_SQL = {
    "match_count": "m_cnt",
    "mismatch_count": "mm_cnt",
    "match_mismatch_count_ratio": _ratio("mm_cnt", "m_cnt"),
    "match_entropy": "m_ent",
    "mismatch_entropy": "mm_ent",
    "match_mismatch_entropy_ratio": _ratio("mm_ent", "m_ent"),
    "match_diversity": "exp(m_ent)",
    "mismatch_diversity": "exp(mm_ent)",
    "match_mismatch_diversity_ratio": _ratio("exp(mm_ent)", "exp(m_ent)"),
    "match_diversity_mismatch_entropy_ratio": _ratio("mm_ent", "exp(m_ent)"),
}
_TRANSITION_SQL |= {k.replace("ratio", "angle"): f"atan({v})" for k, v in _TRANSITION_SQL.items() if k.endswith("ratio")}


def _transition_query(metric):
    def run(spark, sf_dir):
        scores = frequency.transition_scores(one_node(named(spark, sf_dir)))
        return scores.select("pos_i", "pos_j", r6(metrics.TRANSITION[metric]()).alias("score"))

    return run


for _metric, _expr in _TRANSITION_SQL.items():
    query(_metric, f"WITH {TRANSITIONS.format(node="'root'", more='')} SELECT pos_i, pos_j, {sql6(_expr)} AS score FROM tr")(_transition_query(_metric))


# -- traces over two ranks: the whole alignment, and its groups ------------------------------------------


@query("trace_real_single", f"WITH {NODES}, s AS (SELECT node, pos, {ENTROPY} AS h FROM (SELECT node, pos, code, count(*) AS cnt FROM member GROUP BY ALL) GROUP BY ALL) "
       + ranked_sql("SELECT pos, 1 + sum(h / CASE WHEN node = 'root' THEN 1 ELSE 2 END) AS score FROM s GROUP BY pos", "pos", "ASC"))
def trace_real_single(spark, sf_dir):
    packed = two_ranks(embedded(spark, sf_dir), "label")
    return shown(trace.trace(packed, long(packed, "node"), two_rank_assignment(packed), "plain_entropy", 1), "pos")


@query("trace_int_single", f"""WITH {NAMES}, m AS (SELECT 1 AS rank, 'root' AS node, pos, code FROM names UNION ALL SELECT 2, 'group' || nation, pos, code FROM names),
    s AS (SELECT rank, node, pos, CASE WHEN count(DISTINCT code) > 1 THEN 1 ELSE 0 END AS v FROM m GROUP BY ALL) """
       + ranked_sql("SELECT pos, 1 + CAST(sum(hit) AS DOUBLE) AS score FROM (SELECT rank, pos, max(v) AS hit FROM s GROUP BY ALL) GROUP BY pos", "pos", "ASC"))
def trace_int_single(spark, sf_dir):
    packed = two_ranks(named(spark, sf_dir), "nation")
    return shown(trace.trace(packed, long(packed, "node"), two_rank_assignment(packed), "identity", 1), "pos")


@query("trace_filtered_apc", f"WITH {PAIRS} " + ranked_sql("SELECT pos_i, pos_j, sum(CASE WHEN mi <= 1e-4 THEN 0 ELSE score END / CASE WHEN node = 'root' THEN 1 ELSE 2 END) AS score FROM apc GROUP BY ALL", "pos_i, pos_j", "DESC"))
def trace_filtered_apc(spark, sf_dir):
    packed = two_ranks(embedded(spark, sf_dir), "label")
    return shown(trace.trace(packed, long(packed, "node"), two_rank_assignment(packed), "filtered_average_product_corrected_mutual_information", 2), "pos_i", "pos_j")


_TWO = TRANSITIONS.format(node="'root'", more=" UNION ALL SELECT 'group' || nation, seq_idx, pos, code FROM names")


@query("trace_mismatch_diversity", f"WITH {_TWO} " + ranked_sql("SELECT pos_i, pos_j, 1 + sum(exp(mm_ent) / CASE WHEN node = 'root' THEN 1 ELSE 2 END) AS score FROM tr GROUP BY ALL", "pos_i, pos_j", "ASC"))
def trace_mismatch_diversity(spark, sf_dir):
    packed = two_ranks(named(spark, sf_dir), "nation")
    return shown(trace.trace(packed, long(packed, "node"), two_rank_assignment(packed), "mismatch_diversity", 2), "pos_i", "pos_j")


@query("gap_correction", f"WITH {RESIDUE}, s AS ({SINGLE}), g AS (SELECT pos, avg(CAST(code = {GAP} AS INT)) AS gap FROM residue GROUP BY pos) "
       + ranked_sql("SELECT pos, CASE WHEN gap > 0.15 THEN (SELECT max(score) FROM s) ELSE score END AS score FROM s JOIN g USING (pos)", "pos", "ASC"))
def gap_correction(spark, sf_dir):
    packed = one_node(embedded(spark, sf_dir))
    cells = long(packed, "node")
    scores = frequency.single_scores(cells, "plain_entropy").drop("node")
    gaps = columns.gap_share(cells, GAP).select("pos", "gap_fraction")
    return shown(ranking.ranked(trace.gap_corrected(scores, gaps, 0.15, "plain_entropy"), "min"), "pos")


def _rank_query(order):
    def run(spark, sf_dir):
        parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("score"))
        return shown(ranking.ranked(parts, order), "p_partkey")

    return run


for _o, _dir in (("min", "ASC"), ("max", "DESC")):
    query(f"rank_coverage_{_o}", ranked_sql("SELECT p_partkey, CAST(p_size AS DOUBLE) AS score FROM part", "p_partkey", _dir))(_rank_query(_o))
