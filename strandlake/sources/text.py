"""Readers of sequence, structure and hit files.  Every reader returns a DataFrame with a fixed schema.

The ``*_rows`` functions parse a DataFrame of text, so that they serve files, tables and streams alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.pairs import cut
from ..operators.ranking import ranked

#: Three-letter names of the standard amino acids.
THREE_TO_ONE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files; line numbers rise within a file, whatever the splits."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
    return rows


def fasta_rows(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, seq_idx, header, seq) from lines: a record starts at a line that begins with '>'."""
    window = Window.partitionBy(group).orderBy(order)
    numbered = rows.withColumn("_record", F.sum(F.col(value).startswith(">").cast("int")).over(window)).where("_record > 0")
    body = F.array_sort(F.collect_list(F.when(~F.col(value).startswith(">"), F.struct(F.col(order).alias("o"), F.trim(value).alias("v")))))
    header = F.max(F.when(F.col(value).startswith(">"), F.substring(value, 2, 1_000_000)))
    out = numbered.groupBy(group, "_record").agg(header.alias("header"), body.alias("_b"))
    seq = F.array_join(F.transform("_b", lambda x: x["v"]), "")
    return out.select(group, (F.col("_record") - 1).cast("int").alias("seq_idx"), "header", seq.alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """aln_id (file), seq_idx, seq_id, description, seq.

    A record ends where the next one begins, at a line that starts with '>': that is the separator by which the files
    are read, so that one large file is read by many tasks, each from the first record that begins in its range of bytes
    on.  Rows are numbered within each range, and ranges by where they start in the file.  What stands before the
    first record of a file is left out.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    read = spark.read.option("lineSep", "\n>").text(path).select("value", at.alias("at"), F.monotonically_increasing_id().alias("no"))
    rows = cut(read)  # so that a row keeps its number
    counts = rows.groupBy("at").agg(F.min("no").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("at.file").orderBy("at.start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("at", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(starts, "at").select(F.col("at.file").alias("aln_id"), (F.col("_before") + F.col("no") - F.col("first")).alias("at_row"), "value")
    opened = placed.withColumn("_opens", (F.col("at_row") > 0) | F.col("value").startswith(">"))
    # all records but a file's first have lost their mark
    whole = F.when((F.col("at_row") == 0), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    parts = opened.where("_opens").select("aln_id", "at_row", F.split(whole, "\r?\n", 2).alias("p"))
    odd = opened.where("NOT _opens").select("aln_id", F.lit(1).alias("_shift"))  # files with something before the first record
    shifted = parts.join(odd, "aln_id", "left").withColumn("seq_idx", (F.col("at_row") - F.coalesce("_shift", F.lit(0))).cast("int"))
    header = F.rtrim(F.regexp_replace(F.col("p")[0], "\r$", ""))
    seq = F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), "\\s+", "")
    return shifted.select("aln_id", "seq_idx", F.split(header, r"\s+")[0].alias("seq_id"), header.alias("description"), seq.alias("seq"))


def require_query(sequences: DataFrame, query_id: str) -> DataFrame:
    """Add is_query; raises where no row has the query's id."""
    if sequences.where(F.col("seq_id") == query_id).isEmpty():
        raise ValueError(f"query {query_id!r} is not in the alignment")
    return sequences.withColumn("is_query", F.col("seq_id") == query_id)


def stockholm_rows(records: DataFrame, value: str) -> DataFrame:
    """(family, seq_id, seq) from texts of one '//'-ended record each."""
    family = F.regexp_extract(value, r"(?m)^#=GF\s+AC\s+(\S+)", 1)
    rows = records.select(family.alias("family"), F.posexplode(F.split(value, "\n")).alias("line", "text"))
    rows = rows.where(~F.col("text").startswith("#") & (F.trim("text") != "") & (F.trim("text") != "//"))
    parts = F.split(F.trim("text"), r"\s+")
    cells = rows.select("family", "line", parts[0].alias("seq_id"), F.get(parts, F.lit(1)).alias("part"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda x: x["part"]), "")
    return cells.groupBy("family", "seq_id").agg(seq.alias("seq"))


def _field(value: str, first: int, last: int) -> Column:
    """Columns first..last (from 1) of a fixed-width line, trimmed."""
    return F.trim(F.substring(value, first, last - first + 1))


def atom_rows(rows: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    """Atoms of standard residues from fixed-width ATOM lines; other records are left out."""
    names = F.create_map(*[F.lit(x) for kv in THREE_TO_ONE.items() for x in kv])
    cut = rows.where(F.substring(value, 1, 6) == "ATOM  ").select(
        *keep,
        _field(value, 22, 22).alias("chain"), _field(value, 23, 26).cast("int").alias("resno"), _field(value, 18, 20).alias("resname"),
        _field(value, 13, 16).alias("atom_name"), *[_field(value, 31 + 8 * k, 38 + 8 * k).cast("double").alias(c) for k, c in enumerate("xyz")],
        F.nullif(_field(value, 17, 17), F.lit("")).alias("altloc"),
    )
    return cut.withColumn("aa", F.try_element_at(names, F.col("resname"))).where("aa IS NOT NULL")


def residue_sequence(atoms: DataFrame, *keep: str) -> DataFrame:
    """keep..., chain, length, seq of each chain in order of residue number."""
    one = atoms.groupBy(*keep, "chain", "resno").agg(F.max("aa").alias("aa"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("resno", "aa"))), lambda x: x["aa"]), "")
    return one.groupBy(*keep, "chain").agg(F.count("*").alias("length"), seq.alias("seq"))


def dbref_rows(rows: DataFrame, value: str = "value") -> DataFrame:
    """External references from fixed-width DBREF lines; a line with a bad number raises an error."""
    number = lambda a, b: _field(value, a, b).cast("int")
    return rows.where(F.substring(value, 1, 6) == "DBREF ").select(
        _field(value, 8, 11).alias("id_code"), _field(value, 13, 13).alias("chain_id"), number(15, 18).alias("seq_begin"), number(21, 24).alias("seq_end"),
        _field(value, 27, 32).alias("db"), _field(value, 34, 41).alias("db_acc"), _field(value, 43, 54).alias("db_id"),
        number(56, 60).alias("db_seq_begin"), number(63, 67).alias("db_seq_end"),
    )


def external_accessions(refs: DataFrame) -> DataFrame:
    """db, chain_id, accession and merged range; two accessions for one chain raise an error."""
    got = refs.where("db <> 'PDB'").groupBy("db", "chain_id").agg(
        F.min("db_acc").alias("accession"), F.count_distinct("db_acc").alias("_n"), F.min("db_seq_begin").alias("first"), F.max("db_seq_end").alias("last")
    )
    one = F.when(F.col("_n") == 1, F.col("accession")).otherwise(F.raise_error(F.lit("several accessions for one chain")).cast("string"))
    return got.select("db", "chain_id", one.alias("accession"), "first", "last")


def chain_sequence(chains: DataFrame, source: str = "PDB") -> DataFrame:
    """chain, seq from the chosen source column: PDB, UNP or GB."""
    column = {"PDB": "seq", "UNP": "unp_seq", "GB": "gb_seq"}.get(source)
    if column is None:
        raise ValueError("source must be PDB, UNP or GB")
    return chains.select("chain", F.col(column).alias("seq"))


def first_source(sequences: DataFrame, sources: list[str]) -> DataFrame:
    """(id, source, seq): of the sequences that an id has, the one whose source comes first in the list; others are left out."""
    order = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    rows = sequences.where(F.col("seq").isNotNull() & F.col("source").isin(sources)).withColumn("_o", order)
    best = F.min_by(F.struct("source", "seq"), F.struct("_o", "seq")).alias("b")
    return rows.groupBy("id").agg(best).select("id", "b.source", "b.seq")


def lineages(ids: DataFrame, *tables: DataFrame) -> DataFrame:
    """(id, taxa): the lineage (accession, lineage) of the first table that has the id's accession."""
    accession = F.regexp_extract("id", r"^(?:UniRef\d+_)?([^\s|]+)", 1)
    rows = ids.select("id", accession.alias("accession"))
    for k, t in enumerate(tables):
        rows = rows.join(t.select("accession", F.col("lineage").alias(f"_l{k}")), "accession", "left")
    return rows.select("id", lineage(F.coalesce(*[F.col(f"_l{k}") for k in range(len(tables))])).alias("taxa"))


def flat_file_sequence(value: Column) -> Column:
    """The letters of the SQ block of a flat file."""
    return F.regexp_replace(F.regexp_extract(value, r"(?s)\nSQ [^\n]*\n(.*?)//", 1), r"\s+", "")


_BLAST = (
    "BlastOutput_iterations STRUCT<Iteration: ARRAY<STRUCT<`Iteration_query-def`: STRING, Iteration_hits: STRUCT<Hit: ARRAY<STRUCT<"
    "Hit_id: STRING, Hit_def: STRING, Hit_hsps: STRUCT<Hsp: ARRAY<STRUCT<Hsp_evalue: DOUBLE, Hsp_identity: INT, `Hsp_align-len`: INT, Hsp_hseq: STRING>>>>>>>>>"
)


def blast_hits(documents: DataFrame, value: str = "value") -> DataFrame:
    """query, hit_id, definition and one row per HSP from BLAST XML texts."""
    found = documents.select(F.explode(F.from_xml(value, _BLAST)["BlastOutput_iterations"]["Iteration"]).alias("q"))
    hits = found.select(F.col("q.`Iteration_query-def`").alias("query"), F.explode("q.Iteration_hits.Hit").alias("h"))
    rows = hits.select("query", F.col("h.Hit_id").alias("hit_id"), F.col("h.Hit_def").alias("definition"), F.explode("h.Hit_hsps.Hsp").alias("s"))
    return rows.select(
        "query", "hit_id", "definition", F.col("s.Hsp_evalue").alias("expect"), F.col("s.Hsp_identity").alias("identities"),
        F.col("s.`Hsp_align-len`").alias("align_length"), F.col("s.Hsp_hseq").alias("sbjct"),
    )


def protein_list(rows: DataFrame, value: str = "value") -> DataFrame:
    """pdb_id, chain from lines like 1abcA; any other line raises an error."""
    pattern = r"^([0-9][a-z0-9]{3})([A-Z])$"
    ok = F.when(F.col(value).rlike(pattern), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("not a chain id: "), F.col(value))).cast("string"))
    return rows.where(F.trim(value) != "").select(ok.alias("id")).select("id", F.regexp_extract("id", pattern, 1).alias("pdb_id"), F.regexp_extract("id", pattern, 2).alias("chain"))


def header_value(header: Column, key: str) -> Column:
    """The value of key=value in a sequence header."""
    return F.regexp_extract(header, rf"{key}=([^\s]+)", 1)


def lineage(value: Column, separator: str = ";") -> Column:
    """Taxa of a lineage line, without its final stop."""
    return F.transform(F.split(F.rtrim(value, F.lit(".")), separator), lambda x: F.trim(x))


def _pairs(rows: DataFrame, value: str, separator: str) -> DataFrame:
    return rows.where(F.trim(value) != "").where(~F.trim(value).startswith("%")).select(F.split(F.trim(value), separator).alias("p"))


def coupling_scores(rows: DataFrame, value: str = "value") -> DataFrame:
    """i < j (from 0), score from lines 'i j score' that count from 1."""
    p = _pairs(rows, value, r"\s+").select((F.get("p", F.lit(0)).cast("int") - 1).alias("a"), (F.get("p", F.lit(1)).cast("int") - 1).alias("b"), F.get("p", F.lit(2)).cast("double").alias("score"))
    return p.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "score")


def read_couplings_csv(spark: SparkSession, path: str) -> DataFrame:
    """i < j (from 0), cn, probability from a CSV that counts from 1."""
    got = spark.read.csv(path, header=True, schema="i int, A_i string, j int, A_j string, fn double, cn double, segment_i string, segment_j string, probability double", enforceSchema=False)
    return got.select((F.least("i", "j") - 1).alias("i"), (F.greatest("i", "j") - 1).alias("j"), "cn", "probability")


def symmetric(pairs: DataFrame, *values: str) -> DataFrame:
    """Both (i, j) and (j, i)."""
    return pairs.select("i", "j", *values).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), *values))


def rank_table(spark: SparkSession, path: str) -> DataFrame:
    """A TSV with a column Rank, and further wide columns 'Rank k Entropy' as rows (position, rank, entropy)."""
    wide = spark.read.csv(path, sep="\t", header=True, inferSchema=True, comment="%")
    ranks = [c for c in wide.columns if c.startswith("Rank ")]
    if not ranks:
        return wide
    kept = [c for c in wide.columns if c not in ranks]
    return wide.unpivot(kept, ranks, "rank", "entropy").withColumn("rank", F.regexp_extract("rank", r"(\d+)", 1).cast("int"))


def square_matrix(spark: SparkSession, path: str) -> DataFrame:
    """i, j, d of a square TSV with a header of names and a first column of names."""
    wide = spark.read.csv(path, sep="\t", header=True, comment="%")
    return wide.unpivot(wide.columns[0], wide.columns[1:], "j", "d").select(F.col(wide.columns[0]).alias("i"), "j", F.col("d").cast("double"))


def stacked_tables(rows: DataFrame, group: str, order: str, value: str, marker: str) -> DataFrame:
    """Add the number of the table a line belongs to: a line that starts with the marker opens the next one."""
    window = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("table_no", F.sum(F.col(value).startswith(marker).cast("int")).over(window))


def covariance_file(rows: DataFrame, value: str = "value") -> DataFrame:
    """i < j (from 0), raw and coverage scores of a sorted pair report; non-numeric lines are left out."""
    p = _pairs(rows, value, r"\s+")
    number = lambda k: F.get("p", F.lit(k)).try_cast("int")
    got = p.select(number(1).alias("a"), number(3).alias("b"), F.get("p", F.lit(5)).try_cast("double").alias("score"), F.get("p", F.lit(6)).try_cast("double").alias("coverage"))
    return got.dropna(subset=["a", "b"]).select((F.least("a", "b") - 1).alias("i"), (F.greatest("a", "b") - 1).alias("j"), "score", "coverage")


#: The score columns of the long file of intermediate scores.
GROUP_SCORES = ("MI", "AMIi", "AMIj", "AMI", "MIp")


def group_scores(rows: DataFrame, value: str = "value") -> DataFrame:
    """i < j (from 0), rank, grp and five scores from lines 'i j rank group scores...' that count from 1; headers and notes are left out."""
    p = _pairs(rows, value, r"\s+")
    number = lambda k: F.get("p", F.lit(k)).try_cast("int")
    scores = [F.get("p", F.lit(4 + k)).try_cast("double").alias(n.lower()) for k, n in enumerate(GROUP_SCORES)]
    got = p.select(number(0).alias("a"), number(1).alias("b"), number(2).alias("rank"), number(3).alias("grp"), *scores).dropna(subset=["a", "b", "rank", "grp"])
    return got.select((F.least("a", "b") - 1).alias("i"), (F.greatest("a", "b") - 1).alias("j"), "rank", "grp", *[n.lower() for n in GROUP_SCORES])


def position_ranks(rows: DataFrame, value: str = "value", real: bool = False) -> DataFrame:
    """pos (from 0), score, coverage, rank from a report of single positions; ``real``: with a column of real scores.

    The columns are number, residue, letter, score, variability, characters, (real score,) coverage; the
    rank is the dense rank of the scores.
    """
    p = _pairs(rows, value, r"\s+")
    number = lambda k: F.get("p", F.lit(k)).try_cast("double")
    got = p.select((F.get("p", F.lit(1)).try_cast("int") - 1).alias("pos"), number(3).alias("score"), number(7 if real else 6).alias("file_coverage")).dropna(subset=["pos"])
    return ranked(got, "min").select("pos", "score", F.col("file_coverage").alias("coverage"), "rank")


def score_file(rows: DataFrame, method: str, value: str = "value") -> DataFrame:
    """The scores of a report by its method: pairs, real (single positions) or integer (single positions)."""
    ways = {"pairs": covariance_file, "real": lambda r, v: position_ranks(r, v, True), "integer": lambda r, v: position_ranks(r, v)}
    if method not in ways:
        raise ValueError(f"method must be one of {sorted(ways)}")
    return ways[method](rows, value)


def frequency_csv(spark: SparkSession, path: str, depth: int | None = None) -> DataFrame:
    """pos, char, cnt from a frequency TSV; counts of every position must sum to one depth."""
    schema = "Position int, Variability int, Characters string, Counts string, Frequencies string"
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema)
    cells = rows.select(F.col("Position").alias("pos"), F.explode(F.arrays_zip(F.split("Characters", ",").alias("char"), F.split("Counts", ",").alias("cnt"))).alias("c"))
    out = cells.select("pos", "c.char", F.col("c.cnt").cast("bigint").alias("cnt"))
    found = [r[0] for r in out.groupBy("pos").agg(F.sum("cnt").alias("n")).select("n").distinct().limit(2).collect()]
    if len(found) > 1 or depth is not None and found != [depth]:
        raise ValueError(f"depths differ: {found}, expected {depth if depth is not None else 'one'}")
    return out
