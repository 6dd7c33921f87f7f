"""Fill-in-middle against a plain version, exact round trips, and odd rows."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import entries, fim


def plain_version(id_, text):
    """form, prefix, middle, output of a text cut into code points."""
    d = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= 90:
        return "plain", None, None, text
    pre, mid, suf = text[:i], text[i:j], text[j:]
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return ("spm" if h[3] % 100 < 20 else "psm"), i, j - i, out


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0, 7], list(range(1, 3000)), [3 * k + k % 3 for k in range(2000)], [10**9, 10**12], [k * k for k in range(1500)]])
def test_elias_fano_gives_every_number(values):
    code = fim.EliasFano(np.array(values, np.int64))
    assert len(code) == len(values) and [code[k] for k in range(len(values))] == values
    for k in (-1, len(values)):
        with pytest.raises(IndexError):
            code[k]


def test_rows_equal_the_plain_version(spark, docs, texts):
    odd = [(600 + i, t) for i, t in enumerate(["has <P> in it", "<S>", "ends with <", ">S> starts", "x<", "a" * 5000, "é中😀" * 50])] + [(None, "no id"), (7, "repeated id"), (7, "repeated id")]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, "en") for i, t in odd], "doc_id bigint, text string, lang string"))
    got = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(repr((i, len(t or ""), *plain_version(i, t or ""))) for i, t in texts + odd)
    assert sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"])) for r in got) == want
    assert sorted((str(r["doc_id"]), r["back"]) for r in got) == sorted((str(i), t or "") for i, t in texts + odd)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_copies_beyond_a_block_are_salted(spark, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 7)
    rows = [(i, "the same text again" if i % 3 else f"text {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    got = fim.fill_in_middle(df).collect()
    assert sorted((r["doc_id"], r["form"], r["output"]) for r in got) == sorted((i, plain_version(i, t)[0], plain_version(i, t)[3]) for i, t in rows)


def test_other_units_and_markers(spark):
    df = spark.createDataFrame([(i, "one two  three\nfour five") for i in range(40)], "key string, text string")
    got = fim.fill_in_middle(df, "key", units=r"\S+\s*", markers=("[p]", "[s]", "[m]"), fim_percent=100, spm_percent=50, seed=9)
    got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"), ("[p]", "[s]", "[m]"))).collect()
    assert {r["n"] for r in got} == {5} and {r["form"] for r in got} == {"psm", "spm"} and {r["back"] for r in got} == {"one two  three\nfour five"}
    for r in got:
        prefix = re.split(r"\[[psm]\]", r["output"])[1 if r["form"] == "psm" else 2]
        assert len(prefix.split()) == r["prefix_units"] and re.fullmatch(r"(\S+\s+)*", prefix + " " * bool(prefix))


def test_empty_table_and_clashing_names(spark, no_docs):
    assert fim.fill_in_middle(no_docs).count() == 0
    df = spark.createDataFrame([(1, "some text", "x")], "`a.b` bigint, `_text` string, _sha string").withColumn("_id", F.lit(1)).withColumn("output", F.lit(1))
    assert fim.fill_in_middle(df, "a.b", "_text").first()["n"] == 9


def test_query_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(entries.ORACLE_SQL["op11_fim"]).fetchall()
    names = [c[0] for c in con.description]
    got = entries.op11_fim(spark, small).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_query_equals_the_plain_version(spark, small):
    got = {r["doc_id"]: r for r in entries.op11_fim(spark, small).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for id_, text in rows:
        form, prefix, middle, out = plain_version(id_, text or "")
        assert tuple(got[id_])[1:] == (len(text or ""), form, prefix, middle, sha(out), sha(text or ""))
