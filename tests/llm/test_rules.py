"""Quality rules against SQL, against plain Python, and on odd rows."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.llm import entries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = "The quick brown fox jumps over the lazy dog near the river bank, and then it goes home to rest for a while in the shade."


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(inside),
    )


TEXTS = [
    None, "", "  \n\t ", "one", "a b c a b c", "a a a a a a", "x y z\nx y z\n\nx y z ", "# $% a|b <c>", "É ß 中文 😀 É ß 中文 😀",
    "\n".join([GOOD, "Second line of it, unlike the first one in every word that it holds so far.", GOOD]),
    "tab\tand\x0bvertical\x0cfeed\rreturn. end",
]


def test_counts_equal_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id here"), (3, "one"), (3, "one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = rules.quality_rules(df).collect()
    want = sorted([(str(i), *counts(t)) for i, t in rows])
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want


def test_repeats_of_long_texts_equal_plain_python(spark):
    text = " ".join(f"w{(i * i) % 83}" for i in range(700))
    got = rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert got["n_repeat_words"] == counts(text)[4] > 0


def failing(spark, lines):
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id bigint, text string")
    kept = df.select(F.explode(rules._lines(F.col("text"))).alias("x")).select("x.line", "x.fails").collect()
    return [r["fails"] for r in kept]


def test_line_rules(spark):
    bad = ["No end of a sentence", "Home | About | Contact | Log in.", "Home About Contact.", "It uses cookies to serve you better.", "BUY! NOW! CHEAP!", "a$$$ b%%% c***."]
    good = ["A sentence ends here.", 'He said "so be it."', "Is that a question?", "Prices rose by 5 % over the whole of the last year, they said.", "", "   ", "Ça va très bien…", "Stop!"]
    assert failing(spark, bad) == [True] * len(bad)
    assert failing(spark, good) == [False] * len(good)
    assert failing(spark, [good[0], bad[3], good[2]]) == [False, True, False]


def test_documents_that_lose_too_much_go_and_others_lose_lines(spark):
    say = lambda i: " ".join(f"word{i}x{k}" for k in range(18)) + "."
    body = "\n".join(map(say, range(4)))
    menu = "Home | About | Contact | More"
    rows = [(1, f"{menu}\n{body}\n\n{menu}", "x"), (2, f"{GOOD}\n" + "\n".join(f"{menu} {say(i)} {i}" for i in range(9)), "y"), (3, "Short.", "z"), (4, None, "n")]
    df = spark.createDataFrame(rows, "`a.b` bigint, _text string, _row string").withColumns({"text": F.col("_text"), "kept": F.lit(5), "_lines": F.lit(1)})
    out = rules.clean_documents(df).collect()
    assert [r["a.b"] for r in out] == [1] and out[0]["text"] == f"{body}\n" and out[0]["_text"] == rows[0][1] and out[0]["kept"] == 5
    assert rules.clean_documents(df).columns == df.columns
    verdict = {r["a.b"]: (r["base_failed"], r["kept"]) for r in rules.quality_rules(df, "a.b").collect()}
    assert verdict == {1: (False, True), 2: (False, False), 3: (True, False), 4: (True, False)}


def test_empty_table(spark, no_docs):
    assert rules.quality_rules(no_docs).count() == 0 and rules.clean_documents(no_docs).columns == no_docs.columns


def test_no_python_and_no_shuffle_in_the_plan(spark, small):
    plan = rules.clean_documents(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


@pytest.mark.parametrize("size", ["sf0.001"])
def test_query_equals_its_sql(spark, size):
    sf = f"/root/testdata/{size}"
    got = entries.op13_rules(spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(entries.ORACLE_SQL["op13_rules"]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert got[want.columns].sort_values("doc_id").reset_index(drop=True).equals(want.sort_values("doc_id").reset_index(drop=True))
    assert got.dtypes.to_dict() == want[got.columns].dtypes.to_dict()
