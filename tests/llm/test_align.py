"""Cross-tokenizer alignment against whole texts encoded by the libraries themselves."""

import hashlib
import json
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from strandlake.llm import align, entries
from strandlake.llm.packing import byte_letters

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {c: k for k, c in enumerate(byte_letters())}
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items() if all(c in letters for c in t)}

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    return a, b, a_bytes, b_bytes


def brute(libraries, rows, weight="links"):
    """{id: contract columns} and the counts of pairs, from whole texts."""
    a, b, a_bytes, b_bytes = libraries
    held, links, by_group = {}, defaultdict(list), Counter()
    for k, (id_, text) in enumerate(rows):
        want = (" " + (text or "")).encode()
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or b"".join(a_bytes[i] for i in x) != want or b"".join(map(b_bytes, y)) != want:
            held[k] = (id_, 0, 0, [])
            continue
        spans = []
        for ids, size in ((x, lambda i: len(a_bytes[i])), (y, lambda i: len(b_bytes(i)))):
            at, out = 0, []
            for i in ids:
                out.append((at, at + size(i), i))
                at += size(i)
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        for end in cuts:
            groups.append(tuple(tuple(i for s, e, i in side if start <= s and e <= end) for side in spans))
            start = end
        held[k] = (id_, len(x), len(y), groups)
        links[k] = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
    if weight == "links":
        count = Counter(p for v in links.values() for p in v)
    else:
        count = Counter()
        for _, _, _, groups in held.values():
            for g in set(groups):
                ends = [[sum(len(f(i)) for i in side[: k + 1]) for k in range(len(side))] for side, f in zip(g, (a_bytes.get, b_bytes), strict=True)]
                starts = [[0, *e[:-1]] for e in ends]
                count.update((g[0][i], g[1][j]) for i in range(len(g[0])) for j in range(len(g[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i])
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for k, (id_, n_a, n_b, groups) in held.items():
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        mine = links[k]
        out.append((id_, n_a, n_b, len(groups), len(mine), sum(count[p] == most[p[1]] for p in mine), sum(count[p] for p in mine), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out, count, most


def compared(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


ODD = [
    "▁ literal", "two  spaces   here", " leading", "trailing  ", "   ", "\n\nlines\r\n\tand tabs ", "no break 　wide", " sep \u0085x \x1c y", "é 中文\U0001f600 café naïve",
    "<s> </s> <unk> <|endoftext|> <0x41>", "a" * 3000, " ".join(["word"] * 500), "It's we'll 123 4567 don't", "\x00 nul \x00", "mixed   x",
]


def test_odd_texts_equal_the_libraries(spark, docs, texts, libraries):
    rows = [(i, t) for i, t in texts] + [(700 + k, t) for k, t in enumerate(ODD)] + [(None, "an id that is null"), (5, "the same id twice"), (5, "the same id twice")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(texts) :], "doc_id bigint, text string"))
    want, count, most = brute(libraries, rows)
    compared(align.align_tokens(df, A, B).collect(), want)
    compared(align.align_tokens(df.repartition(5), A, B, lot_bytes=500).collect(), want)
    pairs = align.token_pairs(df, A, B).collect()
    compared(pairs, [(i, j, n, n == most[j]) for (i, j), n in count.items()])


def test_counts_by_documents(spark, libraries):
    rows = [(k, t) for k, t in enumerate(["the thing the thing", "the unbelievable thing", "unbelievable", None, "zqxj vwk zqxj"])]
    want, count, most = brute(libraries, rows, "documents")
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    compared(align.token_pairs(df, A, B, weight="documents").collect(), [(i, j, n, n == most[j]) for (i, j), n in count.items()])
    compared(align.align_tokens(df, A, B, weight="documents").collect(), want)
    with pytest.raises(ValueError):
        align.token_pairs(df, A, B, weight="words")


def test_empty_table_and_clashing_names(spark, no_docs):
    assert align.align_tokens(no_docs, A, B).count() == 0 and align.token_pairs(no_docs, A, B).count() == 0
    df = spark.createDataFrame([(1, "some text"), (2, None)], "`a.b` string, lot string").withColumn("kind", F.lit(1)).withColumn("_text", F.lit(2))
    got = {r["a.b"]: r["n_a"] for r in align.align_tokens(df, A, B, "a.b", "lot").collect()}
    assert got == {"1": 2, "2": 0}


def test_query_equals_the_libraries(spark, small, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    compared(entries.op12_align(spark, small).collect(), brute(libraries, rows)[0])


def test_chunks_cut_together_are_those_cut_one_by_one():
    pair = align.encoders(A, B)
    chunks = [" the", " Xylofa", " é½ﬁ", " ▁a", "  two", " 日本語", " a\tb", " 12345", " " + "word" * 300, " <0x0A>", " \x00q", " 🙂", " end\n"]
    ids = pair.b.encode([c[1:] for c in chunks], num_threads=1)
    found = pair._cut_all(chunks, ids)
    one = {c: pair._cut(c, pair._a_ids(c), b) for c, b in zip(chunks, ids, strict=True)}
    assert found and found.items() <= one.items()
    assert {" the", " Xylofa", " 日本語"} <= found.keys() and " end\n" not in found  # white space at its end: by itself
    assert pair._cut_all([], []) == {}
