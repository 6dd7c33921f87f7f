"""BPE, packing, chat templates and language-model scores."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import bpe, chat, lm, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_equals_tiktoken(docs, texts, reference):
    got = {r["doc_id"]: r["ids"] for r in bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in texts:
        assert got[i] == reference.encode_ordinary(t or "")


def test_bpe_round_trip(docs, texts):
    encoded = bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN)
    got = {r["doc_id"]: bytes(r["data"]) for r in bpe.bpe_decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {i: (t or "").encode() for i, t in texts}


def test_bpe_on_odd_strings(reference):
    rng = random.Random(6)
    letters = " \n\t\r .,abcABC'sdé中文1234!?-_😀́  \x0b\x1c"
    strings = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)]
    strings += ["a" * 3000, "ab" * 2000, " " * 500, "\n" * 40, "x.\n", "x,\n\ny"]
    _, cache = bpe.coder(RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(strings, cache.ids(strings), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)


def test_other_patterns_are_honoured(spark):
    pattern = r"[a-z]{1,3}|[^a-z]+"
    own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    rows = [(1, "Hello there, general words\n  and more."), (2, None), (3, ""), (4, "x,y. z")]
    got = {r["doc_id"]: r["ids"] for r in bpe.bpe_encode(spark.createDataFrame(rows, "doc_id int, text string"), RANKS, pattern).collect()}
    assert got == {i: own.encode_ordinary(t or "") for i, t in rows}


def test_replay_where_a_lower_rank_comes_up_late():
    """A vocabulary that no training makes: merging b+c uncovers a+bc, whose rank is lower."""
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257, b"abca": 258, b"bcb": 259}
    replay = bpe.MergeReplay(ranks)
    one = {w: replay._one_word(w) for w in map(bytes, itertools.product(b"abc", repeat=6))}
    for w, ids in zip(one, replay.encode_words(list(one)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == (one[w] if w not in ranks else [ranks[w]])


def test_cache_is_bounded():
    cache = bpe.PieceCache(lambda pieces: [p.encode("utf-32-le") for p in pieces], size=50)
    for k in range(20):
        texts = [f"a{k} b{k} c.", "c d", "", None, " x  y ", "c d"]
        assert [x.decode("utf-32-le") for x in cache.ids(texts)] == [t or "" for t in texts]
        assert len(cache.known) < 120


def test_pieces_follow_the_tokenizer(docs, texts):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    rows = packing.token_pieces(docs, JSON, capacity=64).collect()
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == list(itertools.accumulate([0] + [r["length"] for r in mine[:-1]]))
        assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == 64 for r in mine[1:])
        for r in mine:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == r["ids_crc32"]


def test_packing_is_gapless_and_tight(docs):
    rows = packing.pack_documents(docs, JSON, capacity=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(itertools.accumulate([0] + [n for _, n in pieces[:-1]]))
        assert sum(n for _, n in pieces) <= 64
    bins = []
    for n in sorted((r["length"] for r in rows), reverse=True):  # first fit, longest first
        k = next((k for k, used in enumerate(bins) if used + n <= 64), None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    assert len(by) <= len(bins)
    assert len(rows) == packing.token_pieces(docs, JSON, capacity=64).count()


@pytest.mark.parametrize("seed", range(5))
def test_fullest_combination_against_all_subsets(seed):
    rng = random.Random(seed)
    items = [rng.randrange(1, 15) for _ in range(9)]
    room = rng.randrange(5, 40)
    best = max(s for r in range(10) for c in itertools.combinations(items, r) if (s := sum(c)) <= room)
    got = packing.fullest(Counter(items), room)
    assert sum(got) == best and not Counter(got) - Counter(items)


def test_bins_use_every_piece_once():
    rng = random.Random(9)
    histogram = Counter(rng.randrange(1, 1025) for _ in range(3000))
    used = Counter()
    for combination, times in packing.minimum_bin_slack(histogram):
        assert sum(combination) <= 1024
        for x in combination:
            used[x] += times
    assert used == histogram
    with pytest.raises(ValueError):
        packing.minimum_bin_slack({2000: 1})


def test_each_place_is_taken_once_over_many_parts(docs, spark):
    rows = packing.pack_documents(docs.repartition(9), JSON, capacity=64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    same = spark.range(500).selectExpr("id", "5L as length", "'x' as _part", "id as sequence_id").repartition(7)  # one length for all
    got = packing.pack(same, 64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 500 and len({r["sequence_id"] for r in got}) == -(-500 // 12)
    assert set(got[0].asDict()) == {"id", "length", "_part", "sequence_id", "offset"}


def test_fast_encoder_equals_the_library():
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    fast, plain = packing._coder(JSON), packing.PlainCoder(tokenizer)
    assert isinstance(fast, packing.RankCoder)
    rng = random.Random(3)
    vocab = [t for t in bpe.load_ranks(RANKS)]
    made = [b"".join(rng.choice(vocab) for _ in range(rng.randrange(1, 6))).decode("utf-8", "ignore") for _ in range(20_000)]
    for k in range(0, len(made), 200):
        text = " ".join(made[k : k + 200])
        assert np.array_equal(fast(text), plain(text))
    for text in ("", "a <|endoftext|> b", "x" * 5000, " " * 3000, "\u3000 \x85\x1c\r\n y", "中文" * 2000):
        assert np.array_equal(fast(text), plain(text))
    assert len(fast(" " * 2_000_000)) == len(plain(" " * 2_000_000))
    other = public_tokenizers.path("word_bpe_49k.json")
    assert isinstance(packing._coder(other), packing.PlainCoder)


# -- chat -------------------------------------------------------------------------------------

CONVERSATIONS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi <s> there"), (1, 2, "assistant", "yes </s>[INST] no [/INST]\\"),
    (2, 1, "assistant", "\\<\\/s> <\\s>"), (2, 0, "user", None), (3, 0, None, "text"), (3, 0, "assistant", ""), (None, 5, "assistant", "nameless"),
    (4, 0, "user", "a"), (4, 0, "user", "a"), (5, None, "user", "first"), (5, 0, "assistant", "é中😀" * 500),
]


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame(CONVERSATIONS, "conv_id bigint, turn bigint, role string, text string").withColumn("segment", F.lit("x"))


def test_conversations_read_back(talks):
    got = {r["conv_id"]: r for r in chat.conversation_digests(talks).collect()}
    by = {}
    for c, turn, role, text in CONVERSATIONS:
        by.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert len(got) == len(by)
    for c, turns in by.items():
        turns.sort()
        whole = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), whole)
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_segments_join_to_the_formatted_text(talks):
    parts = {}
    for r in chat.format_conversations(talks).collect():
        parts.setdefault(r["conv_id"], []).append((r["segment"], r["text"], r["in_generation"]))
    text = "".join(t for _, t, _ in sorted(parts[2]))
    assert text == "<s>[INST]user[/INST]</s>\n<s>[INST]assistant[/INST]" + chat.escape("\\<\\/s> <\\s>") + "</s>\n"
    digests = {r["conv_id"]: r["formatted_chars"] for r in chat.conversation_digests(talks).collect()}
    assert {c: sum(len(t) for _, t, _ in p) for c, p in parts.items()} == digests


def test_escaping_is_reversible_and_complete():
    rng = random.Random(2)
    alphabet = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/", "s>", "[", "]", "INST", "a", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


def render(source, **env):
    return "".join(t for t, _ in chat._render(chat.fold(chat.parse(source)), False)(env))


def test_template_language():
    assert render("{% for x in xs %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", xs=["a", "b", "c"]) == "1,2,3"
    assert render("{% set a = 'x' ~ 1 %}{{ a if n > 2 else 'no' }}", n=3) == "x1"
    assert render("{% if a == 1 %}one{% elif a == 2 %}two{% else %}other{% endif %}", a=2) == "two"
    assert render("a  {%- if true -%}  b  {%- endif %}") == "ab"
    assert render("{{ m['k'] | upper | default('z') }}{# note #}{{ m.nothing | default('z') }}", m={"k": "v"}) == "Vz"
    assert render("{{ '}}' }}{{ x and y or 'w' }}", x=0, y=1) == "}}w"


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' | upper }}{% if 1 < 2 %}c{% else %}{{ x }}{% endif %}d"))
    assert tree == ("block", (("text", "aBcd"),))


@pytest.mark.parametrize("source", ["{{ x.__class__() }}", "{{ open('f') }}", "{% include 'f' %}", "{{ x | system }}", "{% for x in y %}", "{{ x", "{% endif %}", "{{ 1 + }}", "{{ 'a' - 1 }}"])
def test_templates_outside_the_language(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


def test_objects_give_up_nothing():
    assert render("{{ x.__class__ }}{{ x.y }}", x=object()) == ""


# -- language model -----------------------------------------------------------------------------


def test_lm_base_scores(docs, texts):
    got = {r["doc_id"]: r for r in lm.lm_scores(docs, F.col("doc_id") % 5 != 1, head=20).collect()}
    counts, words = Counter(), {i: (t or "").encode().lower().split() + [b"\n"] for i, t in texts}
    for i in words:
        if i % 5 != 1:
            counts.update(words[i])
    total, types = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws))
        assert r["score"] < 0 and r["score"] > r["base_score"] - 2


def test_lm_filter_never_undercounts(spark):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    counts = rng.integers(1, 2000, len(keys))
    table = spark.createDataFrame([(int(b), *map(bytearray, lm._pack(keys[lm._bucket(keys, 4) == b], counts[lm._bucket(keys, 4) == b]))) for b in range(4)], lm._BLOB)
    for steps in (lm.FINE, lm.COARSE):
        filt = lm.build_filter(table, 4, steps)
        levels = lm._levels(counts, steps)
        assert (filt.count(keys) >= lm._value_of_level(steps)[levels] - 1e-9).all()
        assert np.mean(filt.count(keys) == lm._value_of_level(steps)[levels]) > 0.95
        assert np.mean(filt.count(rng.integers(0, 2**63, 5000, dtype=np.uint64)) == 0) > 0.95


def test_lm_filter_grows_with_its_levels(spark, monkeypatch):
    """No size of corpus drops n-grams of count 1 or takes bits from the levels."""
    monkeypatch.setattr(lm, "FILTER_BITS", 1 << 16, raising=False)  # the bound that there was
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**63, 60_000, dtype=np.uint64))
    counts = rng.integers(1, 3, len(keys))
    bucket = lm._bucket(keys, 4)
    table = spark.createDataFrame([(b, *map(bytearray, lm._pack(keys[bucket == b], counts[bucket == b]))) for b in range(4)], lm._BLOB)
    filt = lm.build_filter(table, 4, lm.COARSE)
    assert (filt.count(keys) >= 1).all()
    assert np.mean(filt.count(rng.integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)) > 0) < 0.04


def test_lm_scores_against_brute_force(spark, docs, texts, monkeypatch):
    """Levels that come back from the segments are those of the counts, but for rare false hits."""
    monkeypatch.setattr(lm, "SEGMENT", 300)  # many segments
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs, F.col("doc_id") % 5 != 1).collect()}
    words = {i: lm.words_of(t) for i, t in texts}
    single, pair = Counter(), Counter()
    for i in words:
        if i % 5 != 1:
            single.update(words[i])
            pair.update(zip([lm.END, *words[i][:-1]], words[i], strict=True))
    after = Counter(a for a, _ in pair)
    total, types = sum(single.values()), len(single)

    def value(n, steps):
        return float(lm._value_of_level(steps)[lm._levels(np.array([n]), steps)[0]]) if n else 0.0

    near = []
    for i, ws in words.items():
        a = b = 0.0
        for u, w in zip([lm.END, *ws[:-1]], ws, strict=True):
            p = (value(single[w], lm.FINE) + 0.5) / (total + 0.5 * (types + 1))
            n = max(value(single[u], lm.FINE), 1.0)
            rest = min(max(lm.DISCOUNT * value(after[u], lm.FINE) / n, 0.01), 1.0)
            found = min(max(min(value(pair[u, w], lm.COARSE), n) - lm.DISCOUNT, 0) / n, 1 - rest)
            a, b = a + math.log10(p), b + math.log10(min(found + rest * p, 1.0) if single[u] else p)
        top = max(a, b)
        near.append(abs(got[i] - (top + math.log10(0.5 * 10 ** (a - top) + 0.5 * 10 ** (b - top)))) / max(1, len(ws)))
    assert len(got) == len(texts) and np.median(near) < 0.02 and max(near) < 0.3


def test_lm_packed_tables_round_trip():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    k, c = lm._unpack(*lm._pack(keys, np.arange(len(keys))))
    assert (k == keys).all() and (c == np.arange(len(keys))).all()


def test_lm_prefers_seen_pairs(spark):
    rows = [(i, "the cat sat on the mat " * 5) for i in range(20)] + [(1000, "the cat sat on the mat"), (1001, "mat the on sat cat the")]
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") < 1000).collect()}
    assert got[1000] > got[1001] + 2


def test_empty_tables(no_docs, talks):
    assert bpe.bpe_encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    assert packing.pack_documents(no_docs, JSON).count() == 0
    assert chat.conversation_digests(talks.limit(0)).count() == 0
    assert chat.format_conversations(talks.limit(0)).count() == 0
    assert lm.lm_scores(no_docs, F.lit(True)).count() == 0


def test_lm_without_training_rows(docs, texts):
    got = lm.lm_scores(docs, F.lit(False)).collect()
    assert len(got) == len(texts) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in got)
