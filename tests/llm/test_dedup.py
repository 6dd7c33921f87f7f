"""Exact, near and substring dedup against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.llm import components, exact_dedup, simhash, suffix_dedup, verify


def test_exact_groups(docs, texts):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs, salts=3).collect()}
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(texts)
    for i, t in texts:
        same = groups[t or ""]
        want = (max(same), len(same), i == max(same), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == want


def test_exact_groups_with_and_without_hot_texts(spark, monkeypatch):
    """A third of the rows hold one text; HOT decides only how winners travel."""
    data = [(i, "hot" if i % 3 == 0 else f"t{i % 40}" if i % 3 == 1 else f"own {i}") for i in range(600)]
    frame = spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)
    groups = {}
    for i, t in data:
        groups.setdefault(t, []).append(i)
    want = {(i, max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in data}
    for hot in (1, 10, 4096):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        got = exact_dedup.exact_groups(frame).collect()
        assert len(got) == 600 and {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == want


def test_exact_dedup_keeps_rows_whole(docs, texts):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    last = {}
    for i, t in texts:
        last[t or ""] = max(i, last.get(t or "", -1))
    assert sorted(got) == sorted(last.values())
    by_id = dict(texts)
    assert all(got[i]["text"] == by_id[i] and got[i]["kept"] == i and got[i]["score"] == "x" for i in got)


def test_exact_dedup_of_repeated_and_nameless_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id bigint, text string")
    assert sorted(exact_dedup.exact_dedup(rows).collect(), key=str) == [(1, "a"), (None, "b")]
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(rows).collect())
    assert got == {(1, 1, 3, True): 2, (None, 1, 3, False): 1, (None, None, 2, True): 2}


def test_exact_dedup_plan_is_native(docs):
    for frame in (exact_dedup.exact_groups(docs), exact_dedup.exact_dedup(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def brute_fingerprint(text, k):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, max_bits):
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= max_bits:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("words", [4, 5])
def test_near_groups(docs, texts, words):
    got = {r["doc_id"]: r for r in simhash.near_groups(docs, words=words).collect()}
    values = [brute_fingerprint(t, words) for _, t in texts]
    ids = [i for i, _ in texts]
    root = roots(values, 4)
    for k, i in enumerate(ids):
        assert got[i]["fp"] & (2**64 - 1) == values[k]
        assert got[i]["component_id"] == min(ids[j] for j in range(len(ids)) if root[j] == root[k])


@pytest.mark.parametrize("block", [8, 2048])
@pytest.mark.parametrize("max_bits", [2, 4])
def test_links_of_dense_fingerprints(spark, max_bits, block):
    rng = random.Random(max_bits)
    centers = [rng.getrandbits(64) for _ in range(6)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centers for _ in range(50)}
    values = sorted(values | {rng.getrandbits(64) for _ in range(200)})
    frame = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp bigint")
    links = simhash.fingerprint_links(frame, max_bits, block)
    found = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in components.connected_components(links).collect()}
    root = roots(values, max_bits)
    classes = {}
    for k, v in enumerate(values):
        classes.setdefault(root[k], set()).add(v)
    got = {}
    for v in values:
        got.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))
    assert links.count() < 20 * len(values)


def test_thresholds_sum_to_the_pigeonhole_bound():
    for n, max_bits in itertools.product((10**3, 10**5, 10**7), (2, 4, 6)):
        shares = np.array([np.array([__import__("math").comb(8, e) for e in range(9)]) / 256] * 8)
        blocks = [list(range(8 * k, 8 * k + 8)) for k in range(8)]
        for m in range(2, 9):
            groups = np.array_split(np.arange(8), m)
            share = [np.ones(1) for _ in groups]
            for g, ks in enumerate(groups):
                for k in ks:
                    share[g] = np.convolve(share[g], shares[k])
            _, ts = simhash.allocate(n, share, [8 * len(g) for g in groups], max_bits)
            assert not ts or sum(ts) == max_bits - m + 1 and min(ts) >= -1
        assert simhash.plan(n, np.eye(64) * n / 2, blocks, shares, max_bits)


def shingles_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def similar_pairs(texts):
    """{(i, j): similarity} of rows with common shingles, exactly."""
    sets, held = [shingles_of(t) for t in texts], {}
    for k, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(k)
    met = {p for ks in held.values() if len(ks) > 1 for p in itertools.combinations(ks, 2)}
    return {(i, j): alike(sets[i], sets[j]) for i, j in met}


def test_near_dedup_of_given_documents_drops_only_similar_ones(spark):
    """Whole texts of a given table: each row that goes is connected to a row that stays by pairs of 0.8 and more; 9 in 10 such pairs are found."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    rows = [tuple(r) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]
    near = [p for p, j in similar_pairs([t for _, t in rows]).items() if j >= 0.8]
    kept = {r["doc_id"] for r in simhash.near_dedup(df, words=5).collect()}
    group = roots_of(len(rows), near)
    gone = [k for k, (i, _) in enumerate(rows) if i not in kept]
    stays = {group[k] for k, (i, _) in enumerate(rows) if i in kept}
    assert gone and all(group[k] in stays and any(k in p for p in near) for k in gone)
    should_go = {k for k in range(len(rows)) if group[k] != k}
    assert len(should_go & set(gone)) >= 0.9 * len(should_go)


def roots_of(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("block", [4, 1000])
def test_groups_in_doubt_are_compared_pair_by_pair(spark, block):
    """Chains in which proposed links do not hold, and pairs that no link proposed: as by all pairs."""
    rng = random.Random(block)
    sets, sigs = [], []
    for _ in range(6):
        core = rng.sample(range(10**6), 40)
        sig = rng.getrandbits(128)
        for _ in range(9):
            keep = set(rng.sample(core, 40 - rng.randrange(9))) | {rng.randrange(10**6) for _ in range(rng.randrange(4))}
            sets.append(np.array(sorted(keep), np.uint64))
            sigs.append(sig ^ sum(1 << b for b in rng.sample(range(128), 4)))
    n = len(sets)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(k, signed(v & (2**64 - 1)), signed(v >> 64)) for k, v in enumerate(sigs)], "node bigint, fp bigint, w1 bigint")
    given = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sets)], "node bigint, shingles binary")
    links = [(k, k + 1) for k in range(n - 1) if (k + 1) % 9] + [(8, 9)]  # a chain in each family, and one link between two
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    got = verify.verified_links(frame, nodes, ["fp", "w1"], given, 128, 0.8, block)
    root = {r["node"]: r["root"] for r in components.connected_components(got).collect()}
    exact = {k: set(s.tolist()) for k, s in enumerate(sets)}
    family = lambda k: 0 if k < 18 else k // 9
    near = [(i, j) for i, j in itertools.combinations(range(n), 2) if family(i) == family(j) and alike(exact[i], exact[j]) >= 0.8]
    assert [root.get(k, k) for k in range(n)] == roots_of(n, near)
    held = [p for p in links if alike(exact[p[0]], exact[p[1]]) >= 0.8]
    assert 0 < len(held) < len(links)


def test_sets_and_similarity():
    assert len(verify.shingle_set(None, 5)) == len(verify.shingle_set(" \n", 5)) == 0 and len(verify.shingle_set("A b", 5)) == 1
    assert verify.jaccard(verify.shingle_set("A b C", 5), verify.shingle_set("a B c", 5)) == 1.0
    a, b = (verify.shingle_set(t, 2) for t in ("a b c d e", "a b c d f"))
    assert verify.jaccard(a, b) == pytest.approx(3 / 5) and verify.jaccard(a, a[:0]) == 0.0 and verify.jaccard(a[:0], a[:0]) == 1.0


def test_near_dedup_against_brute_force(docs, texts):
    """All similar pairs within SURE_BITS are linked, and nothing that is not similar or beyond NEAR_BITS is."""
    kept = simhash.near_dedup(docs, words=5)
    assert kept.columns == docs.columns
    got = sorted(r["doc_id"] for r in kept.collect())
    sigs = [simhash.fingerprints(t, 5, simhash.WIDE) for _, t in texts]
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    sets = [shingles_of(t) for _, t in texts]

    def smallest(bits):
        up = list(range(len(texts)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, j in itertools.combinations(range(len(texts)), 2):
            if apart(sigs[i], sigs[j]) <= bits and alike(sets[i], sets[j]) >= simhash.SIMILARITY:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        groups = {}
        for k, (i, _) in enumerate(texts):
            groups.setdefault(root(k), []).append(i)
        return set(map(min, groups.values()))

    assert smallest(simhash.NEAR_BITS) <= set(got) <= smallest(simhash.SURE_BITS)
    assert len(got) == len(set(got))


@pytest.mark.parametrize("most", [0, 3])
def test_wide_links_are_complete_within_the_sure_bits(spark, most, monkeypatch):
    """For several numbers of signatures, that is for several choices of partitions."""
    rng = random.Random(most)
    for n, cost in ((150, 1e-6), (150, 1e4)):
        rows = []
        for k in range(n):
            v = rng.getrandbits(256)
            w = v ^ sum(1 << b for b in rng.sample(range(256), simhash.SURE_BITS - rng.randrange(most + 1)))
            rows += [(2 * k, v), (2 * k + 1, w)]
        words = [(i, *[((v >> 64 * p) & (2**64 - 1)) - (1 << 64 if v >> 64 * p + 63 & 1 else 0) for p in range(4)]) for i, v in rows]
        frame = spark.createDataFrame(words, "node bigint, fp bigint, w1 bigint, w2 bigint, w3 bigint")
        links = simhash.fingerprint_links(frame, simhash.SURE_BITS, 64, ("fp", "w1", "w2", "w3"), simhash.NEAR_BITS, cost)
        found = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
        assert found == {i: i // 2 * 2 for i in range(2 * n)}


def test_near_dedup_takes_ids_of_any_type_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [("b", text, 1, "x", 2), ("a", text, 2, "y", 3), ("c", "other words entirely and more of them", 3, "z", 4), (None, text, 4, "", 5)]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id string, text string, node int, _gone string, fp int"))
    assert sorted(got.collect(), key=str) == sorted((r for r in rows if r[0] != "b"), key=str)


def test_near_dedup_drops_similar_texts_and_leaves_others(spark):
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(60)]
    edited = []
    for t in base:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        edited.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(base)] + [(1000 + i, t) for i, t in enumerate(edited)] + [(None, base[0])]
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(range(60)) <= kept and None in kept
    assert len(kept) < 75  # most of the 60 edited copies go


def test_near_dedup_finds_texts_of_jaccard_08(spark):
    """Recall against the exact similarity of five-word shingles, from 0.8 on; unlike texts stay."""
    rng = random.Random(23)

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    base, edited, alike = [], [], []
    for k in range(120):
        w = [f"w{rng.randrange(5000)}" for _ in range(300)]
        e = list(w)
        for at in rng.sample(range(10, 290), 5 + k % 3 if k < 100 else 60):
            e[at] = f"x{rng.randrange(5000)}"
        a, b = shingles(w), shingles(e)
        base.append(w), edited.append(e), alike.append(len(a & b) / len(a | b))
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(1000 + i, " ".join(w)) for i, w in enumerate(edited)]
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    near = [i for i, j in enumerate(alike) if j >= 0.8]
    assert set(range(120)) <= kept and len(near) > 50
    assert sum(1000 + i not in kept for i in near) >= 0.9 * len(near)
    assert all(1000 + i in kept for i, j in enumerate(alike) if j < 0.8)


def test_components_of_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (60, 61), (61, 60), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 60: 60, 61: 60}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_repeats(data, length):
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("length, gram, group", [(400, 64, 4096), (60, 16, 4096), (60, 16, 2)])
def test_repeats_against_brute_force(docs, texts, length, gram, group):
    got = {r["doc_id"]: r for r in suffix_dedup.repeat_report(docs, length=length, gram=gram, group=group).collect()}
    want = brute_repeats([(t or "").encode() for _, t in texts], length)
    for (i, _), w in zip(texts, want, strict=True):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == w
        assert sum(s["e"] - s["s"] for s in got[i]["spans"]) == w[1]


def test_repeats_of_few_letters(spark):
    """Many overlapping, nested and periodic repeats around many anchors."""
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(5, 90))) for _ in range(12)]
    data = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 8))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string")
    want = brute_repeats([t.encode() for t in data], 60)
    for group in (2, 4096):
        got = {r["doc_id"]: r for r in suffix_dedup.repeat_report(rows, length=60, gram=16, group=group).collect()}
        assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(40)] == want


def test_suffix_order_equals_python_sort():
    rng = random.Random(3)
    data, groups = [], []
    for g in range(30):
        for _ in range(rng.randrange(1, 9)):
            data.append("".join(rng.choice("ab") for _ in range(60)).encode())
            groups.append(g)
    xhi = np.array([rng.randrange(0, 21) for _ in data])
    xlo = np.array([rng.randrange(0, int(h) + 1) for h in xhi])
    data = [d[: 40 - int(lo) + int(hi)] for d, lo, hi in zip(data, xlo, xhi, strict=True)]
    for exact in (False, True):
        batch = suffix_dedup.SuffixBatch(np.array(groups), data, xlo, xhi, 40, exact)
        forward = [data[i][int(xhi[i]) :] for i in range(len(data))]
        backward = [data[i][: int(xhi[i])][::-1] for i in range(len(data))]
        for suffixes, way in ((forward, True), (backward, False)):
            order = batch.sorted(way)
            assert [(groups[i], suffixes[i]) for i in order] == sorted((g, s) for g, s in zip(groups, suffixes, strict=True))


def test_hash_collisions_are_found(monkeypatch):
    data = [b"a" * 20 + bytes([65 + k]) + b"b" * 19 for k in range(4)]
    want = suffix_dedup.repeated_windows(np.zeros(4, int), data, np.zeros(4, int), np.full(4, 10), 30)
    monkeypatch.setattr(suffix_dedup, "_byte_codes", lambda: np.ones(256, np.uint64))  # all strings of one length collide
    assert (suffix_dedup.repeated_windows(np.zeros(4, int), data, np.zeros(4, int), np.full(4, 10), 30) == want).all()


def test_suffix_dedup_keeps_rows_and_characters(spark, docs, texts):
    got = suffix_dedup.suffix_dedup(docs, length=60, gram=16)
    assert got.columns == docs.columns and got.count() == len(texts)
    assert got.where("text is null").count() == docs.where("text is null").count()
    same = spark.createDataFrame([(1, "é" * 300), (2, "x" + "é" * 300)], "doc_id bigint, text string")
    assert [r["text"] for r in suffix_dedup.suffix_dedup(same, length=60, gram=16).orderBy("doc_id").collect()] == ["", "x"]


def test_suffix_dedup_leaves_columns_of_any_name_alone(spark):
    text = "".join(random.Random(6).choice("abcdefgh") for _ in range(200))
    rows = [(k, text + str(k), *(f"{n}{k}" for n in range(7))) for k in range(3)]
    names = ["_id", "_th", "_text", "_mid", "_kept", "spans", "_row"]
    frame = spark.createDataFrame(rows, "doc_id int, text string, " + ", ".join(f"{n} string" for n in names))
    got = suffix_dedup.suffix_dedup(frame, length=60, gram=16)
    assert got.columns == frame.columns
    assert sorted(got.collect()) == [(k, str(k), *(f"{n}{k}" for n in range(7))) for k in range(3)]
    assert suffix_dedup.repeat_report(frame, length=60, gram=16).count() == 3


def test_repeated_rows_are_copies_of_each_other(spark):
    text = "".join(random.Random(4).choice("abcdefgh") for _ in range(500))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text[:450]), (None, None)], "doc_id bigint, text string")
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.repeat_report(rows).collect())
    assert got == [(0, 0), (450, 450), (500, 500), (500, 500)]


def test_empty_tables(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert simhash.near_groups(no_docs).count() == 0
    assert simhash.near_dedup(no_docs).count() == 0
    assert suffix_dedup.repeat_report(no_docs).count() == 0
    assert suffix_dedup.suffix_dedup(no_docs).where(F.col("text").isNotNull()).count() == 0


def test_near_groups_broadcast_nothing_that_grows(spark, small):
    from strandlake.llm import simhash

    groups = simhash.near_groups(spark.read.parquet(f"{small}/documents.parquet"))
    groups.collect()
    assert "Broadcast" not in groups._jdf.queryExecution().toString()
