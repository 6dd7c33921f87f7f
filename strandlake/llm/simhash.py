"""SimHash near-dedup by a generalised pigeonhole.

Signatures of one or more words of 64 bits link where few bits differ.  Bits that vary
together are grouped into m partitions of whole 8-bit blocks.  By the general
pigeonhole principle, if the thresholds t_i (-1: not probed) of the partitions sum
to max_bits - m + 1, every pair within max_bits differs by at most t_i in some partition i.
Unequal thresholds are chosen by dynamic programming on estimated numbers of
probes and candidates, from statistics of *all* signatures:

* a table of how often two bits are set together says which bits correlate;
* a histogram of the 256 values of each block gives the exact distribution of the
  distance of two random fingerprints within the block; blocks of one partition
  are convolved.

Fingerprints that are probed into one bucket are verified in numpy.  A bucket of
more than ``block`` fingerprints is dealt to several tasks as pairs of blocks, so
no task holds an unbounded bucket.  Each task returns only a spanning forest of
the links it has verified: components are exact, and pairs are never multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, written
from .components import connected_components
from .verify import shingle_sets, verified_links

BITS = 64
BLOCK = 2048
SEED = 42


def _majority(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(text: str | None, words: int, wide: int = 0, seed: int = SEED) -> list[int]:
    """Majority fingerprint of the XXH64 hashes of all word shingles, repeats included; then
    ``wide`` more words of 64 bits from the same hashes, mixed anew for each."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \x20 \x09-\x0D only
    if not tokens:
        return [0] * (wide + 1)
    line = b" ".join(tokens)
    k = min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(tokens) - k + 1]
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        [digest(view[a:b], seed) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64, len(starts)
    )
    out = [_majority(hashes)]
    for n in range(wide):
        h = (hashes + np.uint64(0x9E3779B97F4A7C15 * (n + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(h ^ (h >> np.uint64(32))))
    return out


def fingerprint(text: str | None, words: int, seed: int = SEED) -> int:
    return fingerprints(text, words, 0, seed)[0]


def simhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, wide: int = 0) -> DataFrame:
    """id, fp bigint (64 bits as a signed number), w1.. for ``wide`` more; a null or blank text has zeros."""
    names = ["fp", *[f"w{n + 1}" for n in range(wide)]]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fingerprints(t, words, wide) for t in b.column(1).to_pylist()]
            fps = np.array(rows, np.uint64).reshape(-1, wide + 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(fps[:, n]) for n in range(wide + 1)]], names=schema.names)

    return df.select(col(id_col).alias("_id"), col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


# -- statistics of all fingerprints ------------------------------------------------


def _words(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Signatures of a batch, a row each."""
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]).view(np.uint64)


def _bit_statistics(fps: DataFrame, names: list[str]) -> tuple[int, np.ndarray]:
    """Number of signatures and the (bits x bits) counts of bits set together."""
    bits = BITS * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((bits, bits))
        for b in batches:
            x = np.unpackbits(_words(b, names).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(x), both + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits * bits + 1)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["cell", "n"])

    cells = fps.select(*names).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(bits * bits + 1, np.int64)
    for cell, n in cells.collect():  # bits x bits rows, whatever the input
        flat[cell] = n
    return int(flat[-1]), flat[:-1].reshape(bits, bits).astype(float)


def group_bits(n: int, both: np.ndarray, size: int = 8) -> list[list[int]]:
    """Blocks of ``size`` bits; each block starts with the free bit of the strongest link and grows by correlation."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, blocks = list(range(len(both))), []
    while free:
        rest = corr[np.ix_(free, free)]
        block = [free[int(rest.max(axis=1).argmax())]]
        while len(block) < size:
            others = [b for b in free if b not in block]
            block.append(max(others, key=lambda b: (corr[b, block].sum(), -b)))
        blocks.append(sorted(block))
        free = [b for b in free if b not in block]
    return blocks


def _values(sigs: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits (64 at most) of each signature as a number."""
    out = np.zeros(len(sigs), np.uint64)
    for i, b in enumerate(bits):
        out |= ((sigs[:, b // BITS] >> np.uint64(b % BITS)) & np.uint64(1)) << np.uint64(i)
    return out


def _block_distances(fps: DataFrame, names: list[str], blocks: list[list[int]]) -> np.ndarray:
    """Per block, the share of (ordered) pairs of signatures at distance 0..8 within the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(blocks), 256), np.int64)
        for b in batches:
            x = _words(b, names)
            for k, bits in enumerate(blocks):
                counts[k] += np.bincount(_values(x, bits).astype(np.int64), minlength=256)
        cell = np.arange(counts.size)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts.ravel())], names=["cell", "n"])

    counts = np.zeros(len(blocks) * 256)
    for cell, n in fps.select(*names).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect():
        counts[cell] = n
    apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)).astype(int)
    out = np.zeros((len(blocks), 9))
    for k, c in enumerate(counts.reshape(len(blocks), 256)):
        np.add.at(out[k], apart.ravel(), np.outer(c, c).ravel())
        out[k] /= max(out[k].sum(), 1)
    return out


def _cost(n: int, share: np.ndarray, width: int, t: int, pair_cost: float) -> float:
    """Rows dealt for a partition of threshold t (of two keys one bit apart, one is dealt), and the pairs they meet."""
    from math import comb

    if t < 0:
        return 0.0
    probes = 1 + sum(comb(width, e) / (2 if e == 1 else 1) for e in range(1, t + 1))
    return n * probes + pair_cost * n * n * float(share[: t + 1].sum()) / 2


def allocate(n: int, shares: list[np.ndarray], widths: list[int], max_bits: int, most: int = 3, pair_cost: float = 1.0) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost that sum to max_bits - m + 1, by dynamic programming."""
    m = len(widths)
    total = max_bits - m + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for share, width in zip(shares, widths, strict=True):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, min(most, width) + 1):
                got = (cost + _cost(n, share, width, t, pair_cost), [*ts, t])
                if used + t not in step or got[0] < step[used + t][0]:
                    step[used + t] = got
        best = step
    return best.get(total, (float("inf"), []))


def plan(n: int, both: np.ndarray, blocks: list[list[int]], distances: np.ndarray, max_bits: int, pair_cost: float = 1.0) -> list[tuple[list[int], int]]:
    """Partitions (bits, threshold): the cheapest over all numbers of partitions of neighbouring blocks."""
    found: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(2, len(blocks) + 1):
        groups = [list(g) for g in np.array_split(np.arange(len(blocks)), m)]
        bits = [[b for k in g for b in blocks[k]] for g in groups]
        if max(map(len, bits)) > BITS:  # a partition's bits are one key
            continue
        shares = []
        for g in groups:
            share = np.ones(1)
            for k in g:
                share = np.convolve(share, distances[k])
            shares.append(share)
        cost, ts = allocate(n, shares, [len(b) for b in bits], max_bits, pair_cost=pair_cost)
        if cost < found[0]:
            found = (cost, [(b, t) for b, t in zip(bits, ts, strict=True) if t >= 0])
    return found[1]


# -- probing and verifying -----------------------------------------------------------


def _probe_rows(fps: DataFrame, names: list[str], parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, probe, node, words...): each signature's own key, and for thresholds above 0 the keys around it."""
    schema = "part int, key bigint, probe boolean, " + ", ".join(f"{n} bigint" for n in ["node", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = _words(b, names)
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            for p, (bits, t) in enumerate(parts):
                own = _values(sigs, bits)
                for e in range(t + 1):
                    for flips in combinations(range(len(bits)), e):
                        mask = np.uint64(sum(1 << f for f in flips))
                        # of two keys that differ in one bit, the one that has it probes the other
                        has = (own & mask) != 0 if e == 1 else slice(None)
                        keys = (own ^ mask)[has].view(np.int64)
                        if size := len(keys):
                            head = [pa.array(np.full(size, p, np.int32)), pa.array(keys), pa.array(np.full(size, e > 0))]
                            yield pa.RecordBatch.from_arrays([*head, *[pa.array(c[has]) for c in cols]], names=["part", "key", "probe", "node", *names])

    return fps.select("node", *names).mapInArrow(run, schema)


class _Forest:
    """Union-find over the numbers 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class _Near:
    """Which signatures are near: at most ``bits`` differ in all words together."""

    def __init__(self, bits: int):
        self.bits = bits

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a, b: signatures along the last axis; the other axes are broadcast."""
        words = a.shape[-1]
        apart = np.bitwise_count(a[..., 0] ^ b[..., 0])
        if words > 1:
            apart += np.bitwise_count(a[..., 1] ^ b[..., 1])
        near = apart <= self.bits
        if words > 2 and near.any():  # two words tell most pairs apart
            at = np.nonzero(near)
            a, b = (np.broadcast_to(x, (*near.shape, words))[at][:, 2:] for x in (a, b))
            near[at] = apart[at] + np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= self.bits
        return near


#: Pairs that are compared at once.
TILE = 1_000_000


def _tree_links(own: np.ndarray, probes: np.ndarray, sigs: np.ndarray, near: _Near) -> list[tuple[int, int]]:
    """Spanning forest, as row numbers, of the verified links own x own and own x probes.

    Where many pairs are near, the sweep takes over, which does not list them.
    """
    rest, found, links = np.concatenate((own, probes)), [], 0
    step = max(1, TILE // len(own))
    for at in range(0, len(rest), step):
        i, j = np.nonzero(near(sigs[rest[at : at + step]][:, None, :], sigs[own][None, :, :]))
        i, j = rest[at + i], own[j]
        found.append(np.column_stack((i, j))[i != j])
        links += len(found[-1])
        if links > 8 * len(sigs):
            return _sweep_links(own, probes, sigs, near)
    forest = _Forest(len(sigs))
    return [(i, j) for i, j in np.concatenate(found).tolist() if forest.link(i, j)]


def _sweep_links(own: np.ndarray, probes: np.ndarray, sigs: np.ndarray, near: _Near) -> list[tuple[int, int]]:
    """The same for dense buckets: a row that has been reached is not compared as a partner again."""
    is_own = np.zeros(len(sigs), bool)
    is_own[own] = True
    left = np.ones(len(sigs), bool)
    links: list[tuple[int, int]] = []
    for s in range(len(sigs)):
        if not left[s]:
            continue
        left[s] = False
        queue = [s]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(left if is_own[i] else left & is_own)  # two probes do not link here
            if not len(rest):
                continue
            got = rest[near(sigs[rest], sigs[i][None, :])]
            left[got] = False
            links += [(i, j) for j in got.tolist()]
            queue += got.tolist()
    return links


def _verified(near: _Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple[np.ndarray, ...]]) -> list[tuple[int, int]]:
            probe, node, *words = (np.concatenate(c) for c in zip(*rows, strict=True))
            if len(node) < 2 or probe.all():
                return []
            # a row is one node; a node that is its bucket's own needs no probe into it
            order = np.lexsort((probe, node))
            order = order[np.append(True, node[order][1:] != node[order][:-1])]
            probe, node = probe[order], node[order]
            sigs = np.column_stack([w[order] for w in words]).view(np.uint64)
            own, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
            if len(node) < 2 or not len(own):
                return []
            return [(int(node[i]), int(node[j])) for i, j in _tree_links(own, probes, sigs, near)]

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            x = np.array(links, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

        last, rows, links = None, [], []
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            group = np.rec.fromarrays(cols[:3])
            cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
                if a == z:
                    continue
                if rows and group[a].item() != last:
                    links += done(rows)
                    rows = []
                last = group[a].item()
                rows.append(tuple(c[a:z] for c in cols[3:]))
            if len(links) > 50_000:
                yield out(links)
                links = []
        if rows:
            links += done(rows)
        if links:
            yield out(links)

    return run


def fingerprint_links(
    fps: DataFrame, max_bits: int = 4, block: int = BLOCK, names: tuple[str, ...] = ("fp",), link_bits: int | None = None, pair_cost: float = 1.0
) -> DataFrame:
    """Links (a, b) among nodes that connect all pairs of signatures within ``max_bits``.

    fps: the columns ``names`` (words of 64 bits) and node (fp itself where that column is absent), one row per
    node.  With ``link_bits`` above ``max_bits``, pairs that the probes meet link up to that distance too.
    """
    spark: SparkSession = fps.sparkSession
    names = list(names)
    if "node" not in fps.columns:
        fps = fps.withColumn("node", F.col("fp"))
    n, both = _bit_statistics(fps, names)
    if n < 2:
        return spark.createDataFrame([], "a bigint, b bigint")
    blocks = group_bits(n, both)
    parts = plan(n, both, blocks, _block_distances(fps, names, blocks), max_bits, pair_cost)
    rows = _probe_rows(fps, names, parts)
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("size"), F.count_if(~F.col("probe")).alias("own"))
    shared = sizes.where("size > 1 and own > 0").drop("own")
    met = rows.join(shared.hint("merge"), ["part", "key"])  # grows with the rows: not broadcast
    # A bucket is cut into blocks by hash; two blocks meet in the task of their pair.
    cuts = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), cuts).cast("int")
    other = F.explode(F.when(cuts <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), cuts - 1))).alias("_o")
    met = met.select("part", "key", "probe", "node", *names, cuts.alias("_c"), mine.alias("_m"), other)
    pair = (F.least("_m", "_o") * F.col("_c") + F.greatest("_m", "_o")).cast("int")
    dealt = met.select("part", "key", pair.alias("pair"), "probe", "node", *names)
    dealt = dealt.repartition("part", "key", "pair").sortWithinPartitions("part", "key", "pair")
    return dealt.mapInArrow(_verified(_Near(max_bits if link_bits is None else link_bits)), "a bigint, b bigint")


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4
) -> DataFrame:
    """One row per input row: id, fp, component_id (smallest id that links reach, itself included).

    Rows with equal fingerprints are linked; blank and null texts share fingerprint 0.  All joins are merges: what they
    join grows with the rows, and a broadcast would gather it in the driver.
    A null id takes part in links but never names a component, unless all ids of
    it are null.  An empty table gives an empty result.
    """
    marks = written(simhash(df, id_col, text_col, words))
    distinct = written(marks.groupBy("fp").agg(F.min(col(id_col)).alias("_least")))
    roots = connected_components(fingerprint_links(distinct, max_bits))
    named = distinct.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    of_fp = named.select("fp", "root").join(least.hint("merge"), "root").drop("root")
    return marks.join(of_fp.hint("merge"), "fp").select(col(id_col), "fp", "component_id")


#: near_dedup: further words of 64 bits, differing bits of all 256 up to which every pair is a candidate, and up to
#: which pairs that the probes meet are.  A Jaccard similarity of 0.8 is a cosine of 0.89, hence 39 of 256 bits on
#: average with a spread of 6.
WIDE, SURE_BITS, NEAR_BITS = 3, 31, 50
#: What comparing two signatures costs, as a share of dealing one row; chooses partitions, not results.
PAIR_COST = 0.005
SIMILARITY = 0.8


def near_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = SIMILARITY, sure_bits: int = SURE_BITS, near_bits: int = NEAR_BITS
) -> DataFrame:
    """The rows that stay: of each group of similar texts the row with the smallest id; all columns kept.

    Two texts are similar where the Jaccard similarity of their sets of ``words``-word shingles is ``similarity`` or
    more; a group is what such pairs connect.  Candidates come from signatures of 256 bits: the pigeonhole finds all
    pairs within ``sure_bits``, and each pair of up to ``near_bits`` that falls together in some partition; each is then
    compared on its sets (:mod:`.verify`).  A null or blank text has an empty set, and such texts are copies of each
    other, as are texts of equal signatures.  Ids may have any type that can be ordered.  Rows with a null id stay (they
    have no name to be dropped by); rows that repeat an id stay or go together.  An empty table gives an empty result;
    extra columns may have any name.
    """
    names = ["fp", *[f"w{n + 1}" for n in range(WIDE)]]
    id_, text = col(id_col), col(text_col)
    ids = df.select(id_.alias("_id"), text.cast("string").alias("_text")).where("_id is not null")
    marks = written(simhash(ids, "_id", "_text", words, WIDE))
    # nodes have names of their own, since ids may be of any type; written, so that the names last
    distinct = written(marks.groupBy(*names).agg(F.min("_id").alias("_least")).withColumn("node", F.monotonically_increasing_id()))
    links = fingerprint_links(distinct, sure_bits, BLOCK, tuple(names), near_bits, PAIR_COST)
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # a node's text is that of its smallest id; of rows that repeat the id, any with its signature would do
    asked = distinct.join(ends, "node").select("node", F.col("_least").alias("_id"))
    sets = written(shingle_sets(ids.join(asked, "_id"), words).dropDuplicates(["node"]))
    roots = connected_components(verified_links(links, distinct, names, sets, near_bits, similarity))
    named = distinct.join(roots, "node", "left").select(*names, "_least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("_least").alias("_keep"))
    keep = named.join(least, "root").select(*names, "_keep")
    gone = marks.join(keep, names).where(F.col("_id") != F.col("_keep")).select(F.col("_id").alias("_gone")).distinct()
    free = "_gone"
    while free in df.columns:
        free = "_" + free
    gone = gone.withColumnRenamed("_gone", free)
    return df.join(gone, id_ == col(free), "left_anti")
