"""Exact similarity of candidate pairs: the Jaccard similarity of shingle sets, also in groups of any size.

Signatures propose links, as spanning forests of their buckets.  Each link is compared on the sets of shingles of both
texts.  Where all links of a group hold, it is done.  Where one does not, another pair of the same group, which the
forest had left out, may still be similar: all its pairs with near signatures and not yet in one verified part are
compared then.  Large groups are dealt as pairs of blocks, so that no task holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

#: Members of a block of a group in doubt.
BLOCK = 1024


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; the whole of it, where it has fewer words; none of a blank one."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(tokens) - words + 1) if tokens else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(tokens[k : k + words])) for k in range(n)), np.uint64, n))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return both / (len(a) + len(b) - both)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) from (node, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, words).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.select("node", "_text").mapInArrow(run, "node bigint, shingles binary")


def _held(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def similar_links(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similar) for every link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [jaccard(_held(x.as_py()), _held(y.as_py())) >= least for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.bool_())], names=["a", "b", "similar"])

    end = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}"))
    met = links.join(end("a"), "a").join(end("b"), "b").select("a", "b", "_a", "_b")
    return met.mapInArrow(run, "a bigint, b bigint, similar boolean")


def cross_links(labels: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], bits: int, least: float) -> list[tuple[int, int]]:
    """Links (row numbers) that connect all similar pairs within ``bits`` whose labels differ; nearest signatures first."""
    up = {int(x): int(x) for x in np.unique(labels)}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    sizes, links = np.array(list(map(len, sets))), []
    for i in range(len(sets) - 1):
        apart = np.bitwise_count(sigs[i + 1 :] ^ sigs[i]).sum(axis=1, dtype=np.int64)
        low, high = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
        near = np.flatnonzero((apart <= bits) & (low >= least * high) & (labels[i + 1 :] != labels[i]))
        for j in (i + 1 + near[np.argsort(apart[near], kind="stable")]).tolist():
            p, q = root(int(labels[i])), root(int(labels[j]))
            if p != q and jaccard(sets[i], sets[j]) >= least:
                up[max(p, q)] = min(p, q)
                links.append((i, j))
    return links


def verified_links(links: DataFrame, nodes: DataFrame, names: list[str], sets: DataFrame, bits: int, least: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of exact similarity ``least`` or more, which connect what is connected by similar pairs.

    links: (a, b) proposed; nodes: (node, the words ``names`` of its signature); sets: (node, shingles).  The pairs that
    count are those of a group of proposed links whose signatures differ in ``bits`` or fewer.
    """
    told = written(similar_links(links, sets, least))
    sure = told.where("similar").select("a", "b")
    group = connected_components(links).withColumnRenamed("root", "grp")
    part = group.join(connected_components(sure), "node", "left").select("node", "grp", F.coalesce("root", "node").alias("label"))
    part = written(part)
    doubtful = part.groupBy("grp").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count("*").alias("size")).where("_lo <> _hi")
    rows = part.join(doubtful.select("grp", "size"), "grp").join(nodes.select("node", *names), "node").join(sets, "node")
    cuts = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), cuts).cast("int")
    dealt = rows.select("grp", "label", "node", *names, "shingles", cuts.alias("_c"), mine.alias("_m"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("_o"))
    pair = (F.least("_m", "_o") * F.col("_c") + F.greatest("_m", "_o")).cast("int")
    dealt = dealt.select("grp", pair.alias("pair"), "label", "node", *names, "shingles").repartition("grp", "pair").sortWithinPartitions("grp", "pair", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                labels, node = (np.array([r[k] for r in held], np.int64) for k in (0, 1))
                sigs = np.array([r[2:-1] for r in held], np.int64).view(np.uint64)
                found = cross_links(labels, sigs, [_held(r[-1]) for r in held], bits, least)
                ends = np.array([(node[i], node[j]) for i, j in found], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, k])) for k in (0, 1)], names=["a", "b"])

        key, held = None, []
        for b in batches:
            for grp, own, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (grp, own) != key:
                    yield from done()
                    key, held = (grp, own), []
                held.append(rest)
        yield from done()

    return sure.unionByName(dealt.mapInArrow(run, "a bigint, b bigint"))
