"""Suffix-array dedup: remove every byte of a string of ``length`` bytes that starts twice.

Sorting every suffix of a corpus is not needed to find its long repeats.

1. Winnowing.  Each window of ``length`` bytes names the least of its 64-byte grams
   (by polynomial hash, leftmost on ties) as its anchor.  The choice depends on
   the window's bytes alone, so equal windows have equal anchors at equal places.
   Neighbouring windows with one anchor are one *context*.
2. Contexts that are equal as a whole repeat as a whole.  They are found by counting, with map-side sums,
   however many there are: by a cryptographic digest (BLAKE2b, 128 bits), for which no two different texts
   are known, so that these are not compared byte by byte.
3. The rest of an anchor's contexts are sorted twice as suffixes: by what follows the
   anchor, and by what precedes it, read backwards.  The sort is a mergesort whose
   comparisons find the common extension by binary search on prefix polynomial hashes;
   the common extensions of neighbours are verified byte by byte, and a hash collision
   makes the batch start again with byte comparison.  A window repeats if some other
   context shares its left and its right part.
4. An anchor with more than ``GROUP`` contexts is not sorted in one task.  Its windows
   are cut into ever smaller ranges, and re-grouped by the bytes which all windows of a
   range share; whole ranges that are equal are settled by counting as in 2.  At a range
   of one window that decides.

Defined results: null counts as empty; rows that repeat id and text are copies of each
other; a null id is an id like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, col, whole_text, written

LENGTH, GRAM = 400, 64
#: Contexts of one anchor that are sorted in one task.
GROUP = 4096
#: Contexts that are sorted at once (whole anchors, hence up to GROUP more).
BATCH = 2048
#: Bytes that are hashed at once; positions in them take BUFFER_BITS bits.
BUFFER_BITS = 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(n, 1 << 16).bit_length()
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            np.multiply.accumulate(t, out=t)
            tables.append(t)
        _powers[:] = tables
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of code(byte_j) * BASE^j over j < i."""
    up, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_codes()[data] * up[: len(data)], out=out[1:])
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    return (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by prefix and suffix minima of blocks of w."""
    n = len(x) - w + 1
    whole = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    whole[: len(x)] = x
    blocks = whole.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def contexts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of the documents data[starts:ends]: document, first and last window, anchor, gram hash."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    p = prefix_hashes(data)
    _, down = _power_tables(len(data) + 1)
    n = len(data) - gram + 1
    hashes = _mixed((p[gram:] - p[:-gram]) * down[:n])
    mask = _U((1 << BUFFER_BITS + 1) - 1)
    keyed = (hashes & ~mask) | np.arange(n, dtype=np.uint64)
    anchor = (_sliding_min(keyed, length - gram + 1) & mask).astype(np.int64)
    doc = np.repeat(np.arange(len(starts)), np.maximum(ends - starts - length + 1, 0))
    first = np.cumsum(np.maximum(ends - starts - length + 1, 0))
    at = np.arange(len(doc)) - np.repeat(first - np.maximum(ends - starts - length + 1, 0), np.maximum(ends - starts - length + 1, 0)) + starts[doc]
    if not len(at):
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    a = anchor[at]
    cut = np.flatnonzero((a[1:] != a[:-1]) | (doc[1:] != doc[:-1])) + 1
    lo, hi = np.append(0, cut), np.append(cut, len(at)) - 1
    return doc[lo], at[lo], at[hi], a[lo], hashes[a[lo]]


def _buffers(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text number, offset in it, bytes) in lots of one buffer; long texts are cut with overlap."""
    size, lot, used = 1 << BUFFER_BITS, [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), size - length):
            part = t[at : at + size - 1]
            if used + len(part) > size:
                yield lot
                lot, used = [], 0
            lot.append((k, at, part))
            used += len(part)
    if lot:
        yield lot


_CONTEXT = "_id {id}, _th bigint, a bigint, lo bigint, hi bigint, h bigint, u1 bigint, u2 bigint"


def _all_contexts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()]
            for lot in _buffers(texts, length):
                joined = b"".join(part for _, _, part in lot)
                sizes = np.array([len(part) for _, _, part in lot])
                ends = np.cumsum(sizes)
                doc, lo, hi, a, h = contexts_of(np.frombuffer(joined, np.uint8), ends - sizes, ends, length, gram)
                shift = np.array([at for _, at, _ in lot]) - (ends - sizes)
                view = memoryview(joined)
                digest = b"".join(
                    hashlib.blake2b(view[x : y + length], digest_size=16, salt=(z - x).to_bytes(8, "little")).digest()
                    for x, y, z in zip(lo.tolist(), hi.tolist(), a.tolist(), strict=True)
                )
                u = np.frombuffer(digest, np.int64).reshape(-1, 2)
                row = pa.array(np.array([k for k, _, _ in lot])[doc])
                move = shift[doc]
                cols = [b.column(0).take(row), b.column(1).take(row)]
                cols += [pa.array(x) for x in (a + move, lo + move, hi + move, h.view(np.int64), u[:, 0], u[:, 1])]
                yield pa.RecordBatch.from_arrays(cols, names=["_id", "_th", "a", "lo", "hi", "h", "u1", "u2"])

    return rows.mapInArrow(run, _CONTEXT.format(id=rows.schema["_id"].dataType.simpleString()))


# -- suffix sort of the contexts of one batch of anchors ---------------------------------------


class SuffixBatch:
    """Contexts with their anchors: group, bytes, and the range of x = anchor - window start."""

    def __init__(self, group: np.ndarray, data: list[bytes], xlo: np.ndarray, xhi: np.ndarray, length: int, exact: bool = False):
        self.group, self.length, self.exact = group, length, exact
        self.xlo, self.xhi, self.n = xlo, xhi, len(data)
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        sizes = np.fromiter(map(len, data), np.int64, self.n)
        self.anchor = np.cumsum(sizes) - sizes + xhi
        self.left, self.right = xhi, length - xlo  # bytes before and from the anchor on
        self.prefix = None if exact else prefix_hashes(self.bytes)

    def _same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray, forward: bool) -> np.ndarray:
        a, b = self.anchor[i], self.anchor[j]
        if not forward:
            a, b = a - size, b - size
        p, down = self.prefix, _powers[1]
        return (p[a + size] - p[a]) * down[a] == (p[b + size] - p[b]) * down[b]

    def common(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """Common extension of the contexts i and j: binary search on prefix hashes."""
        room = self.right if forward else self.left
        most = np.minimum(room[i], room[j])
        if self.exact:
            return self._common_bytes(i, j, most, forward)
        lo, hi = np.zeros(len(i), np.int64), most.copy()
        while len(at := np.flatnonzero(lo < hi)):
            mid = (lo[at] + hi[at] + 1) // 2
            same = self._same(i[at], j[at], mid, forward)
            lo[at] = np.where(same, mid, lo[at])
            hi[at] = np.where(same, hi[at], mid - 1)
        return lo

    def _common_bytes(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for s in range(0, len(i), 1024):
            part = slice(s, s + 1024)
            reach = np.arange(int(most[part].max(initial=0)))[None, :]
            step = reach if forward else -1 - reach
            ok = reach < most[part, None]
            a = np.where(ok, self.anchor[i[part], None] + step, 0)
            b = np.where(ok, self.anchor[j[part], None] + step, 0)
            differ = ~ok | (self.bytes[a] != self.bytes[b])
            out[part] = np.where(differ.any(axis=1), differ.argmax(axis=1), most[part]) if reach.size else 0
        return out

    def _before(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """Whether suffix i sorts before suffix j (a prefix before what it begins)."""
        e = self.common(i, j, forward)
        room = self.right if forward else self.left
        ends_i, ends_j = e >= room[i], e >= room[j]
        step = e if forward else -1 - e
        x = self.bytes[np.where(ends_i, 0, self.anchor[i] + step)].astype(np.int64)
        y = self.bytes[np.where(ends_j, 0, self.anchor[j] + step)].astype(np.int64)
        return np.where(ends_i | ends_j, ends_i & ~ends_j, x < y)

    def sorted(self, forward: bool) -> np.ndarray:
        """The contexts of each group in suffix order: a bottom-up mergesort of all groups at once."""
        n = self.n
        begin = np.append(0, np.flatnonzero(self.group[1:] != self.group[:-1]) + 1)
        size = np.diff(np.append(begin, n))
        start, count = np.repeat(begin, size), np.repeat(size, size)
        order, local = np.arange(n), np.arange(n) - start
        run = 1
        while run < size.max(initial=0):
            mine = local // run
            there = (mine ^ 1) * run
            length = np.clip(count - there, 0, run)
            at = np.flatnonzero(length > 0)
            lo, hi = np.zeros(len(at), np.int64), length[at].copy()
            later = mine[at] % 2 == 1  # of equal suffixes, the one of the left run goes first
            while len(k := np.flatnonzero(lo < hi)):
                mid = (lo[k] + hi[k]) // 2
                own, other = order[at[k]], order[start[at[k]] + there[at[k]] + mid]
                first = np.where(later[k], ~self._before(own, other, forward), self._before(other, own, forward))
                lo[k], hi[k] = np.where(first, mid + 1, lo[k]), np.where(first, hi[k], mid)
            place = local.copy()
            place[at] = np.minimum(mine[at], mine[at] ^ 1) * run + (local[at] - mine[at] * run) + lo
            merged = np.empty_like(order)
            merged[start + place] = order
            order = merged
            run *= 2
        return order

    def neighbours(self, order: np.ndarray, forward: bool) -> np.ndarray:
        """Common extension of each context with the one sorted before it; -1 at the start of a group."""
        i, j = order[:-1], order[1:]
        e = self.common(i, j, forward)
        if not self.exact and (e != self._common_bytes(i, j, np.minimum(*((self.right if forward else self.left)[x] for x in (i, j))), forward)).any():
            raise HashCollision
        return np.append(-1, np.where(self.group[i] == self.group[j], e, -1))

    def repeated(self) -> np.ndarray:
        """(contexts x windows) whether another context of the group has the same window."""
        top = int(self.xhi.max(initial=0)) + 1
        x = np.arange(top)
        key = np.zeros((self.n, top), np.int64)
        for forward in (False, True):
            order = self.sorted(forward)
            e = self.neighbours(order, forward)
            need = self.length - x if forward else x
            classes = np.cumsum(e[:, None] < np.maximum(need, 0)[None, :], axis=0)
            classes += np.cumsum(e < 0)[:, None] * (need == 0)[None, :]  # groups stay apart where nothing is needed
            key[order] = key[order] * (self.n + 1) + classes
        valid = (x[None, :] >= self.xlo[:, None]) & (x[None, :] <= self.xhi[:, None])
        key[~valid] = -1 - np.nonzero(~valid)[0]
        rank = np.argsort(key, axis=0, kind="stable")
        ranked = np.take_along_axis(key, rank, axis=0)
        equal = ranked[1:] == ranked[:-1]
        pad = np.zeros((1, top), bool)
        out = np.zeros_like(valid)
        np.put_along_axis(out, rank, np.concatenate((pad, equal)) | np.concatenate((equal, pad)), axis=0)
        return out & valid


class HashCollision(Exception):
    """Two different strings have one polynomial hash."""


def repeated_windows(group: np.ndarray, data: list[bytes], xlo: np.ndarray, xhi: np.ndarray, length: int) -> np.ndarray:
    try:
        return SuffixBatch(group, data, xlo, xhi, length).repeated()
    except HashCollision:
        return SuffixBatch(group, data, xlo, xhi, length, exact=True).repeated()


# -- distributed steps ---------------------------------------------------------------------------

_COLUMNS = ["key", "_id", "_th", "a", "xlo", "xhi", "known", "data"]


def _schema(kind: str) -> str:
    return f"key bigint, _id {kind}, _th bigint, a bigint, xlo bigint, xhi bigint, known boolean, data binary"


def _extract(texts: DataFrame, kind: str, length: int) -> DataFrame:
    """The bytes of the contexts that a document lists in ``want``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for k, (text, want) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                data = text.encode("utf-8", "surrogatepass")
                for w in want:
                    a, lo, hi = w["a"], w["lo"], w["hi"]
                    for col, v in zip(rows, (k, w["h"], a, a - hi, a - lo, w["known"], data[lo : hi + length]), strict=True):
                        col.append(v)
                if len(rows[0]) >= 5000:
                    yield out(b, rows)
                    rows = [[] for _ in range(7)]
            yield out(b, rows)

    def out(b: pa.RecordBatch, rows: list[list]) -> pa.RecordBatch:
        at = pa.array(rows[0], pa.int64())
        ints = [pa.array(x, pa.int64()) for x in rows[1:5]]
        cols = [ints[0], b.column(0).take(at), b.column(1).take(at), *ints[1:], pa.array(rows[5], pa.bool_()), pa.array(rows[6], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=_COLUMNS)

    return texts.mapInArrow(run, _schema(kind))


def _sorted_groups(contexts: DataFrame, kind: str, length: int) -> DataFrame:
    """Intervals (_id, _th, s, e) that the suffix sort of each key's contexts finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(lots: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(lots).combine_chunks()
            key, a, xlo, xhi = (t.column(n).to_numpy() for n in ("key", "a", "xlo", "xhi"))
            group = np.cumsum(np.append(0, key[1:] != key[:-1]))
            found = repeated_windows(group, t.column("data").to_pylist(), xlo, xhi, length)
            found[t.column("known").to_numpy(zero_copy_only=False)] = False  # whole already
            edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, x1 = np.nonzero(edge == 1)
            _, x2 = np.nonzero(edge == -1)
            ids = t.column("_id").combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            cols = [ids.take(pa.array(row)), pa.array(t.column("_th").to_numpy()[row])]
            cols += [pa.array(a[row] - x2 + 1), pa.array(a[row] - x1 + length)]
            return pa.RecordBatch.from_arrays(cols, names=["_id", "_th", "s", "e"])

        lots: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            key = b.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)).tolist()
            at = 0
            for z in cuts:
                if size >= BATCH and key[at] != last:
                    yield done(lots)
                    lots, size = [], 0
                lots.append(b.slice(at, z - at))
                size += z - at
                last, at = key[at], z
        if lots:
            yield done(lots)

    dealt = contexts.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, f"_id {kind}, _th bigint, s bigint, e bigint")


def _refined(contexts: DataFrame, kind: str, cell: int, length: int) -> DataFrame:
    """Each context cut at a grid of ``cell`` windows; the new key is what all windows of a cell share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(8)]
            old, a, xlo, xhi, known, data = (b.column(n).to_pylist() for n in ("key", "a", "xlo", "xhi", "known", "data"))
            for k in range(b.num_rows):
                before = old[k].to_bytes(8, "little", signed=True)
                for first in range(xlo[k] // cell * cell, xhi[k] + 1, cell):
                    last = first + cell - 1
                    lo, hi = max(first, xlo[k]), min(last, xhi[k])
                    part = data[k][xhi[k] - hi : xhi[k] - lo + length]
                    shared = data[k][xhi[k] - first : max(xhi[k] - last + length, 0)]  # may be empty for short strings
                    key = hashlib.blake2b(shared, digest_size=8, salt=first.to_bytes(8, "little"), person=before).digest()
                    whole = hashlib.blake2b(part, digest_size=16, salt=lo.to_bytes(8, "little"), person=hi.to_bytes(8, "little")).digest()
                    new = (k, int.from_bytes(key, "little", signed=True), a[k], lo, hi, known[k], part, whole)
                    for col, v in zip(rows, new, strict=True):
                        col.append(v)
            at = pa.array(rows[0], pa.int64())
            ints = [pa.array(x, pa.int64()) for x in rows[1:5]]
            cols = [ints[0], b.column("_id").take(at), b.column("_th").take(at), *ints[1:]]
            cols += [pa.array(rows[5], pa.bool_()), pa.array(rows[6], pa.binary()), pa.array(rows[7], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*_COLUMNS, "whole"])

    return contexts.select(*_COLUMNS).mapInArrow(run, _schema(kind) + ", whole binary")


def _settled(contexts: DataFrame, kind: str, length: int, group: int) -> DataFrame:
    """Intervals from the contexts that are not whole repeats; anchors of any number of contexts."""
    found: list[DataFrame] = []
    for cell in (96, 24, 6, 1, 0):
        sizes = contexts.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("known")).alias("open"))
        sizes = sizes.where("n > 1 and open > 0")
        few = contexts.join(sizes.where(F.col("n") <= group).select("key"), "key", "left_semi")
        found.append(written(_sorted_groups(few.select(*_COLUMNS), kind, length)))
        hot = sizes.where(F.col("n") > group).select("key")
        if not cell or hot.isEmpty():
            break
        cut = written(_refined(contexts.join(hot, "key", "left_semi"), kind, cell, length))
        row = F.xxhash64("_id", "_th", "a", "xlo")
        same = cut.groupBy("key", "whole").agg(F.count("*").alias("c"), F.min(row).alias("rep"))
        told = written(cut.join(same, ["key", "whole"]).withColumn("first", row == F.col("rep")))
        found.append(told.where("c > 1 and not known").select("_id", "_th", (F.col("a") - F.col("xhi")).alias("s"), (F.col("a") - F.col("xlo") + length).alias("e")))
        contexts = written(told.where("c = 1 or first").withColumn("known", F.col("known") | (F.col("c") > 1)).select(*_COLUMNS))
        drop_written(cut)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def repeated_intervals(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(_id, _th, s, e): byte intervals of the texts in ``rows`` (_id, _th, _text) that repeat, not yet merged."""
    kind = rows.schema["_id"].dataType.simpleString()
    contexts = _all_contexts(rows.select("_id", "_th", "_text"), length, gram)
    row = F.xxhash64("_id", "_th", "a", "lo")
    whole = contexts.groupBy("h", "u1", "u2").agg(F.count("*").alias("c"), F.min(row).alias("rep"))
    kinds = whole.groupBy("h").agg(F.count("*").alias("kinds"), F.max("c").alias("most")).where("kinds > 1 or most > 1")
    shared = whole.join(kinds.select("h", "kinds"), "h").where("c > 1 or kinds > 1")
    told = written(contexts.join(shared, ["h", "u1", "u2"]).withColumn("known", F.col("c") > 1).withColumn("first", row == F.col("rep")))
    intervals = told.where("known").select("_id", "_th", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    wanted = told.where("kinds > 1 and (not known or first)")
    wanted = wanted.groupBy("_id", "_th").agg(F.collect_list(F.struct("h", "a", "lo", "hi", "known")).alias("want"))
    texts = _with(rows, wanted, "inner").select("_id", "_th", "_text", "want")
    bytes_of = written(_extract(texts, kind, length))
    return intervals.unionByName(_settled(bytes_of, kind, length, group))


def _with(rows: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Join marks to texts by (_id, _th); a null id is an id like any other."""
    marks = marks.withColumnRenamed("_id", "_mid").withColumnRenamed("_th", "_mth")
    return rows.join(marks, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_th") == F.col("_mth")), how).drop("_mid", "_mth")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(*_keys(id_col, text_col))


def _keys(id_col: str, text_col: str) -> list[Column]:
    text = whole_text(text_col)
    return [col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text")]


def merged(spans: list) -> list[list[int]]:
    """Maximal runs of the intervals."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in (() if spans is None else spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def repeat_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<s,e>> (bytes)."""
    rows = _keyed(df, id_col, text_col)
    spans = repeated_intervals(rows, length, gram, group).groupBy("_id", "_th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("s", pa.int64()), ("e", pa.int64())])
        for b in batches:
            out: list[tuple] = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data, runs = text.encode("utf-8", "surrogatepass"), merged(found)
                sha, at = hashlib.sha256(), 0
                for s, e in runs:
                    sha.update(data[at:s])
                    at = e
                sha.update(data[at:])
                out.append((len(data), sum(e - s for s, e in runs), len(runs), sha.hexdigest(), [{"s": s, "e": e} for s, e in runs]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pair)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=schema.names)

    return _with(rows, spans, "left").select("_id", "_text", "spans").mapInArrow(run, schema)


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """All rows and columns, with the repeated bytes taken out of the text.

    Only whole characters go: one that is only partly covered stays.  A null text stays null.  Other columns may have
    any name and come back as they are.
    """
    rows = df.select(F.struct(*[col(c) for c in df.columns]).alias("_row"), *_keys(id_col, text_col))
    spans = repeated_intervals(rows.select("_id", "_th", "_text"), length, gram, group).groupBy("_id", "_th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))

    @F.pandas_udf(T.StringType())
    def kept(texts, spans):
        out = []
        for text, found in zip(texts, spans, strict=True):
            if found is None or not len(found):
                out.append(text)
                continue
            data, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
            for s, e in merged(found):
                while s < len(data) and data[s] & 0xC0 == 0x80:
                    s += 1
                while e < len(data) and e > s and data[e] & 0xC0 == 0x80:
                    e -= 1
                parts.append(data[at:s])
                at = max(e, s)
            out.append(b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass"))
        import pandas as pd

        return pd.Series(out, dtype=object)

    joined = _with(rows, spans, "left").withColumn("_kept", kept("_text", "spans"))
    own = F.col("_row")
    return joined.select(*[F.when(own[c].isNotNull(), F.col("_kept")).alias(c) if c == text_col else own[c].alias(c) for c in df.columns])
