"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counts of words, of word pairs and of distinct successors come from all training
documents.  A count c is stored as its level, 1 + floor(steps * log2 c): the filter
holds (n-gram, 1), ..., (n-gram, level), and a count is read by probing levels
from 1 until one is missing.  The filter is cut into segments by a hash of
the n-gram; each segment is built in one task from its own n-grams, has ``BITS_PER_LEVEL``
bits for each level it stores, and stays in a written table.  More n-grams make more segments:
nothing is dropped and false hits stay as rare at every size.  No task and no driver
holds a whole filter: documents are written as lots of word numbers, the distinct n-grams of a lot go to
their segments, and the levels come back to the lot.

Pairs are smoothed by absolute discounting; a document's probability is the even
mixture of what the word model and the pair model give to the whole text, both from
probes of the filter alone.

The exact base score does not come from the filter: at most ``HEAD`` frequent words
are broadcast with their counts, all other words are joined with the count table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, col, written

#: Bits of a filter for each level that it stores, and bits that are set for one.
BITS_PER_LEVEL, PROBES = 8, 3
#: Words that are broadcast with their exact counts, at most.
HEAD = 100_000
#: N-grams of one segment, about.
SEGMENT = 500_000
#: Bytes of text in one lot of documents, about.
LOT = 4_000_000
#: Bits by which n-grams are told apart within a segment.
NAME_BITS = 40
DISCOUNT = 0.75
#: Levels for each doubling of a count: words and successors, pairs.
FINE, COARSE = 4, 1
END = b"\n"  # no word holds white space

_U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (A-Z only; cut at \\x20 and \\x09-\\x0D) and one end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 1) for w in words), np.uint64, len(words))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """32 bits of the first word and 32 bits of both: a pair's key names its first word's class."""
    both = _mix(first * _U(0x9E3779B97F4A7C15) + second)
    return (first & _U(0xFFFFFFFF00000000)) | (both >> _U(32))


def class_keys(first: np.ndarray) -> np.ndarray:
    return first & _U(0xFFFFFFFF00000000)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(keys ^ _U(0x5851F42D4C957F2D)) % _U(buckets)).astype(np.int64)


def _names(keys: np.ndarray) -> np.ndarray:
    """What of a key a segment's places hang on; shorter than a key, since it travels with every question.

    That two n-grams of a segment share a name is 10,000 times rarer than a false hit of the filter.
    """
    return _mix(keys ^ _U(0x2545F4914F6CDD1D)) >> _U(64 - NAME_BITS)


# -- packed tables of (key, count), dealt by bucket ------------------------------------------


def _squeeze(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    planes = x.view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _expand(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _squeeze(np.diff(keys, prepend=_U(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data, "<u8"), dtype=np.uint64)


def _pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    return _pack_keys(keys), _squeeze(counts.astype("<i8"))


def _unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _unpack_keys(keys), _expand(counts, "<i8")


def _summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


_BLOB = "bucket bigint, keys binary, counts binary"


def _blobs(keys: np.ndarray, counts: np.ndarray, buckets: int, by: Callable = lambda keys: keys) -> pa.RecordBatch:
    """One row for each bucket of sorted distinct keys; ``by`` is what of a key chooses the bucket."""
    bucket = _bucket(by(keys), buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, counts = bucket[order], keys[order], counts[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    packed = [_pack(k, c) for k, c in zip(np.split(keys, cuts[1:]), np.split(counts, cuts[1:]), strict=True)] if len(keys) else []
    cols = [pa.array(bucket[cuts]), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["bucket", "keys", "counts"])


def _merged(blobs: DataFrame) -> DataFrame:
    """One row per bucket, counts of equal keys added; a bucket holds about SEGMENT keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys, counts, size = -1, [], [], 0

        def out() -> pa.RecordBatch:
            k, c = _summed(np.concatenate(keys), np.concatenate(counts))
            p = _pack(k, c)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([p[0]], pa.binary()), pa.array([p[1]], pa.binary())], names=["bucket", "keys", "counts"])

        for b in batches:
            for bucket, k, c in zip(*b.columns, strict=True):  # one row at a time: a batch of packed rows is large
                if (bucket := bucket.as_py()) != last and keys:
                    yield out()
                    keys, counts, size = [], [], 0
                last = bucket
                k, c = _unpack(k.as_py(), c.as_py())
                keys.append(k), counts.append(c)
                size += len(k)
                if size > 2 * SEGMENT + 2 * len(keys[0]):  # partial sums keep a bucket near its final size
                    k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, size = [k], [c], len(k)
        if keys:
            yield out()

    return written(blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _BLOB))


# -- counting -----------------------------------------------------------------------------------


class _Lot:
    """Some documents as numbers of words, and each number's hash."""

    def __init__(self, words: list[bytes], number: np.ndarray, size: np.ndarray, learn: np.ndarray):
        self.words, self.number, self.size, self.learn = words, number, size, learn
        self.hash = word_hashes(words)
        self.end = np.cumsum(size)

    @classmethod
    def of_texts(cls, texts: list[str | None], learn: list[bool]) -> _Lot:
        index: dict[bytes, int] = {}
        put = index.setdefault
        numbers: list[int] = []
        sizes = []
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            numbers += [put(w, len(index)) for w in words]
        return cls(list(index), np.array(numbers, np.int64), np.array(sizes, np.int64), np.array(learn, bool))

    def row(self) -> list[bytes]:
        words = zstandard.ZstdCompressor(level=1).compress(b" ".join(self.words))  # no word holds a space
        return [words, _squeeze(self.number.astype("<i4")), _squeeze(self.size.astype("<i8")), self.learn.astype(np.uint8).tobytes()]

    @classmethod
    def of_row(cls, words: bytes, number: bytes, size: bytes, learn: bytes) -> _Lot:
        names = zstandard.ZstdDecompressor().decompress(words).split(b" ")
        return cls(names, _expand(number, "<i4").astype(np.int64), _expand(size, "<i8"), np.frombuffer(learn, np.uint8) == 1)

    def before(self) -> np.ndarray:
        """Number of the word before each word; an end's at the start of a text."""
        out = np.append(0, self.number[:-1])
        out[self.end - self.size] = self.words.index(END)
        return out

    def pairs(self) -> np.ndarray:
        return pair_keys(self.hash[self.before()], self.hash[self.number])

    def learned(self) -> np.ndarray:
        """Which words are of documents to learn from."""
        return np.repeat(self.learn, self.size)


_LOT = ["words", "number", "size", "learn"]


def _lots_of(batch: pa.RecordBatch) -> Iterator[_Lot]:
    """The lots of a batch whose last columns are those of a lot."""
    for row in zip(*(batch.column(n).to_pylist() for n in _LOT), strict=True):
        yield _Lot.of_row(*row)


def lots(texts: DataFrame) -> DataFrame:
    """(lot, ids, and the columns of a lot) over (id, text, learn); written, so that a lot keeps its name."""
    kind = texts.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId() << 40
        for b in batches:
            text, learn = b.column(1).to_pylist(), b.column(2).to_pylist()
            at = 0
            while at < len(text):
                to, held = at, 0
                while to < len(text) and held < LOT:
                    held += len(text[to] or "")
                    to += 1
                row = _Lot.of_texts(text[at:to], learn[at:to]).row()
                ids = b.column(0).slice(at, to - at)
                ids = pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([pa.array([lot], pa.int64()), ids, *[pa.array([x], pa.binary()) for x in row]], names=["lot", "ids", *_LOT])
                lot += 1 << 20  # rows of a lot are numbered on from its name
                at = to

    schema = T.StructType([T.StructField("lot", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *[T.StructField(n, T.BinaryType()) for n in _LOT]])
    return written(texts.mapInArrow(run, schema))


def word_counts(of: DataFrame) -> DataFrame:
    """(word binary, n) over the lots' documents to learn from, ends included; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lot in _lots_of(b):
                n = np.bincount(lot.number[lot.learned()], minlength=len(lot.words))
                met = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(lot.words, pa.binary()).take(pa.array(met)), pa.array(n[met])], names=["word", "n"])

    return written(of.select(*_LOT).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")))


def pair_counts(of: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            for lot in _lots_of(b):
                held.append(lot.pairs()[lot.learned()])
                if sum(map(len, held)) > 1_000_000:
                    yield _blobs(*_summed(np.concatenate(held), None), buckets)
                    held = []
        if held:
            yield _blobs(*_summed(np.concatenate(held), None), buckets)

    return _merged(of.select(*_LOT).mapInArrow(run, _BLOB))


def _word_blobs(counts: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = [], []
        for b in batches:
            keys.append(word_hashes(b.column(0).to_pylist())), n.append(b.column(1).to_numpy())
        if keys:
            yield _blobs(*_summed(np.concatenate(keys), np.concatenate(n)), buckets, class_keys)  # with the word's successors

    return _merged(counts.select("word", "n").mapInArrow(run, _BLOB))


def _successor_blobs(pairs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                yield _blobs(*_summed(class_keys(_unpack(k, c)[0]), None), buckets)

    return _merged(pairs.mapInArrow(run, _BLOB))


# -- the filter -----------------------------------------------------------------------------------


def _levels(counts: np.ndarray, steps: int) -> np.ndarray:
    return 1 + np.floor(steps * np.log2(np.maximum(counts, 1)) + 1e-9).astype(np.int64)


def _value_of_level(steps: int, most: int = 400) -> np.ndarray:
    """Count that a level stands for; level 0 is no count."""
    level = np.arange(most)
    lo = np.ceil(2.0 ** ((level - 1) / steps) - 1e-9)
    hi = np.maximum(np.ceil(2.0 ** (level / steps) - 1e-9) - 1, lo)
    out = np.sqrt(lo * hi)
    out[0] = 0
    return out


def _places(keys: np.ndarray, level: int | np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = _mix(keys + np.asarray(level, np.uint64) * _U(0xD6E8FEB86659FD93))
    step = _mix(h) | _U(1)
    for _ in range(PROBES):
        yield (((h >> _U(32)) * _U(bits)) >> _U(32)).astype(np.int64)  # scaled down to 0..bits-1 without a division
        h = h + step


class Segment:
    """One segment's bits."""

    def __init__(self, data: bytes):
        self.data, self.bits = np.frombuffer(data, np.uint8), 8 * len(data)

    @staticmethod
    def of_levels(names: np.ndarray, level: np.ndarray) -> bytes:
        bits = max(1024, -(-int(level.sum()) * BITS_PER_LEVEL // 8) * 8)
        on = np.zeros(bits, bool)
        for k in range(1, int(level.max(initial=0)) + 1):
            for place in _places(names[level >= k], k, bits):
                on[place] = True
        return np.packbits(on, bitorder="little").tobytes()

    def levels(self, names: np.ndarray) -> np.ndarray:
        """Levels of the keys of these names, by probing 1, 2, ... until one is missing."""
        level = np.zeros(len(names), np.uint8)  # 2^63 has level 253
        alive = np.arange(len(names))
        for k in range(1, 256):
            ok = np.ones(len(names), bool)
            for place in _places(names, k, self.bits):
                ok &= (self.data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            names, alive = names[ok], alive[ok]
            if not len(alive):
                break
            level[alive] = k
        return level


class LogFrequencyFilter:
    """A written table (bucket, data) of segments; one bucket of n-grams in each."""

    def __init__(self, table: DataFrame, segments: int, steps: int):
        self.table, self.segments = table, segments
        self.values = _value_of_level(steps)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Counts as quantised, of a few keys; segments are read one after the other."""
        distinct, at = np.unique(keys, return_inverse=True)
        bucket = _bucket(distinct, self.segments)
        level = np.zeros(len(distinct), np.int64)
        for no, data in self.table.toLocalIterator():
            mine = bucket == no
            level[mine] = Segment(data).levels(_names(distinct[mine]))
        return self.values[level][at]


def build_filter(table: DataFrame, segments: int, steps: int) -> LogFrequencyFilter:
    """Filter of a merged table; each segment is made in a task and has bits for all of its levels."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                keys, counts = _unpack(k, c)
                data = Segment.of_levels(_names(keys), _levels(counts, steps))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([data], pa.binary())], names=["bucket", "data"])

    return LogFrequencyFilter(written(table.mapInArrow(segment, "bucket bigint, data binary")), segments, steps)


class LanguageModel:
    """The three filters, and N and V of the training tokens.

    Words and successors have as many segments, dealt by the word's class.
    """

    def __init__(self, words: LogFrequencyFilter, pairs: LogFrequencyFilter, successors: LogFrequencyFilter, tokens: int, types: int):
        self.words, self.pairs, self.successors, self.tokens, self.types = words, pairs, successors, tokens, types

    def levels(self, of: DataFrame) -> DataFrame:
        """(lot, levels): for each lot (kind, bucket, levels of its keys, of its classes).

        Kind 0 are words, kind 1 pairs.  A lot's distinct n-grams are sent to the task that has their segment.
        """
        segments = (self.words.segments, self.pairs.segments)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lot_id, lot in zip(b.column("lot").to_pylist(), _lots_of(b), strict=True):
                    for kind, keys in enumerate((np.unique(lot.hash), np.unique(lot.pairs()))):
                        bucket, _, sent = _dealt(keys, kind, segments[kind])
                        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                        data = [_pack_keys(k) for k in np.split(sent, cuts[1:])]
                        head = [pa.array(np.full(len(cuts), kind, np.int32)), pa.array(bucket[cuts]), pa.array(np.full(len(cuts), lot_id))]
                        yield pa.RecordBatch.from_arrays([*head, pa.array(data, pa.binary())], names=["kind", "bucket", "lot", "data"])

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, waiting = None, {}, []

            def told() -> Iterator[pa.RecordBatch]:
                """Answers to all that waits for the segments at hand; a word of many lots is looked up once."""
                if not waiting:
                    return
                lots_of, sent = [lot for lot, _ in waiting], [k for _, k in waiting]
                keys, ends = np.concatenate(sent), np.cumsum([len(k) for k in sent])[:-1]
                waiting.clear()
                none = lambda k: np.zeros(len(k), np.uint8)
                if at[0]:
                    found = [held[-1].levels(keys) if -1 in held else none(keys)]
                else:
                    words, place = np.unique(keys, return_inverse=True)
                    each = [held[-1].levels(_names(words)) if -1 in held else none(words), held[-2].levels(_names(class_keys(words))) if -2 in held else none(words)]
                    found = [x[place] for x in each]
                parts = [_squeeze(np.concatenate(p)) for p in zip(*[np.split(x, ends) for x in found], strict=True)]
                cols = [pa.array(lots_of, pa.int64()), pa.array([at[0]] * len(parts), pa.int32()), pa.array([at[1]] * len(parts), pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["lot", "kind", "bucket", "levels"])

            for b in batches:
                for kind, bucket, lot, data in zip(*b.columns, strict=True):
                    kind, bucket, lot, data = kind.as_py(), bucket.as_py(), lot.as_py(), data.as_py()
                    if (kind, bucket) != at:
                        yield from told()
                        at, held = (kind, bucket), {}
                    if lot < 0:
                        held[lot] = Segment(data)
                        continue
                    waiting.append((lot, _unpack_keys(data)))
                    if sum(len(k) for _, k in waiting) > SEGMENT or len(waiting) >= 1000:
                        yield from told()
            yield from told()

        rows = of.select("lot", *_LOT).mapInArrow(ask, "kind int, bucket bigint, lot bigint, data binary")
        for kind, lot, filt in ((0, -1, self.words), (0, -2, self.successors), (1, -1, self.pairs)):
            held = filt.table.select(F.lit(kind).alias("kind"), "bucket", F.lit(lot).cast("bigint").alias("lot"), "data")
            rows = rows.unionByName(held)
        dealt = rows.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "lot")
        found = dealt.mapInArrow(answer, "lot bigint, kind int, bucket bigint, levels binary")
        return found.groupBy("lot").agg(F.sort_array(F.collect_list(F.struct("kind", "bucket", "levels"))).alias("levels"))

    def formula(self) -> Callable[[_Lot, list[dict]], np.ndarray]:
        """What makes log10 probabilities of a lot's texts of its levels; numbers only, no tables."""
        tokens, types, fine, coarse = self.tokens, self.types, self.words.values, self.pairs.values
        segments = (self.words.segments, self.pairs.segments)

        def scores(lot: _Lot, levels: list[dict]) -> np.ndarray:
            got, places = [], []
            for kind, asked in enumerate((lot.hash, lot.pairs())):
                keys, place = np.unique(asked, return_inverse=True)
                _, order, _ = _dealt(keys, kind, segments[kind])
                parts = [_expand(x["levels"], "u1").reshape(2 - kind, -1) for x in levels if x["kind"] == kind]
                level = np.empty((2 - kind, len(keys)), np.uint8)
                level[:, order] = np.concatenate(parts, axis=1)
                got.append(level), places.append(place)
            count, after = fine[got[0][0]][places[0]], fine[got[0][1]][places[0]]
            before, now = lot.before(), lot.number
            single = (count + 0.5) / (tokens + 0.5 * (types + 1))
            context = np.maximum(count[before], 1.0)
            seen = np.minimum(coarse[got[1][0]][places[1]], context)
            rest = np.clip(DISCOUNT * after[before] / context, 0.01, 1.0)  # what discounting leaves to unseen pairs
            found = np.minimum(np.maximum(seen - DISCOUNT, 0) / context, 1 - rest)
            pair = np.where(count[before] > 0, found + rest * single[now], single[now])
            start = lot.end - lot.size
            a = np.add.reduceat(np.log10(single[now]), start)
            b = np.add.reduceat(np.log10(np.minimum(pair, 1.0)), start)
            top = np.maximum(a, b)
            return top + np.log10(0.5 * 10.0 ** (a - top) + 0.5 * 10.0 ** (b - top))

        return scores


def _dealt(keys: np.ndarray, kind: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted distinct keys: buckets in order, the order that keys have in them, and what is sent of them in that order.

    A word is sent by its key, which names its class too, a pair by its name.
    """
    if not kind:
        bucket = _bucket(class_keys(keys), segments)
        order = np.argsort(bucket, kind="stable")
        return bucket[order], order, keys[order]
    bucket, names = _bucket(keys, segments), _names(keys)
    if segments < 1 << (64 - NAME_BITS):
        order = np.argsort((bucket.astype(np.uint64) << _U(NAME_BITS)) | names)
    else:
        order = np.lexsort((names, bucket))
    return bucket[order], order, names[order]


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The words of the highest count levels, ``most`` at most, with their counts.

    A histogram of levels (a few hundred rows) says from which count on; nothing is sorted.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    by_level = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True)
    taken, least = 0, None
    for at, words in by_level:
        if taken + words > most:
            break
        taken, least = taken + words, at
    if least is None:
        return {}
    top = counts.where(level >= least).toArrow()
    return dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True))


def train(of: DataFrame) -> tuple[LanguageModel, DataFrame]:
    """The model of the lots' documents to learn from, and their exact word counts (written)."""
    counts = word_counts(of)
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    filters = []
    segments = lambda n: max(4, -(-n // SEGMENT))
    of_words = segments(tokens // 4)  # not by distinct words, as all lots ask for the frequent ones
    word_table = _word_blobs(counts, of_words)
    filters.append(build_filter(word_table, of_words, FINE))
    pairs = pair_counts(of, segments(tokens))
    filters.append(build_filter(pairs, segments(tokens), COARSE))
    successors = _successor_blobs(pairs, of_words)
    filters.append(build_filter(successors, of_words, FINE))
    for t in (word_table, pairs, successors):
        drop_written(t)
    return LanguageModel(*filters, tokens, types), counts


def lm_scores(df: DataFrame, train_where: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens, base_score, score.

    ``train_where`` chooses the rows that are learned from (null: not).  A null text counts as
    empty: it has one token, its end.  Repeated rows and null ids count each.  Without training
    tokens every word has the same probability of 1 in the base score.  Texts of any length are whole (a lot of
    documents has one at least); an empty table gives an empty result; other columns take no part.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit("")).alias("_text")
    of = lots(df.select(col(id_col).alias("_id"), text, F.coalesce(train_where.cast("boolean"), F.lit(False)).alias("_learn")))
    model, counts = train(of)
    shared = df.sparkSession.sparkContext.broadcast(frequent_words(counts, head))
    scores = model.formula()
    total = model.tokens + 0.5 * (model.types + 1)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, row bigint, n_tokens bigint, known bigint, base double, score double, words array<binary>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for b in batches:
            for k, lot in enumerate(_lots_of(b)):
                ids, first, levels = b.column("ids")[k].values, b.column("lot")[k].as_py(), b.column("levels")[k].as_py()
                docs = len(lot.size)
                exact = np.fromiter((top.get(w, -1) for w in lot.words), np.int64, len(lot.words))
                start = lot.end - lot.size
                each = exact[lot.number]
                common = each >= 0
                logs = np.where(common, np.log10((np.maximum(each, 0) + 0.5) / total), 0.0)
                doc = np.repeat(np.arange(docs), lot.size)
                # the other words of each document, with how often they stand in it
                rest, times = np.unique(doc[~common] * len(lot.words) + lot.number[~common], return_counts=True)
                offsets = np.searchsorted(rest // len(lot.words), np.arange(docs + 1)).astype(np.int32)
                names = pa.array(lot.words, pa.binary()).take(pa.array(rest % len(lot.words)))
                cols = [ids, pa.array(first + np.arange(docs)), pa.array(lot.size), pa.array(np.add.reduceat(common.astype(np.int64), start))]
                cols += [pa.array(np.add.reduceat(logs, start)), pa.array(scores(lot, levels))]
                cols += [pa.ListArray.from_arrays(pa.array(offsets), names), pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "row", "n_tokens", "known", "base", "score", "words", "times"])

    scored = written(of.join(model.levels(of), "lot").mapInArrow(run, schema))
    for t in (of, model.words.table, model.pairs.table, model.successors.table):
        drop_written(t)
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = rare.join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    sums = met.groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((n + 0.5) / F.lit(total))).alias("more"),
    )
    both = scored.drop("words", "times").join(sums, "row", "left")
    return both.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
