"""Which tokens of two tokenizers stand for the same bytes: a dictionary of groups, interned once.

Byte offsets where a token of both tokenizers ends cut a text into groups; tokens of one group whose byte ranges overlap
are linked.  What a group holds is told by its ids alone, so everything about it is worked out once:

1. a task reads documents in lots of ``LOT_BYTES`` of text.  A text is cut before each space that follows a character
   other than white space: neither tokenizer has a token across such a place, so each distinct chunk of a lot is
   encoded once.  The lot's distinct groups get numbers, with their frequencies; a document keeps its chunks' numbers;
2. the groups of all lots meet by their ids: the dictionary of distinct groups, with frequencies added up;
3. links are expanded once for each distinct group, and multiplied by its frequency (or by the number of documents
   that hold it): the counts of all id pairs, and for each B id the highest of them;
4. what each group sums to goes back to the lots by group, and each lot adds it up for its documents.

A lot is at most ``LOT_BYTES`` of text and one document more.  A frequent group is one row for each lot; a frequent id
pair is one row for each distinct group that holds it, and skewed joins of those are left to Spark to split.

Defined results: a text that is null or empty, or whose tokens do not spell a space and the text in either tokenizer
(as where it holds U+2581), has no tokens: zeros and an empty digest.  Rows that repeat, and null ids, count each by
themselves.  An empty table gives an empty result.  Other columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, whole_text, written
from .packing import RankCoder, _coder, byte_letters

LOT_BYTES = 8 << 20
#: Text whose new chunks are encoded at once.
LEARN_BYTES = 1 << 18
#: Chunks that a worker remembers between lots.
CACHE = 300_000
#: Before a space that follows something else than white space.
CUT = re.compile(r"(?<=\S)(?= )")

_pairs: dict[tuple[str, str], Encoders] = {}

#: Of a chunk: its groups as one text, its groups, numbers of tokens; None where its tokens do not spell it.
Known = tuple[str, tuple[str, ...], int, int] | None


class _Names(dict):
    """From the ids of a group (32 bits each, -1 between those of A and of B) to its text."""

    def __missing__(self, data: bytes) -> str:
        ids = np.frombuffer(data, np.int32)
        at = int(np.flatnonzero(ids < 0)[0])
        name = intern(f"{','.join(map(str, ids[:at].tolist()))}|{','.join(map(str, ids[at + 1 :].tolist()))}")
        if len(self) < CACHE:
            self[data] = name
        return name


class Encoders:
    """Tokenizer A (byte-level, the ``tokenizers`` file format) and B (a sentencepiece model)."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = _coder(a_path), SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.a_sizes, self.b_sizes = np.array(self.a_size, np.int64), np.array(self.b_size, np.int64)
        self.names = _Names()
        self.number = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.spells = isinstance(self.a, RankCoder)  # its tokens are the bytes of any text
        self.young: dict[str, Known] = {}
        self.old: dict[str, Known] = {}

    def known(self, chunks: list[str]) -> list[Known]:
        """What is known of chunks, each of which begins with a space; the last ``CACHE`` of them are remembered."""
        old, young = self.old, self.young
        new = [c for c in chunks if c not in young and c not in old]
        for c in chunks:
            if c in old:
                young[c] = old.pop(c)
        if " " in new:  # the space that ends a text; the library adds none to an empty text
            new.remove(" ")
            young[" "] = self._cut(" ", self._a_ids(" "), [self.b.piece_to_id("▁")])
        ids = self.b.encode([c[1:] for c in new], num_threads=1) if new else []
        found = self._cut_all(new, ids) if self.spells else {}
        for c, b in zip(new, ids, strict=True):
            young[c] = found[c] if c in found else self._cut(c, self._a_ids(c), b)
        out = [young[c] for c in chunks]
        if len(young) > CACHE // 2:
            self.old, self.young = young, {}
        return out

    def _a_ids(self, chunk: str) -> list[int]:
        if self.spells:
            try:
                return self.a.encoding.encode_ordinary(chunk)
            except ValueError:  # refused for its length
                pass
        return self.a(chunk).tolist()

    def _cut(self, chunk: str, a: list[int], b: list[int]) -> Known:
        text = chunk.encode("utf-8", "surrogatepass")
        if b"".join(map(self.b_bytes.__getitem__, b)) != text or not self.spells and b"".join(map(self.a_bytes.__getitem__, a)) != text:
            return None
        said, join = self.number.__getitem__, ",".join
        if len(a) == 1 or len(b) == 1:
            whole = f"{join(map(said, a))}|{join(map(said, b))}"
            return whole, (whole,), len(a), len(b)
        a_size, b_size = self.a_size, self.b_size
        out, j, at_a, at_b, first_a, first_b = [], 0, 0, 0, 0, 0
        for i, x in enumerate(a):
            at_a += a_size[x]
            while at_b < at_a:
                at_b += b_size[b[j]]
                j += 1
            if at_a == at_b:
                out.append(f"{join(map(said, a[first_a : i + 1]))}|{join(map(said, b[first_b:j]))}")
                first_a, first_b = i + 1, j
        return ";".join(out), tuple(map(intern, out)), len(a), len(b)

    def _cut_all(self, chunks: list[str], ids: list[list[int]]) -> dict[str, Known]:
        """What :meth:`_cut` says of chunks, given their B ids, all at once; some or all may be left out.

        Chunks that do not end in white space are encoded in one string, since no token of A goes across their ends.
        Left out are the others, and those whose B ids do not have as many bytes.
        """
        texts = [c.encode("utf-8", "surrogatepass") for c in chunks]
        size, n_b = np.array(list(map(len, texts)), np.int64), np.array(list(map(len, ids)), np.int64)
        b = np.array(list(chain.from_iterable(ids)), np.int64)
        end_b = np.append(0, np.cumsum(self.b_sizes[b]))
        last_b = np.cumsum(n_b)
        use = (end_b[last_b] - end_b[last_b - n_b] == size) & (n_b > 0) & ~np.array([c[-1:].isspace() for c in chunks], bool)
        if not use.all():
            b = b[np.repeat(use, n_b)]
            chunks, texts = ([x for x, u in zip(xs, use.tolist(), strict=True) if u] for xs in (chunks, texts))
            size, n_b = size[use], n_b[use]
        if not chunks:
            return {}
        whole = b"".join(texts)
        try:
            a = np.array(self.a.encoding.encode_ordinary("".join(chunks)), np.int64)
        except ValueError:  # refused for its length
            return {}
        end_a, end_b, ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), np.cumsum(size)
        if end_a[-1] != len(whole) or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            return {}
        last_a, last_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        if (end_a[last_a] != ends).any():
            return {}
        # the groups: tokens of A, a mark, tokens of B; cut where tokens of both end
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        to_a, to_b = np.searchsorted(end_a, both) + 1, np.searchsorted(end_b, both) + 1
        k = np.arange(len(both))
        of_a, of_b = np.repeat(k, np.diff(to_a, prepend=0)), np.repeat(k, np.diff(to_b, prepend=0))
        laid = np.full(len(a) + len(b) + len(both), -1, np.int32)
        laid[np.arange(len(a)) + np.append(0, to_b)[of_a] + of_a] = a
        laid[np.arange(len(b)) + to_a[of_b] + of_b + 1] = b
        data, stops = laid.tobytes(), (4 * (to_a + to_b + k + 1)).tolist()
        groups = list(map(self.names.__getitem__, map(data.__getitem__, map(slice, [0, *stops[:-1]], stops))))
        to = (np.searchsorted(both, ends) + 1).tolist()
        counts = np.diff(last_a + 1, prepend=0).tolist(), n_b.tolist()
        out: dict[str, Known] = {}
        for c, x, y, m, n in zip(chunks, [0, *to[:-1]], to, *counts, strict=True):
            own = tuple(groups[x:y])
            out[c] = ";".join(own), own, m, n
        return out

    def links(self, group: str) -> Counter:
        """(A id, B id) -> pairs of tokens of the group with overlapping bytes."""
        a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
        ends = [np.cumsum([size[x] for x in ids]).tolist() for size, ids in ((self.a_size, a), (self.b_size, b))]
        out, i, j = Counter(), 0, 0
        while i < len(a) and j < len(b):
            out[a[i], b[j]] += 1
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
        return out


def encoders(a_path: str, b_path: str) -> Encoders:
    """The worker's pair of tokenizers; made once in each Python process."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Encoders(a_path, b_path)
    return _pairs[a_path, b_path]


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Lot:
    """Chunks, groups and documents of a lot."""

    def __init__(self, by_documents: bool):
        self.by_documents = by_documents
        self.chunk: dict[str, int] = {}
        self.group: dict[str, int] = {}
        self.texts: list[str] = []  # of each chunk, its groups as one text
        self.bad: set[int] = set()  # chunks whose tokens do not spell them
        self.tokens: list[tuple[int, int]] = []
        self.of_chunk: list[list[int]] = []
        self.held: list[tuple[int, ...]] = []  # by documents: the groups that each holds
        self.rows: list[tuple[str, np.ndarray]] = []
        self.ids: list[pa.Array] = []
        self.bytes = 0

    def _learn(self, chunks: list[str], pair: Encoders) -> None:
        number = self.group
        for c, known in zip(chunks, pair.known(chunks), strict=True):
            self.chunk[c] = k = len(self.texts)
            text, groups, n_a, n_b = known or ("", (), 0, 0)
            if known is None:
                self.bad.add(k)
            self.texts.append(text)
            self.tokens.append((n_a, n_b))
            self.of_chunk.append([number.setdefault(g, len(number)) for g in groups])

    def add(self, text: str, pair: Encoders) -> None:
        self.add_all([text], pair)

    def add_all(self, texts: list[str], pair: Encoders) -> None:
        """Documents whose new chunks are learnt together."""
        self.bytes += sum(map(len, texts))
        cuts, chunk = [CUT.split(" " + text) if text else [] for text in texts], self.chunk
        if new := [c for c in dict.fromkeys(chain.from_iterable(cuts)) if c not in chunk]:
            self._learn(new, pair)
        for chunks in cuts:
            self._row(list(map(chunk.__getitem__, chunks)))

    def _row(self, at: list[int]) -> None:
        if not at or self.bad and not self.bad.isdisjoint(at):
            self.rows.append(("", np.zeros(0, np.int32)))
            return
        said = ";".join(map(self.texts.__getitem__, at))
        self.rows.append((hashlib.sha256(said.encode()).hexdigest(), np.array(at, np.int32)))
        if self.by_documents:
            self.held.append(tuple({g for k in set(at) for g in self.of_chunk[k]}))

    def batches(self, lot: int, names: list[str], id_type: pa.DataType, step: int = 20_000) -> Iterator[pa.RecordBatch]:
        sizes = np.array(list(map(len, self.of_chunk)), np.int64)
        flat = np.array([g for groups in self.of_chunk for g in groups], np.int64)
        uses = np.concatenate([u for _, u in self.rows])
        ends = np.cumsum([len(u) for _, u in self.rows])
        if self.by_documents:
            weight = np.bincount(np.array([g for held in self.held for g in held], np.int64), minlength=len(self.group))
        else:
            each = np.bincount(uses, minlength=len(sizes))
            weight = np.bincount(flat, np.repeat(each, sizes), len(self.group)).astype(np.int64)
        of_use = np.column_stack((np.array(self.tokens, np.int64).reshape(-1, 2), sizes))[uses]
        sums = np.vstack((np.zeros((1, 3), np.int64), np.cumsum(of_use, axis=0)))
        counts = np.diff(sums[np.append(0, ends)], axis=0)

        def batch(n: int, kind: int, **of: pa.Array) -> pa.RecordBatch:
            kinds = dict(zip(names, [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True))
            of |= {"lot": pa.array(np.full(n, lot)), "kind": pa.array(np.full(n, kind, np.int32))}
            return pa.RecordBatch.from_arrays([of.get(c, pa.nulls(n, k)).cast(k) for c, k in kinds.items()], names=names)

        texts = list(self.group)
        for k in range(0, len(texts), step):
            part = slice(k, k + step)
            yield batch(len(texts[part]), 0, g=pa.array(range(k, k + len(texts[part])), pa.int32()), group=pa.array(texts[part]), weight=pa.array(weight[part]))
        chunk_map = _packed(np.concatenate(([len(sizes)], sizes, flat)))
        yield batch(1, 1, uses=pa.array([chunk_map], pa.binary()))
        ids, at = pa.concat_arrays(self.ids), 0
        for k in range(0, len(self.rows), 500):
            sha, used = zip(*self.rows[k : k + 500], strict=True)
            n = counts[k : k + 500]
            cols = {c: pa.array(np.ascontiguousarray(n[:, z])) for z, c in enumerate(("n_a", "n_b", "n_groups"))}
            cols |= {"sha": pa.array(sha), "uses": pa.array([_packed(u) if len(u) else b"" for u in used], pa.binary())}
            yield batch(len(sha), 2, id=ids.slice(at, len(sha)), **cols)
            at += len(sha)


def encoded_lots(df: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, by_documents: bool = False, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """Rows of three kinds, for each lot: its groups (0), the groups of its chunks (1), its documents (2); written."""
    id_type = df.schema[id_col].dataType
    fields = [("lot", T.LongType()), ("kind", T.IntegerType()), ("g", T.IntegerType()), ("group", T.StringType()), ("weight", T.LongType()), ("id", id_type)]
    fields += [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("sha", T.StringType()), ("uses", T.BinaryType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part, k, lot, kind = encoders(a_path, b_path), TaskContext.get().partitionId() << 32, 0, _Lot(by_documents), None
        for b in batches:
            kind, start, waiting, size = b.column(0).type, 0, [], 0
            for r in range(b.num_rows):
                waiting.append(b.column(1)[r].as_py())
                size += len(waiting[-1])
                if size >= LEARN_BYTES or lot.bytes + size >= lot_bytes or r + 1 == b.num_rows:
                    lot.add_all(waiting, pair)
                    waiting, size = [], 0
                if lot.bytes >= lot_bytes or r + 1 == b.num_rows:
                    lot.ids.append(b.column(0).slice(start, r + 1 - start))
                    start = r + 1
                if lot.bytes >= lot_bytes:
                    yield from lot.batches(part + k, schema.names, kind)
                    k, lot = k + 1, _Lot(by_documents)
        if lot.rows:
            yield from lot.batches(part + k, schema.names, kind)

    return written(df.select(col(id_col).alias("_id"), whole_text(text_col).alias("_text")).mapInArrow(run, schema))


def group_dictionary(lots: DataFrame) -> DataFrame:
    """gid, group, weight: each distinct group of all lots once; written."""
    groups = lots.where("kind = 0").groupBy("group").agg(F.sum("weight").alias("weight")).where("weight > 0")
    return written(groups.select(F.monotonically_increasing_id().alias("gid"), "group", "weight"))


def group_links(groups: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """gid, weight, a_id, b_id, m: the links of each distinct group, expanded once; written."""
    names = ["gid", "weight", "a_id", "b_id", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = encoders(a_path, b_path)
        for b in batches:
            rows = [(gid, w, a, x, m) for gid, g, w in zip(*(c.to_pylist() for c in b.columns), strict=True) for (a, x), m in pair.links(g).items()]
            for k in range(0, len(rows), 50_000):
                cols = np.array(rows[k : k + 50_000], np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=names)

    return written(groups.select("gid", "group", "weight").mapInArrow(run, ", ".join(f"{n} bigint" for n in names)))


def pair_counts(links: DataFrame) -> DataFrame:
    """a_id, b_id, count, is_best (no A id has a higher count with this B id)."""
    pairs = links.groupBy("a_id", "b_id").agg(F.sum(F.col("m") * F.col("weight")).alias("count"))
    most = pairs.groupBy("b_id").agg(F.max("count").alias("_most"))
    return pairs.join(most, "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("_most")).alias("is_best"))


def token_pairs(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", weight: str = "links") -> DataFrame:
    """a_id, b_id, count, is_best over all documents.

    ``weight``: "links" counts every link; "documents" counts the links of each group once for each document that
    holds the group.
    """
    lots = encoded_lots(df, a_path, b_path, id_col, text_col, _by_documents(weight))
    return pair_counts(group_links(group_dictionary(lots), a_path, b_path))


def _by_documents(weight: str) -> bool:
    if weight not in ("links", "documents"):
        raise ValueError("weight must be 'links' or 'documents'")
    return weight == "documents"


def _summed(id_type: T.DataType, id_col: str) -> tuple[T.StructType, object]:
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([T.StructField(id_col, id_type), *[T.StructField(n, T.LongType()) for n in names], T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of lot and kind: what groups sum to, the groups of chunks, documents."""
        lot, found, of_chunk = None, [], None
        for b in batches:
            lots, kinds = (b.column(c).to_numpy() for c in (0, 1))
            cuts = np.flatnonzero((lots[1:] != lots[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lots)], strict=True):
                if a == z:
                    continue
                if lots[a] != lot:
                    lot, found, of_chunk = lots[a], [], None
                rows = b.slice(a, z - a)
                if kinds[a] == 0:
                    found.append(np.column_stack([rows.column(c).to_numpy() for c in range(2, 6)]))
                elif kinds[a] == 1:
                    data = _unpacked(rows.column(10)[0].as_py())
                    sizes, flat = data[1 : data[0] + 1], data[data[0] + 1 :]
                    table = np.zeros((flat.max(initial=-1) + 1, 3), np.int64)
                    if found:
                        x = np.concatenate(found)
                        inside = x[:, 0] < len(table)
                        table[x[inside, 0]] = x[inside, 1:]
                    sums = np.vstack((np.zeros((1, 3), np.int64), np.cumsum(table[flat], axis=0)))
                    ends = np.cumsum(sizes)
                    of_chunk, found = sums[ends] - sums[ends - sizes], []
                else:
                    uses = [_unpacked(u) if u else np.zeros(0, np.int64) for u in rows.column(10).to_pylist()]
                    total = np.array([of_chunk[u].sum(axis=0) for u in uses], np.int64).reshape(-1, 3)
                    cols = [rows.column(c) for c in (7, 8, 9)] + [pa.array(np.ascontiguousarray(total[:, c])) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([rows.column(6), *cols, rows.column(11)], names=schema.names)

    return schema, run


def align_tokens(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", weight: str = "links", lot_bytes: int = LOT_BYTES) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose count is the highest of their B id, ties included; count_sum: the counts of the links added up.
    Counts are over all documents, see :func:`token_pairs`.  Nulls, empty and long texts, repeats and empty tables: as
    the module says.
    """
    lots = encoded_lots(df, a_path, b_path, id_col, text_col, _by_documents(weight), lot_bytes)
    groups = group_dictionary(lots)
    links = group_links(groups, a_path, b_path)
    m, n = F.col("m"), F.col("count")
    each = links.join(pair_counts(links), ["a_id", "b_id"]).groupBy("gid")
    sums = each.agg(F.sum("m").alias("n_links"), F.sum(F.when(F.col("is_best"), m).otherwise(0)).alias("n_best"), F.sum(m * n).alias("count_sum"))
    of_group = groups.select("gid", "group").join(sums, "gid").drop("gid")
    back = lots.where("kind = 0 and weight > 0").select("lot", "kind", "g", "group").join(of_group, "group").drop("group")
    rest = lots.where("kind > 0").select("lot", "kind", "id", "n_a", "n_b", "n_groups", "uses", "sha")
    rows = back.unionByName(rest, allowMissingColumns=True)
    order = ["lot", "kind", "g", "n_links", "n_best", "count_sum", "id", "n_a", "n_b", "n_groups", "uses", "sha"]
    dealt = rows.select(*order).repartition("lot").sortWithinPartitions("lot", "kind")
    schema, run = _summed(df.schema[id_col].dataType, id_col)
    return dealt.mapInArrow(run, schema)
