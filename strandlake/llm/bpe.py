"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of many texts form one small corpus.  An inverted index lists,
for each mergeable pair (named by the rank of its merged token), the word
positions where it stands.  Ranks leave a heap in rising order; a rank's merge is
applied at all its positions at once, and only the two neighbouring pairs of each
position are looked up again.  Words that have been encoded stay in a bounded
cache of the Python worker, so that the replay sees each frequent word once.

Every text is independent of the others, so encoding needs no shuffle at all.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import col

#: Words that one Python worker remembers (about 250 bytes each).
CACHE_WORDS = 500_000
#: Bytes of text that are cut and encoded at once, about.
LOT = 8_000_000


class MergeReplay:
    """Encoder for one vocabulary of (token bytes, rank) pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        pairs = {
            ranks[t[:i]] * self.size + ranks[t[i:]]: r
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        order = np.argsort(keys := np.fromiter(pairs, np.int64, len(pairs)))
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], -1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merged token, -1 where the two do not merge."""
        keys = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of each word, by replaying all merges over all words in rank order."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        right = np.arange(1, n + 1, dtype=np.int32)
        left = np.arange(-1, n - 1, dtype=np.int32)
        odd = np.zeros(len(words), bool)  # words in which a lower rank came up after a higher one
        index: dict[int, list[np.ndarray]] = {}  # rank of the merged token -> positions of its left part
        heap: list[int] = []

        def note(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for x, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts) if len(cuts) else [places], strict=True):
                if x in index:
                    index[x].append(part)
                else:
                    index[x] = [part]
                    heapq.heappush(heap, x)

        inside = np.flatnonzero(word[:-1] == word[1:]).astype(np.int32)
        first = self.rank(ids[inside], ids[inside + 1])
        if (some := first >= 0).any():
            note(first[some], inside[some])
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r)
            i = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
            a = ids[i]
            i = i[a >= 0]
            j = right[i]
            ok = j < n
            i, j = i[ok], j[ok]
            ok = (self.rank(ids[i], np.maximum(ids[j], 0)) == r) & (word[i] == word[j])
            i, j = i[ok], j[ok]  # a neighbour's merge may have come first
            if not len(i):
                continue
            if (meets := j[:-1] == i[1:]).any():  # like aaa: every second place of a run, from its left end
                fresh = np.append(True, ~meets)
                at = np.arange(len(i))
                ok = (at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0
                i, j = i[ok], j[ok]
            k = right[j]
            ids[i], ids[j], right[i] = r, -1, k
            ok = k < n
            left[k[ok]] = i[ok]
            # the two touched neighbours of each position
            ok[ok] = word[k[ok]] == word[i[ok]]
            after = i[ok]
            h = left[i]
            ok = h >= 0
            ok[ok] = word[h[ok]] == word[i[ok]]
            before = h[ok]
            at = np.unique(np.concatenate((after, before)))
            if len(at):
                x = self.rank(ids[at], ids[right[at]])
                some = x >= 0
                if some.any():
                    x, at = x[some], at[some]
                    odd[word[at[x < r]]] = True
                    note(x, at)
        alive = np.flatnonzero(ids >= 0)
        counts = np.bincount(word[alive], minlength=len(words))
        packed = ids[alive].astype("<u4").tobytes()
        to = (4 * np.cumsum(counts)).tolist()
        out = [packed[x:y] for x, y in zip([0, *to], to, strict=False)]
        for w in np.flatnonzero(odd).tolist():
            out[w] = np.array(self._one_word(words[w]), "<u4").tobytes()
        for w in np.flatnonzero(counts > 1).tolist():  # a word that is a token needs no merge path
            if (whole := self.ranks.get(words[w])) is not None:
                out[w] = whole.to_bytes(4, "little")
        return out

    def _one_word(self, word: bytes) -> list[int]:
        """The same for one word, one merge at a time: lowest rank first, then leftmost."""
        ids: list[int] = self.single[np.frombuffer(word, np.uint8)].tolist()
        get, tokens = self.ranks.get, self.tokens
        while len(ids) > 1:
            best = min((get(tokens[a] + tokens[b], self.size), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)))
            if best[0] == self.size:
                break
            ids[best[1] : best[1] + 2] = [best[0]]
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: A space or line end that does not simply stand before the next word (white space as Python has it).
_ODD_SPACE = r"[ \n](?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|\z)"


def cut_at_spaces(text: str) -> list[str]:
    """Pieces of ``text`` whose words can be found separately, in order; without the space that a piece begins with.

    A space before a character that is no white space always begins a word of the
    pattern, so the text may be cut there.  Other white space stays inside a piece.
    """
    parts = text.split(" ")
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    return out


class PieceCache:
    """Packed ids (little-endian, unsigned, 32 bits) of texts; pieces of texts are encoded once and stay in a bounded cache.

    ``encode`` takes a list of unknown pieces and returns their packed ids.  A piece is named by its text without
    the space that it begins with; the first piece of a text, which has none, has a space before its name.
    Texts are cut and their distinct pieces are found by Arrow; Python sees each distinct piece of a lot once.
    """

    def __init__(self, encode, size: int = CACHE_WORDS):
        self.encode, self.size, self.known = encode, size, {}

    def ids(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Packed ids of each text (null: empty); what is unknown in them is encoded as one corpus."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "").cast(pa.large_string())
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        out, at = [], 0
        while at < len(texts):  # lots of about LOT bytes, of one text at least
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + LOT, side="right")))
            out += self._lot(texts.slice(at, to - at))
            at = to
        return out

    def _lot(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        # a line end before a character that is no white space is a word of its own
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        sizes, flat = pc.list_value_length(cut).to_numpy().astype(np.int64), cut.flatten()
        at = np.cumsum(sizes) - sizes
        first = pc.binary_join_element_wise(pa.scalar(" ", flat.type), flat.take(pa.array(at)), pa.scalar("", flat.type))
        if some := np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            own = {k: cut_at_spaces(texts[k].as_py()) for k in some}
            names = first.to_pylist()
            for k, parts in own.items():
                names[k] = " " + parts[0]
                sizes[k] = len(parts)
            first = pa.array(names, flat.type)
            lists, old = [], 0
            for k in some:
                lists += [flat.slice(old, at[k] - old), pa.array(own[k], flat.type)]
                old = int(at[k]) + 1  # an emptied text has one piece
            flat = pa.concat_arrays([*lists, flat.slice(old)])
            at = np.cumsum(sizes) - sizes
        coded = pa.concat_arrays([first, flat]).dictionary_encode()
        codes = coded.indices.to_numpy()
        of, names = codes[len(first) :].copy(), coded.dictionary
        of[at] = codes[: len(first)]
        used = np.unique(of)
        packed = self._packed(names.take(pa.array(used)).to_pylist())
        counts = np.zeros(len(names), np.int64)
        counts[used] = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start = np.cumsum(counts) - counts
        table = np.frombuffer(b"".join(packed), "<u4")
        each = counts[of]
        end = np.cumsum(each)
        ids = table[np.repeat(start[of] - end + each, each) + np.arange(int(end[-1]))]
        to = end[at + sizes - 1].tolist()
        return [ids[x:y].tobytes() for x, y in zip([0, *to], to, strict=False)]

    def _packed(self, names: list[str]) -> list[bytes]:
        """Packed ids of distinct pieces."""
        if len(self.known) > self.size:  # what these texts use stays: the frequent pieces are among it
            self.known = {k: self.known[k] for k in names if k in self.known}
        known = self.known
        found = list(map(known.get, names))
        fresh = [k for k, x in zip(names, found, strict=True) if x is None]
        if fresh:
            # A letter and the full stop or comma after it never share a word: the rest may be known already.
            ended = {k for k in fresh if k[-1:] in (".", ",") and "a" <= k[-2:-1].lower() <= "z"}
            new = {k[:-1] if k in ended else k for k in fresh}
            new = [k for k in new if k not in known]
            new += [t for t in (" .", " ,") if t not in known and t not in new]
            pieces = [k[1:] if k[:1] == " " else k if k[:1] == "\n" else " " + k for k in new]
            known.update(zip(new, self.encode(pieces), strict=True))
            known.update([(k, known[k[:-1]] + known[" " + k[-1]]) for k in ended])
            found = list(map(known.__getitem__, names))
        return found


def gathered(batches: Iterator[pa.RecordBatch], text_at: int, most: int = LOT) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches of about ``most`` bytes of text: what one replay takes as its corpus."""
    group: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        group.append(batch)
        size += batch.column(text_at).nbytes
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a vocabulary of lines 'base64 token, rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PatternCoder:
    """Packed ids for any pattern: its words are looked for in whole texts.  (PieceCache's cuts hold for PATTERN alone.)"""

    def __init__(self, replay: MergeReplay, find, size: int = CACHE_WORDS):
        self.replay, self.find, self.size, self.known = replay, find, size, {}

    def ids(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        words = [self.find(t or "") for t in (texts if isinstance(texts, list) else texts.to_pylist())]
        if len(self.known) > self.size:
            self.known = {}
        fresh = list({w for ws in words for w in ws if w not in self.known})
        self.known.update(zip(fresh, self.replay.encode_words([w.encode("utf-8", "surrogatepass") for w in fresh]), strict=True))
        return [b"".join(map(self.known.__getitem__, ws)) for ws in words]


_coders: dict[tuple[str, str], tuple[MergeReplay, PieceCache | PatternCoder]] = {}


def coder(path: str, pattern: str) -> tuple[MergeReplay, PieceCache | PatternCoder]:
    """The worker's encoder for a vocabulary; made once in each Python process."""
    if (path, pattern) not in _coders:
        replay = MergeReplay(load_ranks(path))
        find = regex.compile(pattern).findall

        known: dict[str, bytes] = {}

        def encode(pieces: list[str]) -> list[bytes]:
            words = [[p] if p.isascii() and (p.isalpha() or p[:1] == " " and p[1:].isalpha()) else find(p) for p in pieces]
            fresh = list({w for ws in words for w in ws if w not in known})
            if len(known) + len(fresh) > CACHE_WORDS:
                known.clear()
                fresh = list({w for ws in words for w in ws})
            raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
            known.update(zip(fresh, replay.encode_words(raw), strict=True))
            return [known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for ws in words]

        _coders[(path, pattern)] = (replay, PieceCache(encode) if pattern == PATTERN else PatternCoder(replay, find))
    return _coders[(path, pattern)]


def bpe_encode(
    df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """Encode each whole text; returns id, ids array<int>.

    A null text counts as empty (no ids).  Ids, order and number of rows are
    those of the input; nulls and repeats in the id column are kept.  Very long texts are encoded whole, one lot
    at a time; an empty table gives an empty result; other columns, whatever their names, take no part.  With ``digests`` the
    ids are decoded again and only counts and SHA-256 digests are returned:
    id, n_tokens, ids_sha256, decoded_sha256.
    """
    kind = df.schema[id_col].dataType
    fields = [T.StructField(id_col, kind)]
    if digests:
        fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    else:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, cache = coder(path, pattern)
        for group in gathered(batches, 1):
            every = iter(cache.ids(pa.concat_arrays([batch.column(1) for batch in group])))
            for batch in group:
                packed = list(islice(every, batch.num_rows))
                if digests:
                    cols = [
                        batch.column(0),
                        pa.array([len(x) // 4 for x in packed], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                        pa.array([hashlib.sha256(replay.decode(np.frombuffer(x, "<u4").tolist())).hexdigest() for x in packed]),
                    ]
                else:
                    sizes = np.cumsum([0] + [len(x) // 4 for x in packed]).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
                    cols = [batch.column(0), pa.ListArray.from_arrays(pa.array(sizes), flat)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.select(col(id_col).alias("_id"), col(text_col).cast("string").alias("_text")).mapInArrow(run, T.StructType(fields))


def bpe_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Turn arrays of ids back into bytes: id, data binary.  Null or empty arrays give no bytes."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, _ = coder(path, pattern)
        for batch in batches:
            data = [replay.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=schema.names)

    return df.select(col(id_col).alias("_id"), col(ids_col).alias("_ids")).mapInArrow(run, schema)
