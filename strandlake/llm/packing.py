"""Best-fit packing by minimum bin slack.

Only the *number* of pieces of each length (1..capacity) decides how bins are
filled, so the search runs on that bounded histogram.  For the longest length
left, a bitset subset-sum dynamic program over the available lengths (with their
counts) finds the fullest feasible combination; it is removed as often as the
counts allow, so that the number of rounds hangs on the lengths and hardly on how
many pieces there are.  The pieces then take
their places by their running number within their length: numbers are given within
each part of the written pieces, and continue from part to part, so that a hot length is
spread over all parts.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import col, written

CAPACITY = 1024
END_ID = 2

_coders: dict[str, PlainCoder | RankCoder] = {}


class PlainCoder:
    """Ids of a text by the tokenizers library; the strings of special tokens are ordinary text in a document."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


class RankCoder:
    """The same ids for a plain byte-level BPE, several times faster: its merges are replayed by rank of the merged token.

    That the ids are those of the tokenizers library is tested on whole tables and on made-up words.  A text that
    the faster encoder refuses (millions of spaces on end) goes to the library itself.
    """

    def __init__(self, tokenizer, spec: dict):
        import tiktoken

        self.plain = PlainCoder(tokenizer)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)}
        special = {x["content"].encode() for x in spec.get("added_tokens") or []}
        ranks = {t: i for t, i in ranks.items() if t not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            return self.plain(text)

    @staticmethod
    def fits(spec: dict) -> bool:
        """Whether a tokenizer file is a byte-level BPE and nothing more, its ids in the order of its merges."""
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and spec.get("normalizer") is None
        if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return False
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        return all(c in model["vocab"] for c in byte_letters()) and None not in merged and merged == sorted(merged)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    unseen = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + unseen.index(b)) for b in range(256)]


def _coder(path: str) -> PlainCoder | RankCoder:
    """The worker's encoder for a tokenizer file; made once in each Python process."""
    if path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        spec = json.loads(tokenizer.to_str())
        _coders[path] = RankCoder(tokenizer, spec) if RankCoder.fits(spec) else PlainCoder(tokenizer)
    return _coders[path]


def token_pieces(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids): whole texts as ids plus ``end_id``.

    Texts of more than ``capacity`` ids are cut so that only their first piece may
    be shorter than ``capacity``.  A null text counts as empty and gives one piece
    that holds ``end_id`` alone.  Rows that repeat an id give pieces of their own.
    """
    fields = [
        T.StructField(id_col, df.schema[id_col].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _coder(path)
        for b in batches:
            of, piece, start, length, crc, data = [], [], [], [], [], []
            for row, text in enumerate(b.column(1)):
                ids = np.append(encode(text.as_py() or ""), end).astype("<u4", copy=False)
                n = len(ids)
                first = n % capacity or min(n, capacity)
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = memoryview(ids[x:y])
                    of.append(row), piece.append(k), start.append(x), length.append(y - x), crc.append(zlib.crc32(part))
                    if with_ids:
                        data.append(bytes(part))
            cols = [b.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32())]
            cols += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            if with_ids:
                cols.append(pa.array(data, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.select(col(id_col).alias("_id"), col(text_col).cast("string").alias("_text")).mapInArrow(run, T.StructType(fields))


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths of a combination that fills ``room`` as far as the counts allow.

    Bit s of ``reach[k]`` says that the first k items can sum to s.  Items are the
    available lengths, longest first, each with the powers of two of its count.
    """
    items: list[tuple[int, int]] = []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left > 0:
            items.append((length, min(step, left)))
            left -= step
            step *= 2
    mask, reach = (1 << (room + 1)) - 1, [1]
    for length, times in items:
        now = reach[-1]
        reach.append((now | now << (length * times)) & mask)
        if reach[-1] >> room:
            break
    total = reach[-1].bit_length() - 1
    out: list[int] = []
    for k in range(len(reach) - 1, 0, -1):
        if not reach[k - 1] >> total & 1:
            length, times = items[k - 1]
            out += [length] * times
            total -= length * times
    return out


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in a bin, number of such bins), until no piece is left."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    bins: list[tuple[list[int], int]] = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        combination = [longest, *fullest(counts, capacity - longest)]
        counts[longest] += 1
        uses = {x: combination.count(x) for x in set(combination)}
        times = min(counts[x] // k for x, k in uses.items())
        bins.append((combination, times))
        for x, k in uses.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
    return bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """Add sequence_id and offset to the rows of ``pieces`` (columns of these names are replaced).

    Pieces of one length take their places in any order.  Lengths must lie in 1..capacity.
    """
    spark = pieces.sparkSession
    own = [f"`{c}`" for c in pieces.columns if c not in ("sequence_id", "offset")]
    at = F.monotonically_increasing_id().alias("_at")  # written, so that a piece keeps its number
    rows = written(pieces.select(F.struct(*own).alias("_piece"), F.col(length_col).cast("long").alias("length"), at))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy(F.col("length").alias("_length"), F.col("_part").alias("_s")).agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy("_length").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(so_far), F.lit(0)))
    # at most ``capacity`` rows, whatever the input
    histogram = {int(k): int(n) for k, n in counts.groupBy("_length").agg(F.sum("_n")).collect()}
    # Slots: the pieces of one length with running numbers lo..lo+uses*bins-1 fill
    # ``uses`` places in each of ``bins`` sequences from ``first`` on.
    slots: list[tuple[int, int, int, int, int, list[int]]] = []
    taken: dict[int, int] = {}
    first = 0
    for combination, bins in minimum_bin_slack(histogram, capacity):
        places: dict[int, list[int]] = {}
        at = 0
        for length in combination:
            places.setdefault(length, []).append(at)
            at += length
        for length, offsets in places.items():
            lo = taken.get(length, 0)
            taken[length] = lo + len(offsets) * bins
            slots.append((length, lo, taken[length], first, len(offsets), offsets))
        first += bins
    by_length: dict[int, list[tuple[int, int, int, int, list[int]]]] = {}
    for length, *slot in slots:
        by_length.setdefault(length, []).append(tuple(slot))
    slot_type = "array<struct<lo:bigint,hi:bigint,first:bigint,uses:int,offsets:array<int>>>"
    plan = spark.createDataFrame([(k, v) for k, v in by_length.items()], f"_length bigint, _slots {slot_type}")
    window = Window.partitionBy("length", "_part").orderBy("_at")
    numbered = rows.withColumn("_row", F.row_number().over(window).cast("long") - 1)
    key = [F.col("length") == F.col("_length"), F.col("_part") == F.col("_s")]
    numbered = numbered.join(starts, key).withColumn("_number", F.col("_row") + F.col("_before")).drop("_length")
    # One row per length that occurs: bounded by capacity.
    placed = numbered.join(F.broadcast(plan), F.col("length") == F.col("_length"))
    slot = F.filter("_slots", lambda s: (s["lo"] <= F.col("_number")) & (F.col("_number") < s["hi"]))[0]
    placed = placed.withColumn("_slot", slot).withColumn("_k", F.col("_number") - F.col("_slot.lo"))
    sequence = F.col("_slot.first") + F.floor(F.col("_k") / F.col("_slot.uses"))
    offset = F.col("_slot.offsets")[F.pmod(F.col("_k"), F.col("_slot.uses")).cast("int")]
    return placed.select(*[f"_piece.{c}" for c in own], sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Tokenise whole texts and pack their pieces: id, piece, start, length, ids_crc32, sequence_id, offset.

    Each piece stands in exactly one sequence, from ``offset`` on, without gaps.  A null or empty text is one piece
    that holds ``end_id`` alone; a text of any length is cut into pieces of ``capacity`` ids, the first one shorter.
    Repeated rows, null ids and ties are packed each by itself.  An empty table gives an empty result.  Other
    columns of ``df`` take no part, whatever their names.
    """
    return pack(token_pieces(df, path, id_col, text_col, capacity, end_id), capacity)
