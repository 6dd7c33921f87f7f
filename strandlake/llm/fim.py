"""Fill-in-middle: texts rearranged so that a model learns to fill a gap.

A distinct-text index does the work that depends on the text alone:

1. within a batch, equal texts are one row (compared as whole texts); each document is a small row without text,
   which names its text by digest and salt;
2. both meet by digest and salt.  The texts of a digest are compared with each other in full, and the places where a
   unit of the text ends are listed once, as an Elias-Fano code;
3. the documents of that text follow in the same sorted stream: their seeded cuts are selected from the list.

A digest that more than one in ``HOT`` rows hold (there are fewer than ``HOT`` of them) is salted, about ``BLOCK`` rows to
a salt, so that no task gets all copies of a text; its list is then made once for each salt.  A task holds one text,
its list and a batch of results.  The text is shuffled once.

Defined results: a null text counts as empty; an empty text, and one that holds a marker, stays as it is (form plain).
A null id draws its cut like the empty string.  Rows that repeat an id get the same cut of their own text.  An empty
table gives an empty result.  Other columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, whole_text

#: Markers before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
FIM_PERCENT, SPM_PERCENT, SEED = 90, 20, 1
HOT, BLOCK = 4096, 20_000
#: Bytes of results handed back at once.
OUT_BYTES = 8 << 20


class EliasFano:
    """A rising list of numbers in about 2 + log2(last / n) bits each; any of them is found without decoding the rest.

    The low bits of each number stand side by side; the high bits are a bit vector in which the k-th one stands at
    high(k) + k.  A directory has the number of ones before each block of 512 bits.
    """

    def __init__(self, values: np.ndarray):
        n, last = len(values), int(values[-1]) if len(values) else 0
        self.n, self.low_bits = n, max(0, (last // max(n, 1)).bit_length() - 1)
        low = values & ((1 << self.low_bits) - 1)
        bits = (low[:, None] >> np.arange(self.low_bits)) & 1 if self.low_bits else np.zeros((n, 0), np.int64)
        self.low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        high = np.zeros(-(-(n + (last >> self.low_bits) + 1) // 512) * 512, np.uint8)
        high[(values >> self.low_bits) + np.arange(n)] = 1
        self.high = np.packbits(high, bitorder="little")
        self.before = np.append(0, np.cumsum(high.reshape(-1, 512).sum(axis=1, dtype=np.int64)))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        block = int(np.searchsorted(self.before, k, "right")) - 1
        ones = np.flatnonzero(np.unpackbits(self.high[64 * block : 64 * block + 64], bitorder="little"))
        high = 512 * block + int(ones[k - int(self.before[block])]) - k
        at = k * self.low_bits
        part = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8 + 1].tobytes(), "little") >> at % 8
        return high << self.low_bits | part & ((1 << self.low_bits) - 1)


def boundaries(text: bytes, units: re.Pattern | None = None) -> EliasFano:
    """Where each unit of a UTF-8 text ends, in bytes: code points, or the matches of a pattern from left to right."""
    if units is None:
        head = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        return EliasFano(np.append(head[1:], len(text)).astype(np.int64) if len(text) else np.zeros(0, np.int64))
    ends: list[int] = []
    at, done, words = 0, 0, text.decode("utf-8")
    for m in units.finditer(words):
        if m.end() > done:
            at += len(words[done : m.end()].encode("utf-8"))
            done = m.end()
            ends.append(at)
    return EliasFano(np.array(ends, np.int64))


def draws(seed: int, id_: object) -> list[int]:
    """Four unsigned numbers of 32 bits for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode("utf-8", "surrogatepass")).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def arranged(text: bytes, ends: EliasFano, h: list[int], markers: tuple[str, str, str], fim: int, spm: int, plain: bool) -> tuple[str, int | None, int | None, bytes]:
    """form, units of the prefix, units of the middle, and the rearranged text."""
    if plain or not text or h[2] % 100 >= fim:
        return "plain", None, None, text
    n = len(ends)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (i, j))
    p, s, m = (x.encode() for x in markers)
    if h[3] % 100 < spm:
        return "spm", i, j - i, s + text[b:] + p + text[:a] + m + text[a:b]
    return "psm", i, j - i, p + text[:a] + s + text[b:] + m + text[a:b]


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of."""
    part = F.split(output, "|".join(re.escape(m) for m in markers))
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _texts_and_documents(id_type: T.DataType) -> tuple[T.StructType, object]:
    """Rows of kind 0: a text that a batch holds; of kind 1: a document that names its text."""
    schema = T.StructType(
        [
            T.StructField("_sha", T.BinaryType()), T.StructField("_salt", T.IntegerType()), T.StructField("_kind", T.IntegerType()),
            T.StructField("_id", id_type), T.StructField("_text", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            texts, salts = b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()
            first = {t: (hashlib.sha256(t).digest(), (part + k) % s) for t, s in zip(texts, salts, strict=True)}
            key = [first[t] for t in texts]
            for kind, keys, ids, held in (
                (0, list(first.values()), pa.nulls(len(first), b.column(0).type), list(first)),
                (1, key, b.column(0), [None] * len(key)),
            ):
                cols = [pa.array([x[0] for x in keys], pa.binary()), pa.array([x[1] for x in keys], pa.int32()), pa.array([kind] * len(keys), pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, ids, pa.array(held, pa.binary())], names=schema.names)

    return schema, run


def fill_in_middle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    units: str | None = None,
    markers: tuple[str, str, str] = MARKERS,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """id, n, form (plain, psm, spm), prefix_units, middle_units, output: one row per input row.

    ``units``: a regular expression whose matches are the units, code points where it is None.  Nulls, empty and long
    texts, repeats and empty tables: as the module says.
    """
    id_type = df.schema[id_col].dataType
    text = whole_text(text_col)
    rows = df.select(col(id_col).alias("_id"), text.alias("_text"))
    sha = F.unhex(F.sha2("_text", 256))
    most = max(2, rows.count() // HOT)
    hot = rows.groupBy(sha.alias("_sha")).count().where(F.col("count") > most)  # fewer than HOT rows
    salts = hot.select("_sha", F.ceil(F.col("count") / min(most, BLOCK)).cast("int").alias("_salts"))
    salted = rows.withColumn("_sha", sha).join(F.broadcast(salts), "_sha", "left")
    schema, run = _texts_and_documents(id_type)
    dealt = salted.select("_id", "_text", F.coalesce("_salts", F.lit(1)).alias("_salts")).mapInArrow(run, schema)
    met = dealt.repartition("_sha", "_salt").sortWithinPartitions("_sha", "_salt", "_kind")
    out = T.StructType(
        [
            T.StructField(id_col, id_type), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
            T.StructField("prefix_units", T.LongType()), T.StructField("middle_units", T.LongType()), T.StructField("output", T.StringType()),
        ]
    )
    pattern = re.compile(units) if units else None
    marks = [m.encode() for m in markers]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text, ends, plain = None, b"", boundaries(b""), True
        ids, rows, size = [], [], 0

        def done() -> pa.RecordBatch:
            n, form, prefix, middle, output = zip(*rows, strict=True)
            cols = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
            cols.append(pa.array(output, pa.binary()).cast(pa.string()))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *cols], names=out.names)

        for b in batches:
            taken = []
            for r, (sha, salt, kind) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                if kind == 0:
                    held = b.column(4)[r].as_py()
                    if (sha, salt) != key:
                        key, text, ends = (sha, salt), held, boundaries(held, pattern)
                        plain = any(m in held for m in marks)
                    elif held != text:
                        raise ValueError("two texts share one SHA-256 digest")
                    continue
                if (sha, salt) != key:
                    raise ValueError("a document has no text")
                id_ = b.column(3)[r].as_py()
                rows.append((len(ends), *arranged(text, ends, draws(seed, id_), markers, fim_percent, spm_percent, plain)))
                taken.append(r)
                size += len(text)
                if size > OUT_BYTES:
                    ids.append(b.column(3).take(pa.array(taken, pa.int64())))
                    yield done()
                    ids, rows, size, taken = [], [], 0, []
            if taken:
                ids.append(b.column(3).take(pa.array(taken, pa.int64())))
        if rows:
            yield done()

    return met.mapInArrow(select, out)


def fim_digests(df: DataFrame) -> DataFrame:
    """The contract columns of what :func:`fill_in_middle` gives with its usual markers."""
    sha = lambda c: F.sha2(c, 256)
    return df.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: The contract columns in DuckDB SQL over ``documents``.
CONTRACT_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, length(t) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) for k in range(4)] AS h FROM d
), cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
