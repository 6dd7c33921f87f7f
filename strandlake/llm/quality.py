"""Quality classifier: random-indexing word vectors, pooled, into a two-layer network.

* Words are split into letter runs, digits and symbol runs, and hashed into
  ``BUCKETS`` rows.  Each row has a fixed sparse random index vector; a row's word
  vector is the sum of the index vectors that stand within two places of it
  anywhere in the corpus (all documents; no labels), plus its own index vector.
* A document is the mean and the spread of its words' vectors.
* A two-layer network is fitted in numpy on a bounded sample of labelled rows; its
  temperature is calibrated on rows of that sample that the fit has not seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, col
from .labelled import SAMPLE_ROWS, labelled_sample

BUCKETS, SYMBOLS, DIM, NONZERO = 8192, 512, 32, 4
#: A row of the table of sums is sent in so many chunks.
CHUNKS = 16
HIDDEN, EPOCHS, DECAY, SEED = 32, 40, 1e-3, 7
CACHE = 300_000

_RUN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_cache: dict[str, bytes] = {}


def word_rows(word: str) -> bytes:
    """Rows (16-bit numbers) of a word: one for each run, and one (2) that says that it is in capitals.

    Row 0 is padding, 1 digits, 3 the mark of a row that repeats the row before it.
    """
    rows = []
    for run in _RUN.findall(word):
        code = zlib.crc32(run.lower().encode("utf-8", "surrogatepass"))
        if run[0].isalpha():
            rows.append(SYMBOLS + code % (BUCKETS - SYMBOLS))
            if len(run) > 1 and run.isupper():
                rows.append(2)
        elif run[0].isdigit():
            rows.append(1)
        else:
            rows.append(4 + code % (SYMBOLS - 4))
    return np.array(rows, "<u2").tobytes()


def text_rows(text: str | None) -> np.ndarray:
    """The rows of a whole text, in order."""
    words = (text or "").split()
    fresh = {w for w in words if w not in _cache}
    if fresh:
        if len(_cache) + len(fresh) > CACHE:
            _cache.clear()
            fresh = set(words)
        for w in fresh:
            _cache[w] = word_rows(w)
    return np.frombuffer(b"".join(map(_cache.__getitem__, words)), "<u2")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each row's index vector; row 0 (padding) has none."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO].astype(np.int64)
    signs = rng.choice([-1.0, 1.0], (BUCKETS, NONZERO)).astype(np.float32)
    signs[0] = 0
    return places, signs


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Random-indexing vectors (BUCKETS x DIM) from all documents."""
    places, signs = index_vectors()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIM)
        pad = np.zeros(2, "<u2")
        for b in batches:
            parts = [x for t in b.column(0).to_pylist() for x in (text_rows(t), pad)]
            rows = np.concatenate([pad, *parts]).astype(np.int64)
            for gap in (1, 2):
                a, z = rows[:-gap], rows[gap:]
                for k in range(NONZERO):
                    total += np.bincount(a * DIM + places[z, k], signs[z, k], total.size)
                    total += np.bincount(z * DIM + places[a, k], signs[a, k], total.size)
        data = [x.astype("<f8").tobytes() for x in np.split(total, CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array(data, pa.binary())], names=["chunk", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[chunk] = held.get(chunk, 0.0) + np.frombuffer(data, "<f8")
        if held:
            data = [x.astype("<f8").tobytes() for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(data, pa.binary())], names=["chunk", "data"])

    schema = "chunk int, data binary"
    partial = docs.select(col(text_col).cast("string").alias("_text")).mapInArrow(sums, schema)
    whole = partial.repartition(CHUNKS, "chunk").mapInArrow(added, schema).collect()  # BUCKETS x DIM floats, whatever the input
    total = np.zeros((CHUNKS, BUCKETS * DIM // CHUNKS), np.float32)
    for chunk, data in whole:
        total[chunk] = np.frombuffer(data, "<f8")  # sums of whole numbers, so their order does not matter
    vectors = total.reshape(BUCKETS, DIM)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    own = np.zeros((BUCKETS, DIM), np.float32)
    np.put_along_axis(own, places, signs / np.sqrt(NONZERO).astype(np.float32), axis=1)
    return (vectors + own).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the word vectors; zeros for a text without words."""
    rows = text_rows(text)
    if not len(rows):
        return np.zeros(2 * DIM, np.float32)
    counts = np.bincount(rows, minlength=4)
    counts[3] = np.count_nonzero(rows[1:] == rows[:-1])
    used = np.flatnonzero(counts)
    share = (counts[used] / len(rows)).astype(np.float32)
    found = vectors[used]
    mean = share @ found
    return np.concatenate((mean, np.sqrt(np.maximum(share @ (found * found) - mean * mean, 0))))


class Network:
    """input -> tanh layer -> logit, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.constant = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        self.fitted = len(np.unique(y)) > 1
        if not self.fitted:
            return
        order = rng.permutation(len(x))
        held, seen = order[: len(x) // 5], order[len(x) // 5 :]
        self.center, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.center) / self.scale
        self.w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(EPOCHS):
            rate = 0.01 * 0.95**epoch
            for batch in np.array_split(rng.permutation(seen), max(1, len(seen) // 256)):
                step += 1
                for k, g in enumerate(self._gradient(z[batch], y[batch])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        rows = held if len(np.unique(y[held])) > 1 else order
        logits = self._logit(z[rows])
        self.temperature = float(min(np.exp(np.linspace(-1.5, 3, 91)), key=lambda t: self._loss(logits / t, y[rows])))

    @staticmethod
    def _loss(logit: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    def _gradient(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        a, b, c, d = self.w
        h = np.tanh(z @ a + b)
        e = (1 / (1 + np.exp(-(h @ c + d[0]))) - y) / len(y)
        back = np.outer(e, c) * (1 - h * h)
        return [z.T @ back + DECAY * a, back.sum(0), h.T @ e + DECAY * c, np.array([e.sum()])]

    def _logit(self, z: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.tanh(z @ a + b) @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.constant)
        logit = self._logit((x - self.center) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, where=None, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Network]:
    """Word vectors from all ``docs``, and a network from at most ``rows`` labelled rows."""
    vectors = word_vectors(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [pooled(t, shared.value).astype("<f4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["id", "label", "x"])

    sample = labelled_sample(docs, labels, "quality", rows, where, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    got = sorted(sample.mapInArrow(run, f"id {kind}, label int, x binary").collect(), key=lambda r: (r[0], r[2]))  # ``rows`` rows at most
    drop_written(sample)
    x = np.array([np.frombuffer(r[2], "<f4") for r in got], np.float64).reshape(-1, 2 * DIM)
    y = np.array([float(r[1] > 0) for r in got])
    return vectors, Network(x, y)


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS, where=None, keep: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` (id only, or all columns with ``keep``) with score and predicted.

    A null or blank text is pooled to zeros and scored like any other.  Without labelled
    rows, or with one class only, every score is the share of label 1 (0.5 without rows).
    Repeated rows are scored each.  An empty table gives an empty result.
    """
    vectors, network = fit(docs, labels, rows, where, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    columns = docs.columns if keep else [id_col]
    names = {"score": _free("score", columns), "predicted": _free("predicted", columns)} if keep else {"score": "score", "predicted": "predicted"}
    picked = docs.select(*[col(c).alias(f"_{k}") for k, c in enumerate(columns)], col(text_col).cast("string").alias("_text"))  # plain names for the workers
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField(names["score"], T.DoubleType()), T.StructField(names["predicted"], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for b in batches:
            x = np.array([pooled(t, vectors) for t in b.column(len(columns)).to_pylist()], np.float64).reshape(-1, 2 * DIM)
            score = network.score(x)
            cols = [b.column(i) for i in range(len(columns))]
            cols += [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return picked.mapInArrow(run, schema)


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = "_" + name
    return name


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS, where=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns unchanged."""
    scored = quality_scores(docs, labels, threshold, rows, where, True, id_col, text_col)
    return scored.where(col(_free("predicted", docs.columns)) == 1).select(*map(col, docs.columns))
