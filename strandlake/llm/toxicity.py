"""Toxicity severity by cumulative-link (proportional-odds) ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w . x): all thresholds share the weights w.
x holds log(1 + count) of the words that a bounded sample of labelled rows
associates with toxicity.  The labels know only 0 and 1, so grades above 1 are
derived: a toxic document is graded 1, 2, ... by how many of the most toxic words
it holds, relative to the other toxic documents of the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, col
from .labelled import SAMPLE_ROWS, labelled_sample

#: Words that the model may weigh.
FEATURES = 2048
#: A word must stand in so many documents of the sample.
LEAST_DOCUMENTS = 4
GRADES = 3
STEPS, L1 = 300, 2e-4

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class OrdinalModel:
    """weights by word, and rising thresholds; made by ``fit_ordinal``."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def at_most(self, eta: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each k below the highest grade."""
        return _sigmoid(self.thresholds[None, :] - np.asarray(eta)[:, None])

    def eta(self, text: str | None) -> float:
        words = (text or "").lower()
        found = [w for w in _WORD.findall(words) if w in self.weights]
        return float(sum(self.weights[w] * np.log1p(n) for w, n in sorted(Counter(found).items())))


def fit_ordinal(x: list[dict[int, float]], y: np.ndarray, features: int, grades: int, steps: int = STEPS, l1: float = L1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of maximal likelihood with an L1 term, by Adam with soft thresholding."""
    row = np.repeat(np.arange(len(x)), [len(d) for d in x])
    col = np.array([k for d in x for k in d], np.int64)
    val = np.array([v for d in x for v in d.values()], np.float64)
    w = np.zeros(features)
    share = np.cumsum(np.bincount(y, minlength=grades))[:-1] / max(len(y), 1)
    first = np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    # thresholds: the first one, then logarithms of the gaps above it
    par = np.append(first[:1], np.log(np.maximum(np.diff(first), 0.1)))
    m, v = np.zeros(features + grades - 1), np.zeros(features + grades - 1)
    n = max(len(y), 1)
    for step in range(1, steps + 1):
        cuts = par[0] + np.append(0, np.cumsum(np.exp(par[1:])))
        eta = np.bincount(row, val * w[col], len(x))
        s = np.column_stack((np.zeros(len(x)), _sigmoid(cuts[None, :] - eta[:, None]), np.ones(len(x))))
        hi, lo = s[np.arange(len(x)), y + 1], s[np.arange(len(x)), y]
        p = np.maximum(hi - lo, 1e-12)
        slope = s * (1 - s)
        d_hi, d_lo = slope[np.arange(len(x)), y + 1] / p, slope[np.arange(len(x)), y] / p
        d_eta = (d_hi - d_lo) / n
        d_cut = np.zeros(grades + 1)
        np.add.at(d_cut, y + 1, -d_hi / n)
        np.add.at(d_cut, y, d_lo / n)
        d_cut = d_cut[1:grades]
        d_par = np.append(d_cut.sum(), np.exp(par[1:]) * np.cumsum(d_cut[::-1])[::-1][1:])
        g = np.append(np.bincount(col, val * d_eta[row], features), d_par)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, par = w - move[:features], par - move[features:]
        w = np.sign(w) * np.maximum(np.abs(w) - 0.05 * l1 / (np.sqrt(v[:features] / (1 - 0.999**step)) + 1e-4), 0)
    return w, par[0] + np.append(0, np.cumsum(np.exp(par[1:])))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, features: int = FEATURES, grades: int = GRADES, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel | None:
    """The model from at most ``rows`` labelled rows; None without rows of both kinds."""
    sample = labelled_sample(docs, labels, "toxic", rows, None, id_col, text_col)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, toxic = Counter(), Counter()
            for label, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(text).keys()
                n.update(words)
                if label > 0:
                    toxic.update(words)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([toxic[w] for w in n], pa.int64())], names=["word", "n", "toxic"])

    sizes = {bool(k): n for k, n in sample.groupBy(F.col("label") > 0).count().collect()}
    if len(sizes) < 2:
        drop_written(sample)
        return None
    by_word = sample.mapInArrow(counted, "word string, n bigint, toxic bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"))
    # log odds times documents: words that mark many toxic documents and few others
    odds = F.log((F.col("t") + 0.5) / (sizes[True] + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (sizes[False] + 1))
    best = by_word.where(F.col("n") >= LEAST_DOCUMENTS).withColumn("odds", odds).withColumn("weight", F.abs("odds") * F.greatest(F.col("t"), F.lit(1)))
    chosen = best.orderBy(F.desc("weight"), "word").limit(features).collect()
    vocabulary = {r["word"]: k for k, r in enumerate(chosen)}
    marking = {r["word"] for r in chosen if r["odds"] > 3 and r["t"] >= max(LEAST_DOCUMENTS, sizes[True] // 50)}

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, values, hits = [], [], []
            for text in b.column(2).to_pylist():
                words = words_of(text)
                found = [(vocabulary[w], n) for w, n in sorted(words.items()) if w in vocabulary]
                keys.append([k for k, _ in found])
                values.append([n for _, n in found])
                hits.append(sum(words[w] for w in marking))
            cols = [b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32())), pa.array(hits, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "label", "keys", "counts", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = sample.mapInArrow(features_of, f"id {kind}, label int, keys array<int>, counts array<int>, hits int").collect()
    drop_written(sample)
    got.sort(key=lambda r: (r["id"], r["keys"]))
    hits = np.array([r["hits"] for r in got])
    toxic = np.array([r["label"] > 0 for r in got])
    steps = np.quantile(hits[toxic], np.linspace(0, 1, grades)[1:-1]) if grades > 2 else np.zeros(0)
    y = np.where(toxic, 1 + (hits[:, None] > steps[None, :]).sum(axis=1), 0)
    x = [{k: float(np.log1p(n)) for k, n in zip(r["keys"], r["counts"], strict=True)} for r in got]
    w, cuts = fit_ordinal(x, y, len(vocabulary), grades)
    return OrdinalModel({r["word"]: float(w[k]) for k, r in enumerate(chosen) if w[k]}, cuts)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, severity (expected grade), grade (most likely), p_toxic, toxic (p_toxic >= threshold).

    Whole texts, however long; a null or blank text has no features.  Without labelled rows of both
    kinds nothing is called toxic and every severity is 0.  Repeated rows and null ids are scored each; of equal
    probabilities the lower grade is the most likely.  An empty table gives an empty result; other columns of
    ``docs``, whatever their names, take no part.
    """
    model = fit(docs, labels, rows, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES words at most
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            n = b.num_rows
            if model is None:
                below = np.ones((n, 1))
            else:
                below = model.at_most(np.array([model.eta(t) for t in b.column(1).to_pylist()]))
            p = np.diff(np.column_stack((np.zeros(n), below, np.ones(n))), axis=1)
            toxic = 1 - below[:, 0]
            cols = [b.column(0), pa.array((1 - below).sum(axis=1)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(toxic), pa.array(toxic >= threshold)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(col(id_col).alias("_id"), col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
