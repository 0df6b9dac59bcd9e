"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Words and word pairs are hashed to 2**20 weights; a text's features are their
counts over the square root of how many there are. The weights are learned by
FTRL-proximal updates (McMahan et al. 2013), whose L1 term leaves most at zero.
A score is a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from tessera.llm.classify import labelled_sample, sigmoid
from tessera.llm.core import Words, buffers, slices, squeeze, unsqueeze, window_hash
from tessera.runtime import ship

BITS = 20
#: the pair of any word and the same word again
TWICE = np.uint64(0xA0761D6478BD642F)
ALPHA, BETA, L1, L2 = 0.5, 0.05, 0.02, 0.01


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Weight number of each word and word pair, text by text, and where each text's begin."""
    h = w.hashes()
    pair = np.concatenate([window_hash(h, 2), np.zeros(min(len(h), 1), np.uint64)])
    pair[:-1][h[1:] == h[:-1]] = TWICE
    last = np.zeros(len(h), bool)
    last[w.first[1:][w.counts > 0] - 1] = True  # a text's last word starts no pair
    both = np.stack([h, pair], 1).ravel()
    keep = np.stack([np.ones(len(h), bool), ~last], 1).ravel()
    first = np.concatenate([[0], np.cumsum(keep)])[2 * w.first]
    return (both[keep] >> np.uint64(64 - BITS)).astype(np.int64), first


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias from (numbers, values, label) examples, in their order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    for _ in range(epochs):
        for idx, x, y in examples:
            idx, x = np.append(idx, bias), np.append(x, 1.0)
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            g = (sigmoid(np.array(w @ x)) - y) * x
            z[idx] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[idx] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w[:bias], float(w[bias])


def _fit(sample: DataFrame, epochs: int) -> tuple[np.ndarray, float]:
    """Train in one task, on a sample of bounded size."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                idx, first = features(Words(*buffers(part.column("text"))))
                out = []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    k, c = np.unique(idx[a:b], return_counts=True)
                    out.append((squeeze(k.astype(np.uint32)), squeeze((c / max(b - a, 1) ** 0.5).astype(np.float32))))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([v for _, v in out], pa.binary()), part.column("label"), part.column("turn")], ["k", "v", "label", "turn"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(unsqueeze(k, np.uint32).astype(np.int64), unsqueeze(v, np.float32).astype(float), y) for b in batches for k, v, y in zip(*(b.column(c).to_pylist() for c in ("k", "v", "label")), strict=True)]
        if rows:
            w, bias = train(rows, epochs)
            kept = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([squeeze(kept.astype(np.uint32))], pa.binary()), pa.array([squeeze(w[kept])], pa.binary()), pa.array([bias])], ["k", "w", "bias"])

    ready = sample.mapInArrow(prepare, "k binary, v binary, label int, turn long")
    rows = ready.repartition(1).sortWithinPartitions("turn").mapInArrow(learn, "k binary, w binary, bias double").collect()
    weights = np.zeros(1 << BITS)
    if rows:
        weights[unsqueeze(rows[0]["k"], np.uint32)] = unsqueeze(rows[0]["w"], np.float64)
    return weights, rows[0]["bias"] if rows else 0.0


def score_quality(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "quality", id_col: str = "doc_id", column: str = "text", threshold: float = 0.3, sample: int = 6000, epochs: int = 4) -> DataFrame:
    """A quality score of each text, from the text alone.

    The model is fitted on at most `sample` labelled rows of each class (see
    labelled_sample) for which may_learn, an expression over the labels table,
    is true; the share of label 1 among all such rows then shifts the bias, so
    that scores are probabilities. Words are runs of characters other than
    blanks and \\t..\\r, case kept.

    Returns id, score (0 to 1) and predicted (score >= threshold). Null and
    empty texts score as the bias alone. Every row gets a row, whatever its id;
    without labelled rows all score one half; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    found = labelled_sample(docs, labels, label_col, may_learn, id_col, column, sample)
    weights, bias = _fit(found.rows, epochs)
    model = spark.sparkContext.broadcast((weights.astype(np.float32), bias + found.log_odds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                idx, first = features(Words(*buffers(part.column("text"))))
                total = np.concatenate([[0], np.cumsum(w[idx], dtype=np.float64)])
                dot = (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(np.diff(first), 1))
                p = sigmoid(dot + b)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    texts = docs.select(docs[id_col].alias("id"), docs[column].cast("string").alias("text"))
    return texts.mapInArrow(run, T.StructType([T.StructField(id_col, texts.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
