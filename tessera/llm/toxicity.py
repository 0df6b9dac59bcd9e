"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

After Joulin et al. (2017) and Bojanowski et al. (2017): a word's vector is the
mean of the vectors of the word and of its character 3- to 5-grams, all hashed
to one table; the vector of a span of words is the mean of theirs. A
misspelling that was never seen shares most n-grams with the word, and so its
vector. A mean over thousands of words would drown the few that matter, so a
text is scored by the worst of its overlapping spans, all of which are read.

With two classes, the softmax sees a text only through the difference u of its
two rows: a minibatch needs the products of the table with u, and the gradient
of a table row is a multiple of u. So both are trained together exactly, at
the cost of gathering one number for each subword.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, types as T

from tessera.llm.classify import labelled_sample, sigmoid
from tessera.llm.core import MARKS, Words, buffers, mix64, slices, squeeze, unsqueeze, window_hash
from tessera.runtime import ship

BITS, DIM = 18, 16
GRAMS = (3, 4, 5)
#: words in a span; factors on the mean vectors of whole texts and spans, so that a few words outweigh many
SPAN, WHOLE_GAIN, SPAN_GAIN = 6, 50.0, 8.0
#: minibatches over whole texts, then over worst spans, at least; an epoch is always finished
UPDATES = (150, 1000)


def subwords(w: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the picked words' subwords, word by word, and where each word's begin."""
    s, e = w.starts[pick], w.ends[pick]
    size = e - s + 2
    to = np.cumsum(size)
    at = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(s - 1 - (to - size), size)
    raw = w.buf[np.clip(at, 0, max(len(w.buf) - 1, 0))]
    raw[to - size], raw[to - 1] = 60, 62  # < word >
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), np.concatenate([[0], to]))
    word = np.repeat(np.arange(len(pick)), np.diff(edge))
    chars = mix64(chars + np.uint64(1))
    ids, owner = [w.hashes()[pick]], [np.arange(len(pick))]
    for n in GRAMS:
        if len(chars) >= n:
            ok = word[n - 1 :] == word[: len(word) - n + 1]
            ids.append(window_hash(chars, n)[ok])
            owner.append(word[: len(ok)][ok])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(ids)[order] >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(pick) + 1))


def bag(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subword rows, their word starts, then of each text the distinct-word numbers in order, first ones, and counts."""
    w = Words(*buffers(col), separators=MARKS, lower=True)
    _, first, number = np.unique(w.hashes(), return_index=True, return_inverse=True)
    rows, start = subwords(w, first)
    return rows, start, number, w.first, w.counts


def _means(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return (total[start[1:]] - total[start[:-1]]) / np.maximum(np.diff(start), 1)


def spans(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping spans of `width` words, half a width apart: starts, ends, and where each text's begin.

    Every text has one at least; the last ones are shorter at its end.
    """
    n = np.diff(first)
    step = width // 2
    count = np.maximum(-(-(n - step) // step), 1)
    at = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(first[:-1], count) + (np.arange(at[-1]) - np.repeat(at[:-1], count)) * step
    return start, np.minimum(start + width, np.repeat(first[1:], count)), at


def _worst(word: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the span with the largest mean of word values: its start, end and mean."""
    start, end, at = spans(first, width)
    total = np.concatenate([[0], np.cumsum(word, dtype=np.float64)])
    mean = (total[end] - total[start]) / np.maximum(end - start, 1)
    order = np.lexsort((mean, np.repeat(np.arange(len(at) - 1), np.diff(at))))
    pick = order[at[1:] - 1]
    return start[pick], end[pick], mean[pick]


def train(batches: list[tuple], labels: list[np.ndarray], updates: tuple[int, int] = UPDATES, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Score of every table row (its product with u) and the bias.

    batches: bag() of some texts each. The first epochs average whole texts; in
    the others a text is its worst span by the model so far, so that a few
    words among thousands count. Texts come here as _fit() sends them, each a bag
    of words in the order of their hashes with repeats side by side, so these
    spans are six such neighbours; a score takes its spans from the text itself. Both classes weigh the same, however many
    examples each has. Adagrad on the table's rows, u and bias.
    """
    ones = sum(float(y.sum()) for y in labels)
    total = sum(map(len, labels))
    weight = np.array([total / max(2 * (total - ones), 1), total / max(2 * ones, 1)])
    epochs = [-(-n // len(batches)) for n in updates]
    rng = np.random.default_rng(7)
    table = rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    u = np.full(DIM, 1 / DIM**0.5, np.float32)
    bias, seen_table, seen_u, seen_bias = 0.0, np.full(1 << BITS, 1e-8), 1e-8, 1e-8
    for epoch in range(sum(epochs)):
        whole = epoch < epochs[0]
        if epoch == epochs[0]:
            bias, seen_bias, seen_u = 0.0, 1e-8, 1e-8
            seen_table[:] = 1e-8
        gain = WHOLE_GAIN if whole else SPAN_GAIN
        for (rows, start, number, first, _), y in zip(batches, labels, strict=True):
            word = _means((table @ u)[rows], start)
            if whole:
                lo, hi, mean = first[:-1], first[1:], _means(word[number], first)
            else:
                lo, hi, mean = _worst(word[number], first, SPAN)
            g = (sigmoid(gain * mean + bias) - y) * weight[y.astype(int)] / len(y)
            size = hi - lo
            taken = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            per_word = np.bincount(number[taken], np.repeat(gain * g / np.maximum(size, 1), size), len(start) - 1)
            n = np.diff(start)
            used = np.repeat(per_word != 0, n)
            per_row = np.bincount(rows[used], np.repeat(per_word / np.maximum(n, 1), n)[used], 1 << BITS).astype(np.float32)
            hit = np.flatnonzero(per_row)
            grad_u = per_row[hit] @ table[hit]
            seen_table[hit] += per_row[hit] ** 2 * float(u @ u)
            table[hit] -= (rate * per_row[hit] / np.sqrt(seen_table[hit]))[:, None].astype(np.float32) * u
            seen_u += float(grad_u @ grad_u)
            u = u - (0.05 * grad_u / seen_u**0.5).astype(np.float32)
            gb = float(g.sum())
            seen_bias += gb * gb
            bias -= 0.5 * gb / seen_bias**0.5
    return SPAN_GAIN * (table @ u), bias


def _fit(sample: DataFrame, updates: tuple[int, int], batch_rows: int = 64) -> tuple[np.ndarray, float]:
    """Train in one task, on a sample of bounded size."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text as its distinct words, each once with its count."""
        for batch in batches:
            words, counts = [], []
            for text in batch.column("text"):
                w = Words(*buffers(pa.array([text.as_py()], pa.string())), separators=MARKS, lower=True)
                _, first, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                words.append(b" ".join(w.buf[w.starts[i] : w.ends[i]].tobytes() for i in first))
                counts.append(squeeze(n.astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.binary()), batch.column("label"), batch.column("turn")], ["words", "counts", "label", "turn"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("words", "counts", "label")), strict=True)]
        if not rows:
            return
        bags, labels = [], []
        for a in range(0, len(rows), batch_rows):
            part = rows[a : a + batch_rows]
            w = Words(*buffers(pa.array([r[0] for r in part], pa.binary())), separators=MARKS, lower=True)
            _, first, number = np.unique(w.hashes(), return_index=True, return_inverse=True)
            times = np.concatenate([unsqueeze(r[1], np.uint32) for r in part]).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(times)])
            sub, start = subwords(w, first)
            bags.append((sub.astype(np.int32), start, np.repeat(number.astype(np.int32), times), ends[w.first], np.diff(ends[w.first])))
            labels.append(np.array([r[2] for r in part], float))
        scores, bias = train(bags, labels, updates)
        yield pa.RecordBatch.from_arrays([pa.array([squeeze(scores.astype(np.float32))], pa.binary()), pa.array([bias])], ["w", "bias"])

    ready = sample.mapInArrow(prepare, "words binary, counts binary, label int, turn long")
    rows = ready.repartition(1).sortWithinPartitions("turn").mapInArrow(learn, "w binary, bias double").collect()
    return (unsqueeze(rows[0]["w"], np.float32), rows[0]["bias"]) if rows else (np.zeros(1 << BITS, np.float32), 0.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "toxic", id_col: str = "doc_id", column: str = "text", threshold: float = 0.5, sample: int = 4000, updates: tuple[int, int] = UPDATES, prior: float = 0.25) -> DataFrame:
    """A toxicity score of each text, from the text alone.

    The model is fitted on at most `sample` labelled rows of each class (see
    labelled_sample) for which may_learn, an expression over the labels table,
    is true; the share of label 1 among all such rows then shifts the bias, in
    part (`prior`), as a text's worst span already tells much of it. Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in
    lower case.

    Returns id, score (0 to 1) and predicted (score >= threshold). Null and
    empty texts score as the bias alone. Every row gets a row, whatever its id;
    without labelled rows all score one half; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    found = labelled_sample(docs, labels, label_col, may_learn, id_col, column, sample)
    weights, bias = _fit(found.rows, updates)
    model = spark.sparkContext.broadcast((weights, bias + prior * found.class_odds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                rows, start, number, first, _ = bag(part.column("text"))
                p = sigmoid(_worst(_means(w[rows], start)[number], first, SPAN)[2] + b)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    texts = docs.select(docs[id_col].alias("id"), docs[column].cast("string").alias("text"))
    return texts.mapInArrow(run, T.StructType([T.StructField(id_col, texts.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
