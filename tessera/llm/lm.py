"""Language-model scores: trigrams, bigrams and unigrams mixed by deleted interpolation.

After Jelinek and Mercer (1980): P(w | u v) = l3 c(u v w) / c(u v) +
l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1), with the weights l chosen by the
frequency of the context: that of u v, or of v alone where u v is unseen. An
estimate whose context is unseen has no weight, so that probabilities sum to 1.
Expectation-maximisation learns the weights on the tokens of a held-out share
of the training texts, against counts from which that share's own are deleted;
the scores then use all training counts.

Counts are asked for block by block (see blocks.py), so neither vocabulary nor
n-grams are ever held in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tessera.llm import blocks as bl
from tessera.llm.core import Words, buffers, mix64, squeeze, unsqueeze
from tessera.runtime import Scratch, ship

#: tokens that no word hashes to but by chance
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: classes of a context's frequency: each number up to 4 its own, then each power of two
FREQUENCIES = 48
#: contexts of two words, then of one where two are unseen, then none
CLASSES = 2 * FREQUENCIES + 1
#: bits of an n-gram's key within its bucket of some two million
_GRAM_BITS = np.uint64((1 << 40) - 1)


class _Tokens:
    """Tokens of a block: each text's words and one end, with the two tokens before each."""

    def __init__(self, batch: pa.RecordBatch):
        w = Words(*buffers(batch.column("text")), lower=True)
        self.counts = w.counts + 1
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        n = int(self.first[-1])
        self.token = np.full(n, END, np.uint64)
        self.token[np.arange(len(w)) + np.repeat(np.arange(batch.num_rows), w.counts)] = w.hashes()
        self.train = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), self.counts)

    def back(self, values: np.ndarray, start: float) -> np.ndarray:
        """Of each token, the value of the one before it; `start` at a text's first."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first[:-1]] = start
        return out

    def keys(self, buckets: tuple[int, int, int]) -> list[bl.Keys]:
        """The distinct tokens, bigrams and trigrams."""
        v = self.back(self.token, BEGIN)
        u = self.back(v, BEGIN)
        two, other = mix64(v * _ODD ^ mix64(self.token)), mix64(v ^ mix64(self.token * _ODD2))
        three, another = mix64(u * _ODD ^ two), mix64(u * _ODD2 ^ other)
        return [
            bl.Keys(self.token, bl.bucket_of(mix64(self.token ^ BEGIN), buckets[0])),
            bl.Keys(two & _GRAM_BITS, bl.bucket_of(other, buckets[1])),
            bl.Keys(three & _GRAM_BITS, bl.bucket_of(another, buckets[2])),
        ]


def _classes(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The class of each context, from the counts of its two words and of its last."""

    def frequency(n: np.ndarray) -> np.ndarray:
        n = np.maximum(n, 1)
        return np.where(n <= 4, n - 1, np.minimum(np.log2(n).astype(np.int64) + 2, FREQUENCIES - 1)).astype(np.int64)

    return np.where(pair > 0, frequency(pair), np.where(word > 0, FREQUENCIES + frequency(word), 2 * FREQUENCIES))


#: which of the trigram, bigram, unigram and uniform estimates a class has
ALLOWED = np.ones((CLASSES, 4))
ALLOWED[FREQUENCIES:, 0] = 0
ALLOWED[-1, 1] = 0


def _estimates(tokens: _Tokens, one: np.ndarray, two: np.ndarray, three: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Context class, and trigram, bigram and unigram maximum-likelihood estimates, of each token."""
    texts = float(one[-1]) if len(one) else 0.0  # each text has one end, which is the last token of the block too
    word, pair = tokens.back(one, texts), tokens.back(two, texts)
    return _classes(pair, word), np.stack([np.where(pair > 0, three / np.maximum(pair, 1), 0), np.where(word > 0, two / np.maximum(word, 1), 0), one / max(n, 1)], 1)


def start_weights() -> np.ndarray:
    weights = ALLOWED * [0.4, 0.3, 0.2, 0.1]
    return weights / weights.sum(1, keepdims=True)


def expected(classes: np.ndarray, estimates: np.ndarray, uniform: float, weights: np.ndarray) -> np.ndarray:
    """Of each class, how many tokens each estimate is held responsible for."""
    parts = weights[classes] * np.concatenate([estimates, np.full((len(classes), 1), uniform)], 1)
    parts /= parts.sum(1, keepdims=True)
    return np.stack([np.bincount(classes, parts[:, i], CLASSES) for i in range(4)], 1)


def maximised(sums: np.ndarray) -> np.ndarray:
    """Weights from those sums; a class without tokens keeps an even mixture, and no allowed weight is 0."""
    sums = (sums + 0.1) * ALLOWED
    return sums / sums.sum(1, keepdims=True)


def _learn(held: DataFrame, uniform: float, rounds: int) -> np.ndarray:
    """Weights of the estimates for each context class, by expectation-maximisation."""
    weights = start_weights()
    for _ in range(rounds):
        now = weights.copy()

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((CLASSES, 4))
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    c, f = bl.unbundle(raw, 2)
                    total += expected(unsqueeze(c, np.uint8).astype(np.int64), unsqueeze(f, np.float32).reshape(3, -1).T, uniform, now)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), *(pa.array(total[:, i]) for i in range(4))], ["c", "w0", "w1", "w2", "w3"])

        sums = np.zeros((CLASSES, 4))
        for r in held.mapInArrow(run, "c int, w0 double, w1 double, w2 double, w3 double").groupBy("c").agg(*(F.sum(f"w{i}").alias(f"w{i}") for i in range(4))).collect():
            sums[r["c"]] = r["w0"], r["w1"], r["w2"], r["w3"]
        weights = maximised(sums)
    return weights


def score_texts(docs: DataFrame, train, id_col: str = "doc_id", column: str = "text", held_out_every: int = 16, rounds: int = 12, sizes: bl.Sizes = bl.Sizes()) -> DataFrame:
    """log10 probability of each text, under the interpolated model and under add-one unigrams.

    Tokens are words (runs of characters other than blanks and \\t..\\r, A-Z in
    lower case) and one end a text. `train` is a boolean column of docs: the
    model learns from the rows where it is true (null counts as false), and one
    in held_out_every of those, by a hash of id and text, gives the held-out
    counts.

    Returns id, train, n_tokens, n_known (tokens met in training), train_tokens
    (N), train_types (V), base_score (sum of log10((c + 1) / (N + V + 1))) and
    score. Null and empty texts are an end alone. Repeated rows and ids each
    count and get a row. Without training rows every token is unknown. An empty
    table gives no rows; other columns are not read. sizes sets the blocks and
    buckets of the exchange, not the result (see blocks.py).
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lm")
    held = (F.pmod(F.xxhash64(docs[id_col].cast("string"), docs[column].cast("string")), F.lit(held_out_every)) == 0) & F.coalesce(train, F.lit(False))
    docs = docs.select(docs[id_col].alias("id"), docs[column].cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"), held.alias("held"))
    id_type = docs.schema["id"].dataType
    away = bl.pack(scratch, docs.where("held"), "text", sizes, "held", negative=True, fill=True)
    rest = bl.pack(scratch, docs.where("not held"), "text", sizes, "rest", fill=True)
    size = [(bl.buckets_for(away, k, sizes), bl.buckets_for(rest, k, sizes)) for k in (0.04, 0.13, 0.16)]
    buckets = tuple(a + b for a, b in size)
    exchange = bl.Exchange(scratch, buckets, values=2, sizes=sizes, shared=1)  # own counts matter to the held-out share alone

    def question(batch: pa.RecordBatch) -> list[tuple[bl.Keys, list[np.ndarray]]]:
        tokens = _Tokens(batch)
        share = batch.num_rows and batch.column("held")[0].as_py()  # a block's texts are held out all or none
        asked = []
        for keys in tokens.keys(buckets):
            n = keys.sum(tokens.train.astype(np.uint64))
            asked.append((keys, [n, n if share else np.zeros_like(n)]))
        return asked

    answers = exchange.answer(exchange.ask(away, question).union(exchange.ask(rest, question)))
    found = answers.where(F.shiftright("place", 48) == 0).agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("news", "sum0", "sum1"))).first()
    types, n, n_held = (int(x) for x in found)

    def counts(batch: pa.RecordBatch, got: list[bl.Reply], some: int = 1) -> tuple[_Tokens, list[list[np.ndarray]]]:
        """Of each token, its n-grams' counts in all training texts, and with some=2 in their held-out share."""
        tokens = _Tokens(batch)
        return tokens, [[keys.back(x.astype(np.float64)) for x in r.sums[:some]] for keys, r in zip(tokens.keys(buckets), got, strict=True)]

    def deleted(batch: pa.RecordBatch, got: list[bl.Reply]) -> Iterator[pa.RecordBatch]:
        tokens, found = counts(batch, got, 2)
        c, f = _estimates(tokens, *(whole - own for whole, own in found), n - n_held)
        yield pa.RecordBatch.from_arrays([pa.array([bl.bundle(squeeze(c.astype(np.uint8)), squeeze(f.T.astype(np.float32).ravel()))], pa.binary())], ["held"])

    parts = scratch.write(exchange.finish(away, answers.where("block_id < 0"), deleted, "held binary"), "estimates")
    uniform = 1 / (types + 1)
    weights = _learn(parts, uniform, rounds)

    def last(batch: pa.RecordBatch, got: list[bl.Reply]) -> Iterator[pa.RecordBatch]:
        tokens, ((one,), (two,), (three,)) = counts(batch, got)
        if not len(tokens.token):
            return
        c, f = _estimates(tokens, one, two, three, n)
        w = weights[c]
        at = tokens.first[:-1]
        score = np.add.reduceat(np.log10((w[:, :3] * f).sum(1) + w[:, 3] * uniform), at)
        base = np.add.reduceat(np.log10((one + 1) / (n + types + 1)), at)
        known = np.add.reduceat((one > 0).astype(np.int64), at)
        full = [pa.array(np.full(batch.num_rows, x, np.int64)) for x in (n, types)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("train"), pa.array(tokens.counts.astype(np.int64)), pa.array(known), *full, pa.array(base), pa.array(score)], [x.name for x in schema])

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("train", T.BooleanType()), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens", "train_types")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return exchange.finish(away, answers.where("block_id < 0"), last, schema).unionByName(exchange.finish(rest, answers.where("block_id > 0"), last, schema))
