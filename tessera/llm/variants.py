"""Spelling variants: words one edit apart, by full neighbourhood generation.

Every word of the vocabulary emits the keys of all distinct strings that one
deletion, replacement or insertion over the observed alphabet makes of it, and
the keys are joined with those of the vocabulary. A key is a sum of random
64-bit numbers of (letter, position), twice: the sums before a position and
those after it, moved by one, give each candidate's key by two additions, so a
word of a hundred thousand letters costs no more for each candidate than a
short one. Two 64-bit keys agree for different strings with odds of 2**-128 a
pair, so what joins is near, and no distance is computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.core import mix64
from tessera.runtime import Scratch, ship

U = np.uint64
_SEEDS = (U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03))
#: candidates made at once
AT_ONCE = 1 << 19
#: the filter's bits for each word, and its bytes at most: past those it lets more candidates through to the join
FILTER_BITS, FILTER_BYTES = 24, 64 << 20
#: vocabulary words for each task that makes candidates
TASK_WORDS = 4_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(word: Column) -> Column:
    """With A-Z lower-cased and no other letter; words that have none pass through."""
    return F.when(word.rlike("[A-Z]"), F.translate(word, _UPPER, _LOWER)).otherwise(word)


def runs(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): every match of a pattern in every text, lower-cased in A-Z."""
    found = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(pattern), F.lit(0)))
    return docs.select(F.col(id_col).alias("id"), found.alias("run")).select("id", ascii_lower(F.col("run")).alias("run"))


def with_slips(rows: DataFrame, modulus: int) -> DataFrame:
    """(word) of runs (id, run), where some occurrences lose one letter, as their checksum says.

    h is the unsigned CRC-32 of `<id>:<run>` in UTF-8 (a null id is empty).
    Where the modulus divides h, the code point h % length goes.
    """
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.withColumn("h", h).select(F.when(F.pmod("h", F.lit(modulus)) == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of words (word): those of so many code points and occurrences at least. Counts are summed in each task first, so a word of a third of all rows is one row a task."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _numbers(code: np.ndarray, place: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A random 64-bit number of each letter at its position."""
    with np.errstate(over="ignore"):
        return mix64(mix64(code.astype(U) + seed) + (place.astype(np.int64).view(U) + U(1)) * _SEEDS[0] ^ seed)


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def keys_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both keys of words of one length."""
    at = np.arange(codes.shape[1])
    k, m = (_numbers(codes, at, s).sum(1, dtype=U) for s in _SEEDS)
    return k, m


def _of_length(words: list[str], cells: int) -> Iterator[np.ndarray]:
    """Positions of words of one length, so many letters at once and one word at least."""
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        step = max(1, cells // max(int(size[part[0]]), 1)) if len(part) else 1
        for a in range(0, len(part), step):
            yield part[a : a + step]


class Neighbourhood:
    """Keys of all distinct strings one edit away from each of some words of one length.

    Equal results are made once: of a run of equal letters the first goes, a
    letter is inserted before no letter equal to it, and replaced by others only.
    """

    def __init__(self, codes: np.ndarray, alphabet: np.ndarray):
        self.codes, self.alphabet = codes, alphabet
        self.sides = [self._sides(s) for s in _SEEDS]

    def _sides(self, seed: np.uint64) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sums before each position, and sums from it on with letters one place down, where they are, and one up."""
        n, length = self.codes.shape
        at = np.arange(length)
        before = np.zeros((n, length + 1), U)
        np.cumsum(_numbers(self.codes, at, seed), axis=1, out=before[:, 1:])
        after = []
        for shift in (-1, 0, 1):
            s = np.zeros((n, length + 1), U)
            s[:, :-1] = np.cumsum(_numbers(self.codes, at + shift, seed)[:, ::-1], axis=1, dtype=U)[:, ::-1]
            after.append(s)
        return before, after

    def candidates(self, may_be: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, first key, second key) of the candidates whose first key passes may_be."""
        n, length = self.codes.shape
        (b1, (down1, same1, up1)), (b2, (down2, same2, up2)) = self.sides
        fresh = np.ones((n, length), bool)
        fresh[:, 1:] = self.codes[:, 1:] != self.codes[:, :-1]
        word, at = np.nonzero(fresh)
        key = b1[word, at] + down1[word, at + 1]
        ok = may_be(key)
        yield word[ok], key[ok], (b2[word, at] + down2[word, at + 1])[ok]

        width = max(1, AT_ONCE // max(n * len(self.alphabet), 1))
        for lo in range(0, length + 1, width):
            at = np.arange(lo, min(lo + width, length + 1))
            letter = [_numbers(self.alphabet[None], at[:, None], s) for s in _SEEDS]
            inner = at[at < length]
            for places, k1, k2 in ((at, up1[:, at], up2[:, at]), (inner, same1[:, inner + 1], same2[:, inner + 1])):
                # candidates that have a letter other than the word's at the place
                other = np.ones((n, len(places), len(self.alphabet)), bool)
                other[:, : len(inner)] = self.codes[:, inner, None] != self.alphabet
                word, p, c = np.nonzero(other)
                key = (b1[:, places] + k1)[word, p] + letter[0][p, c]
                ok = may_be(key)
                word, p, c = word[ok], p[ok], c[ok]
                yield word, key[ok], (b2[:, places] + k2)[word, p] + letter[1][p, c]


def _bits(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three bit numbers of a filter whose size is a power of two."""
    mask = U(bits - 1)
    return [key & mask, (key >> U(32)) & mask, mix64(key) & mask]


def _may_be(filled: np.ndarray, key: np.ndarray) -> np.ndarray:
    ok = np.ones(len(key), bool)
    left = np.arange(len(key))
    for i in range(3):
        bit = _bits(key[left], len(filled) * 8)[i]
        hit = (filled[bit >> U(3)] >> (bit & U(7)).astype(np.uint8)) & 1 == 1
        ok[left[~hit]] = False
        left = left[hit]
    return ok


def _filter(keyed: DataFrame, n: int) -> Broadcast:
    """A Bloom filter of the vocabulary's first keys, of bounded size whatever their number."""
    bits = 1 << min(max(n * FILTER_BITS, 1 << 10).bit_length(), (FILTER_BYTES * 8).bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for bit in _bits(batch.column("k1").to_numpy().view(U), bits):
                np.bitwise_or.at(filled, (bit >> U(3)).astype(np.int64), (1 << (bit & U(7))).astype(np.uint8))
        words = filled.view(np.int64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_pydict({"at": used, "bits": words[used]})

    rows = keyed.select("k1").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return keyed.sparkSession.sparkContext.broadcast(words.view(np.uint8))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of words (word, n) one insertion, deletion or replacement of a code point apart.

    Words must be distinct; null ones have no pairs.
    """
    spark = words.sparkSession
    ship(spark)
    scratch = Scratch(spark, "variants")
    words = words.select("word", "n").where("word is not null")
    schema = "word string, n long, k1 long, k2 long"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("word").to_pylist()
            keys = np.zeros((2, len(listed)), U)
            for part in _of_length(listed, AT_ONCE):
                keys[:, part] = keys_of(_codes([listed[i] for i in part]))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *(pa.array(k.view(np.int64)) for k in keys)], ["word", "n", "k1", "k2"])

    kept = scratch.write(words.mapInArrow(keyed, schema), "keyed")
    n = kept.count()
    letters = kept.select(F.explode(F.split("word", "")).alias("c")).distinct().select(F.ascii("c").alias("code")).where("code > 0")
    # bounded by the number of code points
    alphabet = np.sort(letters.toArrow()["code"].to_numpy()).astype(np.uint32) if n else np.zeros(0, np.uint32)
    filled = _filter(kept, n)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filled.value
        for batch in batches:
            listed, count = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for part in _of_length(listed, max(AT_ONCE // max(len(alphabet), 1), 1)):
                names = [listed[i] for i in part]
                for word, k1, k2 in Neighbourhood(_codes(names), alphabet).candidates(lambda key: _may_be(bits, key)):
                    if len(word):
                        yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(word)), pa.array(count[part][word]), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], ["word", "n", "k1", "k2"])

    tasks = max(n // TASK_WORDS + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = kept.select("word", "n").repartition(tasks, "word").mapInArrow(emit, schema)
    listed = kept.select("k1", "k2", F.col("word").alias("near"), F.col("n").alias("near_n"))
    return made.join(listed.hint("shuffle_hash"), ["k1", "k2"]).select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): forms followed to the last. Chains must end; each round doubles the steps taken."""
    scratch = Scratch(forms.sparkSession, "roots")
    now, turn = scratch.write(forms.select("word", F.col("form").alias("root")), "0"), 0
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        turn += 1
        moved = scratch.write(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), str(turn))
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def group(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), distinct.

    form: of the near words the one with the largest n (of equals the first in
    code-point order), if that n is ratio times the word's or more; else null.
    root: forms followed to the last, the word itself without one. A word's form
    has more occurrences than the word, so no chain returns.
    """
    scratch = Scratch(words.sparkSession, "group")
    words = scratch.write(words.select("word", "n"), "words")
    first = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("first")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), first)
    fits = -F.col("first.minus") >= ratio * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("first.near")).alias("form"), F.when(fits, -F.col("first.minus")).alias("form_n"))
    out = scratch.write(out, "forms")
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, pattern: str = "[A-Za-zÀ-ÿ]+", slips: int | None = None, least_length: int = 6, least_count: int = 5, ratio: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word of the whole texts of docs: see group().

    Words are matches of a pattern, A-Z lower-cased, of least_length code points
    and least_count occurrences overall. slips plants misspellings (see
    with_slips). Null and empty texts have no words; a null id counts as empty;
    repeated rows count each time; an empty table gives no rows; other columns
    are not read. Words of any length take part.
    """
    found = runs(docs, pattern, id_col, text_col)
    words = with_slips(found, slips) if slips else found.select(F.col("run").alias("word"))
    return group(vocabulary(words, least_length, least_count), ratio)
