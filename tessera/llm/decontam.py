"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton (Blumer et al. 1985) of all items' word sequences is built on the
driver and sent to the executors. Each text's words stream through it, which
gives at every word the longest match that ends there. Spans reaching the
length limit, or the coverage limit of an item, are hits. Most words of a
corpus can't be in a hit: only stretches whose every word pair occurs in some
item are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tessera.llm.core import MARKS, Words, buffers, slices
from tessera.llm.substring import cut_texts
from tessera.runtime import ship


class Automaton:
    """Suffix automaton of several word sequences, with the windows that count as hits marked on its states."""

    def __init__(self, items: list[list[int]], max_words: int, coverage: float):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for item in items:
            last = 0
            for t in item:
                last = self._extend(last, t)
        need = [min(max_words, max(1, ceil(coverage * len(i) - 1e-9))) for i in items]
        #: windows of each state: (words, items that hold it)
        self.marks: dict[int, dict[int, list[int]]] = {}
        for n, (item, k) in enumerate(zip(items, need, strict=True)):
            state = 0
            for i, t in enumerate(item):
                state = self.next[state][t]
                if i + 1 >= k:
                    at = state
                    while self.length[self.link[at]] >= k:
                        at = self.link[at]
                    held = self.marks.setdefault(at, {}).setdefault(k, [])
                    if not held or held[-1] != n:
                        held.append(n)
        #: nearest marked state on the way to the root, the state itself included
        self.up = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.up[s] = s if s in self.marks else self.up[self.link[s]]
        self.shortest = min((need[n] for n, i in enumerate(items) if i), default=0)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, t: int) -> int:
        """The state of the current item one word longer."""
        known = self.next[last].get(t)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, t, known)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, t, q)
        return state

    def _clone(self, p: int, t: int, q: int) -> int:
        """Split q: its strings no longer than those of p and t get a state of their own."""
        c = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = c
            p = self.link[p]
        return c

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, list[int]]]:
        """(end, words, items) of every marked window in a word sequence."""
        state = matched = 0
        step, link, length, up, marks = self.next, self.link, self.length, self.up, self.marks
        for i, t in enumerate(words):
            while state and t not in step[state]:
                state = link[state]
                matched = length[state]
            if t in step[state]:
                state = step[state][t]
                matched += 1
            at = up[state]
            while at:
                for k, items in marks[at].items():
                    if k <= matched:
                        yield i, k, items
                at = up[link[at]]


class Matcher:
    """An automaton over hashed words, with the vocabulary and word pairs that open it."""

    def __init__(self, items: list[np.ndarray], names: list[str], max_words: int, coverage: float):
        every = np.concatenate(items) if items else np.zeros(0, np.uint64)
        self.names = names
        self.vocab = np.unique(every)
        ids = [np.searchsorted(self.vocab, i) for i in items]
        pairs = [i[:-1] * len(self.vocab) + i[1:] for i in ids]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.automaton = Automaton([i.tolist() for i in ids], max_words, coverage)

    @staticmethod
    def _in(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
        return at, sorted_values[at] == x

    def hits(self, w: Words) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Which words are hit, and (text, item) of each occurring window."""
        n = len(w)
        hit, found = np.zeros(n + 1, np.int32), set()
        if not n or not len(self.vocab):
            return np.zeros(n, bool), []
        ids, known = self._in(self.vocab, w.hashes())
        doc = w.doc()
        chain = np.zeros(n, bool)  # word i goes on from word i - 1
        at = np.flatnonzero(known[1:] & known[:-1] & (doc[1:] == doc[:-1]))
        if len(at) and len(self.pairs):
            chain[at + 1] = self._in(self.pairs, ids[at] * len(self.vocab) + ids[at + 1])[1]
        start = np.flatnonzero(known & ~chain)
        stop = np.append(np.flatnonzero(~chain)[1:], n)[np.searchsorted(np.flatnonzero(~chain), start)]
        long = stop - start >= self.automaton.shortest
        for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True):
            for i, k, items in self.automaton.stream(ids[a:b].tolist()):
                hit[a + i - k + 1] += 1
                hit[a + i + 1] -= 1
                found.update((int(doc[a]), x) for x in items)
        return np.cumsum(hit[:n]) > 0, sorted(found)


def matchers(benchmark: DataFrame, item_col: str, text_col: str, max_words: int, coverage: float, words_each: int = 2_000_000) -> list[Matcher]:
    """Automata of all items, each over at most words_each words (or one item); items come to the driver one partition at a time."""
    out, items, names, size = [], [], [], 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text")).toLocalIterator():
        h = Words(*buffers(pa.array([row["text"]], pa.string())), separators=MARKS, lower=True).hashes()
        if items and size + len(h) > words_each:
            out.append(Matcher(items, names, max_words, coverage))
            items, names, size = [], [], 0
        items.append(h)
        names.append(row["name"] or "")
        size += len(h)
    return [*out, Matcher(items, names, max_words, coverage)] if items else out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", column: str = "text", item_col: str = "item_id", item_text: str = "text", max_words: int = 10, coverage: float = 1.0) -> DataFrame:
    """Words of each text that lie in test items.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in
    lower case. A span is a hit if it holds max_words consecutive words of an
    item, or the share `coverage` of an item's words if that is fewer; an item
    without words is never hit. Returns id, n_words, n_hit, n_items,
    items_sha256 (of the hit items' ids as text, sorted, joined by commas; a
    null id is empty), contaminated and spans (maximal hit word intervals
    [start, end)).

    Null and empty texts have no words. Every row of docs gets a row, whatever
    its id; repeated items count each. An empty benchmark hits nothing, an
    empty table gives no rows. Other columns are not read. The automata are
    sent to every executor: memory follows the benchmark, not the corpus.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = [spark.sparkContext.broadcast(m) for m in matchers(benchmark, item_col, item_text, max_words, coverage)]
    docs = docs.select(docs[id_col].alias("id"), docs[column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(*buffers(part.column("text")), separators=MARKS, lower=True)
                hit, names = _hits(w, sent)
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[w.first[1:]] - total[w.first[:-1]]
                spans = [[] for _ in n_hit]
                for d in np.flatnonzero(n_hit).tolist():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[w.first[d] : w.first[d + 1]].astype(np.int8), [0]])))
                    spans[d] = [{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(w.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(names.get(d, ())) for d in range(len(n_hit))], pa.int64()),
                        pa.array([hashlib.sha256(",".join(sorted(names.get(d, ()))).encode()).hexdigest() for d in range(len(n_hit))], pa.string()), pa.array(n_hit > 0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    [f.name for f in schema],
                )

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(id_col, docs.schema["id"].dataType), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("spans", span)])
    return docs.mapInArrow(run, schema)


def _hits(w: Words, sent: list) -> tuple[np.ndarray, dict[int, list[str]]]:
    hit, names = np.zeros(len(w), bool), {}
    for b in sent:
        own, found = b.value.hits(w)
        hit |= own
        for d, i in found:
            names.setdefault(d, []).append(b.value.names[i])
    return hit, names


def decontaminate(docs: DataFrame, benchmark: DataFrame, column: str = "text", item_col: str = "item_id", item_text: str = "text", max_words: int = 10, coverage: float = 1.0) -> DataFrame:
    """docs with hit spans cut from the text (see contamination()); every other column and row stays.

    A span is cut from its first word up to the next kept word, or the end of
    the text. Texts without hits are unchanged, byte for byte; null stays null.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = [spark.sparkContext.broadcast(m) for m in matchers(benchmark, item_col, item_text, max_words, coverage)]
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                raw, offsets = buffers(part.column(at))
                w = Words(raw, offsets, separators=MARKS, lower=True)
                hit, _ = _hits(w, sent)
                arrays = part.columns
                arrays[at] = cut_texts(part.column(at), w, raw, hit)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
