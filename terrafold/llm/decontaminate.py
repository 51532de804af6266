"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment of words scores them.

1. Every 3-word n-gram of the test items is counted over all documents (document frequencies, combined in the tasks).
2. Seeds are an item's n-grams that are rare for the item: up to four times its median frequency (and ``SOME`` more),
   and the rarest one of each stretch of ``STRETCH`` n-grams in any case. So a passage that many documents share still
   has its seeds, and edited copies meet a seed between any two edits; only n-grams of common words drop out.
3. Documents are scanned for seeds; where one hits, the item is aligned with the words around. Matches count 1,
   mismatches and gaps -0.5; the best local score over the item's length is the similarity: 1 for an exact copy.

Items are broadcast in parts of at most ``PART`` characters; more items than one part holds take more passes over the
documents, each with bounded memory.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import CACHES, slices, texts

GRAM, STRETCH, SOME, SLACK, PART = 3, 6, 20, 8, 8_000_000
#: ASCII signs that aren't letters or digits become spaces; others are taken out first.
_SPACES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_SIGNS = re.compile(r"[^\w\x00-\x7f]+")
_M = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()
CACHES.append(_hashes)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the runs of letters and digits, in lower case."""
    text = text.lower()
    words = (text if text.isascii() else _SIGNS.sub(" ", text)).encode().translate(_SPACES).split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams in order; of all words as one if there are fewer."""
    n = min(GRAM, len(h))
    if not n:
        return h
    x = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        x = (x ^ (x >> np.uint64(29))) * _M + h[j : j + len(x)]
    return (x ^ (x >> np.uint64(32))) * _M


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score over the item's length, and the first and last word (exclusive) of the passage."""
    equal = item[:, None] == words[None, :]
    gap, n = 0.5, len(words)
    score, begin = np.zeros(n + 1), np.arange(n + 1)
    slope = gap * np.arange(n + 1)
    best = (0.0, 0, 0)
    for row in equal:
        step, from_ = np.where(row, 1.0, -0.5) + score[:-1], begin[:-1]
        down = score[1:] - gap
        take = step >= down
        new = np.concatenate([[0.0], np.where(take, step, down)])
        origin = np.concatenate([[0], np.where(take, from_, begin[1:])])
        origin = np.where(new <= 0, np.arange(n + 1), origin)
        new = np.maximum(new, 0)
        # Gaps in the item: the best of all places to the left, less the gap's length.
        lifted = new + slope
        top = np.maximum.accumulate(lifted)
        where = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score, begin = top - slope, origin[where]
        k = int(np.argmax(score))
        if score[k] > best[0]:
            best = (float(score[k]), int(begin[k]), k)
    return best[0] / len(item), best[1], best[2]


class Places:
    """Sorted distinct hashes, behind a table of bits that turns away nearly all others."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self._low(self.hashes)] = True

    def _low(self, g: np.ndarray) -> np.ndarray:
        return (g >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into g of what is held, and its places among the hashes."""
        maybe = np.flatnonzero(self.table[self._low(g)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.hashes, g[maybe]), len(self.hashes) - 1)
        held = self.hashes[at] == g[maybe]
        return maybe[held], at[held]


class Seeds:
    """Items' words, and places of their seeds in order of their hashes."""

    def __init__(self, items: list[np.ndarray], chosen: list[tuple[int, int, int]]):
        self.items = items
        chosen.sort()
        self.hash = np.array([h for h, _, _ in chosen], np.uint64)
        self.item, self.at = np.array([i for _, i, _ in chosen], np.int64), np.array([p for _, _, p in chosen], np.int64)
        self.places = Places(self.hash)

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in a document, items, and where the document's word for the item's first one would be."""
        where, _ = self.places.find(g)
        low, high = np.searchsorted(self.hash, g[where], "left"), np.searchsorted(self.hash, g[where], "right")
        n = high - low
        k = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        p = np.repeat(where, n)
        return p, self.item[k], p - self.at[k]


def passages(h: np.ndarray, seeds: Seeds, least: float):
    """(item, similarity, first word, last word exclusive) for the best passage of each item that reaches least."""
    if not len(h):
        return
    _, item, start = seeds.hits(grams(h))
    for i in np.unique(item).tolist():
        words, at = seeds.items[i], np.unique(start[item == i])
        best, done = (0.0, 0, 0), -len(words)  # starts are negative where a document begins inside the item
        for s in at.tolist():
            if s < done:  # covered by the last window
                continue
            low, high = max(0, s - SLACK), min(len(h), s + len(words) + 2 * SLACK)
            done = s + SLACK // 2
            a, x, y = align(words, h[low:high])
            if a > best[0]:
                best = (a, low + x, low + y)
        if best[0] >= least:
            yield i, *best


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.4) -> DataFrame:
    """doc_id, item_id, similarity, first_word, end_word for each document and item with a passage of similarity >= least.

    Null or wordless texts and items match nothing. Repeated documents give repeated rows; of items with one id
    each counts. Without items or documents the result is empty. Extra columns are ignored.
    """
    spark, source = docs.sparkSession, texts(docs)
    items = texts(benchmark, "item_id").withColumnRenamed("doc_id", "item_id").filter("text != ''")
    parts = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // PART))
    out = None
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        known = [(r.item_id, h) for r in rows if len(h := word_hashes(r.text))]
        found = _leaks(spark, source, [i for i, _ in known], [h for _, h in known], least)
        out = found if out is None else out.unionByName(found)
    return out


def _leaks(spark, source: DataFrame, ids: list[int], items: list[np.ndarray], least: float) -> DataFrame:
    every = [grams(h) for h in items]
    held = Places(np.concatenate(every) if every else np.empty(0, np.uint64))
    wanted = spark.sparkContext.broadcast(held)

    def count(batches):
        sums = np.zeros(len(wanted.value.hashes), np.int64)
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                _, at = wanted.value.find(grams(word_hashes(t)))
                if len(at):
                    sums[np.unique(at)] += 1
        k = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sums[k])], ["k", "n"])

    times = np.zeros(len(held.hashes), np.int64)
    for r in source.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        times[r.k] = r.n
    chosen = []
    for i, g in enumerate(every):
        n = times[np.searchsorted(held.hashes, g)]
        rarest = {a + int(np.argmin(n[a : a + STRETCH])) for a in range(0, len(g), STRETCH)}
        chosen += [(int(g[p]), i, p) for p in range(len(g)) if p in rarest or n[p] <= 4 * np.median(n) + SOME]
    sent = spark.sparkContext.broadcast((ids, Seeds(items, chosen)))

    def find(batches):
        names, seeds = sent.value
        for b in slices(batches):
            out = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                out += [(d, names[i], round(s, 9), x, y) for i, s, x, y in passages(word_hashes(t), seeds, least)]
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "similarity", "first_word", "end_word"])

    return source.mapInArrow(find, "doc_id long, item_id long, similarity double, first_word long, end_word long")
