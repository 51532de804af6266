"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words and its runs of symbols in hashed places (square roots of their counts, scaled to
length one), and statistics of its structure, and its length, each as the bin it falls in. The score is the logistic
function of b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; the pairs take linear time, as half of
sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2). Labels, language, source and ids are never features.

The model is fitted on at most ``rows`` labelled documents (a documented bound; picked by a hash of their ids) and
its size is fixed, so it is broadcast. Documents are scored where they are read; there is no shuffle of texts.
"""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import CACHES, slices, texts

PLACES, BINS, RANK = 1 << 15, 16, 6
_SYMBOLS = re.compile(r"[^\w\s]+")
#: Statistics and the step of their bins.
STATISTICS = {"log2 characters": 1.0, "log2 words": 1.0, "characters a word": 0.8, "capitals": 0.0625, "digits": 0.02, "symbols": 0.02, "bars": 0.0625, "distinct words": 0.0625, "repeated lines": 0.0625, "words that end in symbols": 0.0625, "log2 characters a line": 1.0, "short words": 0.0625, "log2 lines": 1.0, "words equal to the next one": 0.0625}
SIZE = PLACES + len(STATISTICS) * BINS


class _Places(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        p = self[word] = zlib.crc32(word.encode()) % PLACES
        return p


_places = _Places()
CACHES.append(_places)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values; also of an empty text."""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    signs = _SYMBOLS.findall(text)
    lines = text.split("\n")
    raw = text.encode()
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    ended = sum(len(s) > 1 for s in signs)
    values = (
        np.log2(len(text) + 1), np.log2(len(words) + 1), len(text) / n, by[65:91].sum() / chars, by[48:58].sum() / chars, sum(map(len, signs)) / chars, by[124] / n, len(set(words)) / n,
        1 - len(set(lines)) / len(lines), ended / n, np.log2(len(text) / len(lines) + 1), sum(len(w) < 4 for w in words) / n, np.log2(len(lines)), sum(map(eq, words, words[1:])) / n,
    )
    steps = np.array(list(STATISTICS.values()))
    bins = np.clip(np.array(values) / steps, 0, BINS - 1).astype(np.int64) + PLACES + BINS * np.arange(len(steps))
    get = _places.__getitem__
    place = np.fromiter(map(get, (*words, *("\0" + s for s in signs))), np.int64, len(words) + len(signs))
    place, count = np.unique(place, return_counts=True)
    x = np.sqrt(count)
    x /= np.sqrt(np.square(x).sum()) or 1.0
    return np.concatenate([place, bins]).astype(np.int32), np.concatenate([x, np.full(len(bins), 0.5)]).astype(np.float32)


def _stack(rows: list[tuple[np.ndarray, np.ndarray]]):
    at = np.cumsum([0, *(len(i) for i, _ in rows)])
    return np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), at


def raw_scores(model, i: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic function, and the sums of factors by row."""
    b, w, v = model
    vx = v[i] * x[:, None]
    sums = np.add.reduceat(vx, at[:-1])
    return b + np.add.reduceat(w[i] * x, at[:-1]) + 0.5 * (np.square(sums) - np.add.reduceat(np.square(vx), at[:-1])).sum(1), sums


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 1_000, batch: int = 128, rate: float = 0.08, decay: float = 1e-4, seed: int = 7):
    """(bias, weights, factors) by AdaGrad on the logistic loss. With one class only (or no rows) a constant model."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    b, w, v = float(np.log(share / (1 - share))), np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, RANK)).astype(np.float32)
    gb, gw, gv = 1.0, np.full(SIZE, 0.1, np.float32), np.full((SIZE, RANK), 0.1, np.float32)
    if len(set(labels.tolist())) < 2:
        return b, w, v * 0
    for _ in range(max(8, -(-steps * batch // len(rows)))):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            i, x, at = _stack([rows[j] for j in chosen])
            z, sums = raw_scores((b, w, v), i, x, at)
            d = (1 / (1 + np.exp(-z)) - labels[chosen]).astype(np.float32)
            each = np.repeat(np.arange(len(chosen)), np.diff(at))
            places, to = np.unique(i, return_inverse=True)
            dx = d[each] * x
            dv = dx[:, None] * (sums[each] - v[i] * x[:, None])
            w_step = np.bincount(to, dx, len(places)) / len(chosen) + decay * w[places]
            v_step = np.stack([np.bincount(to, dv[:, f], len(places)) for f in range(RANK)], 1) / len(chosen) + decay * v[places]
            gw[places] += np.square(w_step)
            gv[places] += np.square(v_step)
            gb += float(d.mean()) ** 2
            w[places] -= rate * w_step / np.sqrt(gw[places])
            v[places] -= rate * v_step / np.sqrt(gv[places])
            b -= rate * float(d.mean()) / gb**0.5
    return b, w, v


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = 8_000):
    """The model, from at most ``rows`` labelled documents that are not held out."""
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )

    def run(batches):
        for b in slices(batches):
            f = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([i for i, _ in f], pa.list_(pa.int32())), pa.array([x for _, x in f], pa.list_(pa.float32()))], ["doc_id", "label", "i", "x"])

    # Of several rows with one id the one with the least hash of its text counts; tasks drop the others before anything is sent.
    labelled = texts(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    known = labelled.mapInArrow(run, "doc_id long, label int, i array<int>, x array<float>").toArrow().combine_chunks().sort_by("doc_id")
    return fit([(np.array(a.values), np.array(b.values)) for a, b in zip(known["i"], known["x"])], known["label"].to_numpy().astype(np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 8_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null texts are empty; empty texts have a score as well. Labels other than 0 and 1 are ignored; without labels of
    both kinds every score is the labels' share. Repeated rows get equal scores, an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, rows))

    def run(batches):
        for b in slices(batches):
            z, _ = raw_scores(sent.value, *_stack([features(t) for t in b.column("text").to_pylist()]))
            score = (1 / (1 + np.exp(-z.astype(np.float64)))).round(12)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 8_000) -> DataFrame:
    """docs without the rows that score below threshold; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, rows))

    def run(batches):
        for b in slices(batches):
            z, _ = raw_scores(sent.value, *_stack([features(t or "") for t in b.column("text").to_pylist()]))
            yield b.filter(pa.array(1 / (1 + np.exp(-z.astype(np.float64))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
