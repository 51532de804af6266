"""LM scoring: stupid backoff from count tables over all documents.

A word's score given the words before it is c(n-gram) / c(its beginning) for the longest n-gram that the tables hold,
times 0.4 for each step back; the shortest is c(word) / N. Of two words and more only n-grams counted at least twice
are in the tables; otherwise every text would find all its own n-grams. A document's score is the sum of logarithms.

Most longer n-grams stand once, and so aren't in the tables. A first pass over the first bits of all hashes finds those
that may stand twice; only they and the words are counted. The tables are partitioned by ranges of the n-grams' hashes
and computed relationally in two shuffles. Documents form
blocks of a bounded size where they are read. A block's distinct n-grams, counted, go to their hash partitions as
packed columns, there they are summed over all blocks, and each block's texts meet the totals of its own n-grams, in the
same order. So the join moves an n-gram once for each block, not each occurrence, and a frequent n-gram is one entry a
block. Blocks are told by their content: if a second reading gave others the job would fail.
"""

import gc
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import CACHES, packed, slices, texts, unpacked

#: n-grams of a hash partition; times a longer n-gram must be counted; factor of a step back.
PARTITION, LEAST, BACKOFF = 1_000_000, 2, 0.4
#: Bits (as a power of two) of the bitmap of n-grams that may stand twice: 64 MB at most, sent compressed.
BITMAP = 29
_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()
CACHES.append(_hashes)


def gram_hashes(text: str, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of 1 to order words, by place of their first word; the last bit tells words from longer ones."""
    words = text.lower().encode().split()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    out, x = [], np.zeros(len(h), np.uint64)
    for n in range(1, order + 1):
        x = x[: len(h) - n + 1] * _A + h[n - 1 :] if n <= len(h) else x[:0]
        y = (x ^ (x >> _S)) * _B
        y = (y ^ (y >> _S)) * _B
        y ^= y >> _S
        out.append((y & ~np.uint64(1)) | np.uint64(n > 1))
        x = y
    return out


def block_scores(counts: list[list[np.ndarray]], words: float) -> np.ndarray:
    """Each document's score, from the counts of its n-grams by length and place."""
    out = np.zeros(len(counts))
    for k, c in enumerate(counts):
        if not len(c[0]):
            continue
        score = np.log(c[0] / words)
        step = np.ones(len(score), np.int64)  # length of the n-gram that counted
        for n in range(2, min(len(c), len(c[0])) + 1):
            ends = np.flatnonzero(c[n - 1]) + n - 1
            starts = ends - n + 1
            score[ends] = np.log(c[n - 1][starts] / c[n - 2][starts])
            step[ends] = n
        most = np.minimum(np.arange(1, len(score) + 1), len(c))
        out[k] = (score + (most - step) * np.log(BACKOFF)).sum()
    return out


def _parts_of(grams: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """Part, first and last place (exclusive) of sorted hashes in ranges of equal width."""
    p = ((grams >> _S) * np.uint64(parts)) >> _S
    at = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.empty(0, np.int64)
    return [(int(p[x]), int(x), int(y)) for x, y in zip(at, [*at[1:], len(p)])]


class Bits:
    """A bitmap that is sent compressed; a worker unpacks it once."""

    def __init__(self, bits: np.ndarray):
        self.packed = zstandard.compress(bits.tobytes(), 1)

    @cached_property
    def bits(self) -> np.ndarray:
        return np.frombuffer(zstandard.decompress(self.packed), np.uint8)


def repeated(source: DataFrame, order: int, words: int):
    """A broadcast bitmap, of a bounded size, of the n-grams of two words and more that may stand twice in all texts.

    Blocks send the first bits of their n-grams' hashes, enough that few others agree; a range of them is one part of
    the bitmap and is made in one task. What isn't in the bitmap stands once, so its exact count isn't asked for.
    """
    total = max(1, (order - 1) * words)
    held = max(16, min(BITMAP, total.bit_length() + 2))
    first = max(held, min(62, total.bit_length() + 5))
    parts = min(1 << (held - 6), 1 << max(0, (total // (4 * PARTITION)).bit_length()))
    shift = np.uint64(64 - first)

    def pack(batches):
        for b in slices(batches):
            longer = [g for t in b.column("text").to_pylist() for g in gram_hashes(t, order)[1:]]
            v = np.sort(np.concatenate(longer) if longer else np.empty(0, np.uint64)) >> shift
            v = v[np.append(np.ones(min(2, len(v)), bool), v[2:] != v[:-2])]  # twice at most
            rows = [(p, packed(np.diff(v[x:y], prepend=np.uint64(0)))) for p, x, y in _parts_of(v << shift, parts)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["part", "first"])

    def meet(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        v = np.sort(np.concatenate([np.cumsum(unpacked(x), dtype=np.uint64) for x in t["first"].to_pylist()]))
        again = v[1:][v[1:] == v[:-1]] << shift >> np.uint64(64 - held)
        bits = np.zeros((1 << held) // parts, bool)
        bits[(again & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((1 << held) // 8, np.uint8)
    found = source.mapInArrow(pack, "part long, first binary").repartition(parts, "part").groupBy("part").applyInArrow(meet, "part long, bits binary")
    for r in found.toLocalIterator():
        out[r.part * (len(out) // parts) : (r.part + 1) * (len(out) // parts)] = np.frombuffer(r.bits, np.uint8)
    # What this pass has shuffled isn't read again: Spark's cleaner deletes it once neither side refers to it.
    del found
    gc.collect()
    source.sparkSession.sparkContext._jvm.System.gc()
    return source.sparkSession.sparkContext.broadcast(Bits(out))


def _asked(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which n-grams' counts are asked for: words, and longer ones that may stand twice."""
    place = (grams >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)).astype(np.int64)
    return ((grams & np.uint64(1)) == 0) | ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1)


def language_model_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, n_words, score, mean_score for every row of docs.

    Texts without words, null ones among them, have score and mean 0. Repeated rows count as often as they stand and
    get equal scores. An empty table gives an empty one; extra columns are ignored.
    """
    source = texts(docs)

    def size(batches):
        n = sum(len(t.encode().split()) for b in slices(batches) for t in b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    words = source.select("text").mapInArrow(size, "n long").agg(F.sum("n")).first()[0] or 1
    parts = max(1, -(-words // PARTITION))
    twice = repeated(source, order, words)

    def blocks(batches):
        """Slices with a digest of what they hold, in two parts: the same in every pass over the texts."""
        for b in slices(batches):
            digest = xxhash.xxh3_128(repr(b.column("doc_id").to_pylist()).encode())
            for t in b.column("text").to_pylist():
                digest.update(t.encode() + b"\0")
            yield *(int(x) for x in np.frombuffer(digest.digest(), np.int64)), b

    def explode(batches):
        for block, digest, b in blocks(batches):
            every = [g for t in b.column("text").to_pylist() for g in gram_hashes(t, order)]
            grams, counts = np.unique(np.concatenate(every), return_counts=True)
            asked = _asked(twice.value.bits, grams)
            grams, counts = grams[asked], counts[asked]
            rows = [(p, block, digest, packed(np.diff(grams[x:y], prepend=np.uint64(0))), packed(counts[x:y])) for p, x, y in _parts_of(grams, parts)]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["part", "block", "digest", "grams", "counts"])

    def keep(batches):
        for block, digest, b in blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as writer:
                writer.write_batch(b)
            yield pa.RecordBatch.from_pylist([{"block": block, "digest": digest, "docs": zstandard.compress(sink.getvalue().to_pybytes(), 3)}])

    def total(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        each = [np.cumsum(unpacked(g), dtype=np.uint64) for g in t["grams"].to_pylist()]  # they are sorted, so differences are short
        found, to = np.unique(np.concatenate(each), return_inverse=True)
        sums = np.bincount(to, np.concatenate([unpacked(c) for c in t["counts"].to_pylist()]), len(found)).astype(np.uint64)
        sums[(found & np.uint64(1) == 1) & (sums < LEAST)] = 0
        back = np.split(sums[to], np.cumsum([len(x) for x in each])[:-1])
        return pa.table({"block": t["block"], "digest": t["digest"], "part": t["part"], "counts": pa.array([packed(x) for x in back], pa.binary())})

    def score(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        # Blocks of equal rows have one digest and equal totals: each part counts once, and the scores hold for each.
        held = [x for x in t["docs"].to_pylist() if x is not None]
        b = pa.ipc.open_stream(zstandard.decompress(held[0])).read_all()
        own = {p: c for p, c in zip(t["part"].to_pylist(), t["counts"].to_pylist()) if p is not None}
        totals = np.concatenate([np.empty(0, np.uint64), *(unpacked(own[p]) for p in sorted(own))])
        every = [gram_hashes(x, order) for x in b["text"].to_pylist()]
        grams, to = np.unique(np.concatenate([g for e in every for g in e]), return_inverse=True)
        known = np.zeros(len(grams))
        known[_asked(twice.value.bits, grams)] = totals  # as many as were asked for, or the texts have changed: an error
        mine, at, counts = known[to], 0, []
        for e in every:
            counts.append([])
            for g in e:
                counts[-1].append(mine[at : at + len(g)])
                at += len(g)
        n = np.array([len(e[0]) for e in every])
        s = block_scores(counts, words).round(9)
        scored = pa.table({"doc_id": b["doc_id"], "n_words": pa.array(n, pa.int64()), "score": pa.array(s), "mean_score": pa.array((s / np.maximum(n, 1)).round(9))})
        return pa.concat_tables([scored] * len(held))

    exploded = source.mapInArrow(explode, "part long, block long, digest long, grams binary, counts binary")
    # As many partitions as parts, so that what a task reads doesn't grow with the input.
    totals = exploded.repartition(parts, "part").groupBy("part").applyInArrow(total, "block long, digest long, part long, counts binary")
    met = totals.unionByName(source.mapInArrow(keep, "block long, digest long, docs binary"), allowMissingColumns=True)
    return met.repartition(parts, "block").groupBy("block", "digest").applyInArrow(score, "doc_id long, n_words long, score double, mean_score double")
