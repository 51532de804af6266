"""N-gram Jaccard join by vertical partitioning.

A document is its set of word n-grams, each a 64-bit hash; the hashes' order is the global order of n-grams. Equal
sets are one class, and only classes are joined. The join is exact:

1. Two sets that link differ in at most D n-grams, D known from their sizes. The global order is cut into more than
   D fragments, so at least one fragment of both holds the same n-grams. Its content's hash is a signature, and sets
   that share a signature are candidates. The cut depends on a class of sizes; sets near the upper end of theirs
   also give signatures by the next one's cut. Fragments that are empty in both could be the only equal ones: the cut
   allows for some, and sets with more empty ones also give their first n-grams (the prefix filter) as signatures.
2. Candidates with too few equal fragments are dropped. So are those whose fragments' sizes and 16-bit hashes show that
   they differ too much. The others are counted by fragments: candidates with a common neighbourhood form a task for
   each of a few wide fragments, to which each set sends that fragment once, however many pairs it has there; the
   partial overlaps are summed per pair.
3. A signature with many sets is not expanded into pairs. Each set is first compared with the signature's hub, the set
   that meets most others; those that link with it are connected already. What is left goes, with all sets of signatures
   that have that hub, in blocks of bounded size to tasks that compare fragments by sizes and hashes alone; pairs that
   pass are candidates, and counted as in 2.
4. Links give components by alternating large and small stars, with a checkpoint after each round.

Candidate signatures and documents are looked up again in the texts by bitmaps of a bounded size; an equi-join then
settles what the bitmaps let through, so a full bitmap only costs time. Hashes have 64 bits: unequal n-grams or sets
count as equal with a probability of about 2**-64 a pair; that a signature is shared is told by 32 bits of the sets' keys.
"""

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import CACHES, bitmap, cut, in_bitmap, packed, slices, texts, unpacked, written

GROWTH = 1.5
#: Sets that a signature expands into pairs at most; n-grams and sets of a block; wide fragments of a set; n-grams
#: whose signatures make one partition; bytes of a word, about.
SMALL, BLOCK, SETS, WIDE, PART, WORD_BYTES = 100, 1_500_000, 2_000, 4, 1_000_000, 6
#: Classes of sizes whose candidates are told by counts; larger sets have more than 60 million n-grams.
CLASSES = 45

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S, _CLASS = np.uint64(32), np.uint64(63)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> _S)) * _B
    x = (x ^ (x >> _S)) * _B
    return x ^ (x >> _S)


class _Hashes(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()
CACHES.append(_hashes)


def gram_set(text: str, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word n-grams; of all words as one if there are fewer; empty without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    x = np.full(n, k, np.uint64)
    for j in range(k):
        x = mix(x * _A + h[j : j + n])
    return np.unique(x)


@cache
def bounds(limit: int) -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * max(GROWTH, 100 / limit + 0.01))))
    return np.array(out)


@cache
def cuts(size_class: int, limit: int) -> tuple[int, int]:
    """Fragments of a class of sizes, and how many may be empty."""
    low, high = int(bounds(limit)[size_class]), int(bounds(limit)[size_class + 1]) - 1
    differ = 2 * high * (100 - limit) // (100 + limit)
    spare = 0
    while differ:
        n = differ + 1 + spare
        empty = n * math.exp(-low / n)
        if spare >= math.ceil(empty + 3 * math.sqrt(empty)) or spare > differ:
            break
        spare += 1
    return differ + 1 + spare, spare


def signatures(grams: np.ndarray, limit: int) -> np.ndarray:
    """Signatures of a set: any two sets that link have one in common. The last six bits are the class of sizes + 1; 0 for a prefix."""
    n = len(grams)
    if not n:
        return np.empty(0, np.uint64)
    own = int(np.searchsorted(bounds(limit), n, side="right")) - 1
    out, prefix, spread = [], False, mix(grams)
    for c in (own, own + 1) if 100 * n // limit >= bounds(limit)[own + 1] else (own,):
        parts, spare = cuts(c, limit)
        edges = (np.arange(parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        at = np.searchsorted(grams, edges)
        full = np.flatnonzero(np.diff(np.append(at, n)))
        total = np.add.reduceat(spread, at[full])  # modulo 2**64
        out.append(mix(total ^ mix(np.uint64((c + 1) << 40) + full.astype(np.uint64))) & ~_CLASS | np.uint64(c + 1))
        prefix |= parts - len(full) > spare
    if prefix:
        out.append(mix(grams[: n - -(-limit * n // 100) + 1] + _A) & ~_CLASS)
    return np.unique(np.concatenate(out))


def key_of(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _long(x) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sets(b: pa.RecordBatch, k: int):
    return [gram_set(t, k) for t in b.column("text").to_pylist()]


def jaccard_links(docs: DataFrame, words: int = 5, limit: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of documents (doc_id, n, key; key null without words), classes (key, rep: smallest doc_id, n), links (ka, kb).

    The links connect the same documents as all pairs of sets with 100 * overlap >= limit * union do, with no more
    than a forest's worth of links inside a group of many alike.
    """
    source = texts(docs)

    def distinct(sets: list[np.ndarray], keys: list[int | None]):
        """Keys, sizes and signatures of a slice's sets (copies once), and the row of each signature."""
        s = list({k: x for k, x in zip(keys, sets) if len(x)}.items())
        g = [signatures(x, limit) for _, x in s]
        sig = np.concatenate(g) if g else np.empty(0, np.uint64)
        return np.array([k for k, _ in s], np.int64), np.array([len(x) for _, x in s], np.int32), sig, np.repeat(np.arange(len(s)), [len(x) for x in g])

    def keys_of(sets: list[np.ndarray]) -> list[int | None]:
        return [key_of(x) if len(x) else None for x in sets]

    # The size of all texts tells about how many n-grams there are; how many parts they make changes no result.
    parts = max(1, -(-(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (WORD_BYTES * PART)))
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)

    def ends(sig: np.ndarray, tag: np.ndarray):
        """The smallest and the largest tag of each signature, as two rows where they differ."""
        order = np.lexsort((tag, sig))
        sig, tag = sig[order], tag[order]
        change = np.append(True, sig[1:] != sig[:-1])[: len(sig)]
        last = np.append(change[1:], True)[: len(sig)]
        keep = change | (last & (tag != tag[change][np.cumsum(change) - 1]))
        return sig[keep], tag[keep]

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("part", pa.int64()), ("sigs", pa.binary()), ("tags", pa.binary())])

    def pack(batches):
        """A row for each document (part is null), and rows of the parts of a slice's signatures."""
        for b in slices(batches):
            sets = _sets(b, words)
            keys = keys_of(sets)
            own = {"doc_id": b.column("doc_id"), "n": pa.array([len(x) for x in sets], pa.int64()), "key": pa.array(keys, pa.int64())}
            yield pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(len(sets), f.type)) for f in schema], schema=schema)
            key, _, sig, row = distinct(sets, keys)
            sig, tag = ends(sig, key.astype(np.uint32)[row])
            at = [0, *np.searchsorted(sig, edges), len(sig)]
            rows = [(p, packed(np.diff(sig[x:y], prepend=np.uint64(0))), tag[x:y].tobytes()) for p, (x, y) in enumerate(zip(at, at[1:])) if x < y]
            cols = dict(zip(("part", "sigs", "tags"), zip(*rows)))
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(len(rows), f.type) for f in schema], schema=schema)

    def meet(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        sig = np.concatenate([np.cumsum(unpacked(x), dtype=np.uint64) for x in t["sigs"].to_pylist()])
        sig, _ = ends(sig, np.frombuffer(b"".join(t["tags"].to_pylist()), np.uint32))
        return pa.table({"sig": _long(np.unique(sig[1:][sig[1:] == sig[:-1]]))})

    # Signatures of one partition of their range stand in columns: a slice sends two rows of a signature at most.
    read = written(source.mapInArrow(pack, "doc_id long, n long, key long, part long, sigs binary, tags binary"))
    ids = read.filter("part is null").select("doc_id", "n", "key")
    classes = written(ids.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")))
    shared = cut(read.filter("part is not null").select("part", "sigs", "tags").groupBy("part").applyInArrow(meet, "sig long"))
    held = bitmap(shared, "sig")

    def sign(batches):
        for b in slices(batches):
            sets = _sets(b, words)
            key, n, sig, row = distinct(sets, keys_of(sets))
            of = row * 64 + (sig & _CLASS).astype(np.int64)
            full = np.bincount(of, minlength=1)[of].astype(np.int32)  # fragments with n-grams in this row and class
            keep = in_bitmap(held.value, sig)
            row, sig, full = row[keep], sig[keep], full[keep]
            yield pa.RecordBatch.from_arrays([_long(sig), pa.array(key[row]), pa.array(n[row]), pa.array(full)], ["sig", "key", "n", "full"])

    # A signature may be in a large share of all sets: both sides of this join are dealt anew, so Spark can split one.
    members = cut(source.mapInArrow(sign, "sig long, key long, n int, full int").join(shared, "sig").dropDuplicates(["sig", "key"]))
    frequent = cut(members.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > SMALL))
    small, large = _divided(members, frequent)
    candidates = cut(_candidates(small, limit))
    keys = candidates.select(F.col("ka").alias("key")).unionByName(candidates.select(F.col("kb").alias("key")))
    sets_of = lambda keys: _from_texts(source, classes, keys, words, lambda s: fragments(s, WIDE), "key long, f int, grams binary")
    sketches_of = lambda keys: _from_texts(source, classes, keys, words, lambda s: sketch(s, limit), "key long, c int, n long, equal binary, sizes binary")
    if frequent.isEmpty():
        links = _verified(_hopeful(candidates, sketches_of(keys.distinct()), limit), sets_of, limit)
    else:
        large = cut(_with_hubs(large))
        sketches = cut(sketches_of(keys.unionByName(large.select("key")).distinct()))
        links = cut(_verified(_hopeful(candidates.unionByName(_stars(large, limit)).distinct(), sketches, limit), sets_of, limit))
        links = links.unionByName(_verified(_large_groups(large, links, sketches, limit).distinct(), sets_of, limit))
    return ids, classes, cut(links.distinct())


def _divided(members: DataFrame, frequent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members whose signature isn't in frequent, and those whose is. A bitmap lets most of the former stay where they are."""
    held = bitmap(frequent, "sig")

    def part(inside: bool):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(in_bitmap(held.value, b.column("sig").to_numpy(zero_copy_only=False)) == inside))

        return members.mapInArrow(run, members.schema)

    return part(False).unionByName(part(True).join(frequent, "sig", "left_anti")), part(True).join(frequent, "sig")


def _with_hubs(large: DataFrame) -> DataFrame:
    """sig, key, n of large groups with the hub (key, n) of each signature: of its sets the one that meets most others there.

    Such a set is in the midst of near copies, so most of those that link at all link with it.
    """
    met = large.groupBy("key", "n").agg(F.sum("c").alias("met"), F.collect_list("sig").alias("sigs"))  # a set's own signatures
    ranked = cut(met.select("key", "n", "met", F.explode("sigs").alias("sig")))
    hubs = cut(ranked.groupBy("sig").agg(F.max_by(F.struct("key", "n"), F.struct("met", "key")).alias("hub")))
    return ranked.drop("met").join(hubs, "sig")


def _pairs_of(df: DataFrame) -> DataFrame:
    return df.select("ka", F.col("na").cast("long").alias("na"), "kb", F.col("nb").cast("long").alias("nb"))


def _stars(large: DataFrame, limit: int) -> DataFrame:
    """Pairs of each set of a large group and the group's hub, if their sizes allow a link."""
    star = large.filter("key != hub.key").select(F.col("hub.key").alias("ka"), F.col("hub.n").alias("na"), F.col("key").alias("kb"), F.col("n").alias("nb"))
    return _pairs_of(star.filter(f"100 * least(na, nb) >= {limit} * greatest(na, nb)").distinct())


def _class_of(limit: int, n: Column) -> Column:
    """The class of a size, plus one."""
    return F.size(F.filter(F.array(*(F.lit(int(e)) for e in bounds(limit)[:CLASSES])), lambda e: e <= n))


def _candidates(small: DataFrame, limit: int) -> DataFrame:
    """Pairs (ka, na, kb, nb) of small groups that may link; those that share a large group are compared there as well.

    Two sets that link have at least (fragments - D) equal fragments in the cut of the larger one's class, D by their
    own sizes: signatures that they share, and at most as many more as are empty in both. Prefixes (class 0) tell nothing.
    """
    one = F.struct("key", "n", "full")
    lists = small.groupBy("sig").agg(F.array_sort(F.collect_list(one)).alias("m")).filter(F.size("m") > 1)  # SMALL sets at most
    pair = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter("m", lambda y, j: j > i), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = lists.select(F.col("sig").bitwiseAND(F.lit(63)).cast("int").alias("c"), F.explode(pair).alias("p")).filter(f"100 * least(p.x.n, p.y.n) >= {limit} * greatest(p.x.n, p.y.n)")
    pairs = pairs.select("c", F.col("p.x.key").alias("ka"), F.col("p.x.n").alias("na"), F.col("p.y.key").alias("kb"), F.col("p.y.n").alias("nb"), F.col("p.x.full").alias("fa"), F.col("p.y.full").alias("fb"))
    pairs = pairs.filter((F.col("c") == 0) | (F.col("c") > CLASSES) | (F.col("c") == _class_of(limit, F.greatest("na", "nb"))))
    shared = pairs.groupBy("c", "ka", "na", "kb", "nb", "fa", "fb").agg(F.count(F.lit(1)).alias("shared"))
    parts = F.element_at(F.array(*(F.lit(cuts(k, limit)[0]) for k in range(CLASSES))), F.least(F.greatest("c", F.lit(1)), F.lit(CLASSES)))
    enough = F.col("shared") + F.least(parts - F.col("fa"), parts - F.col("fb")) >= parts - F.expr(f"(na + nb) * {100 - limit} div {100 + limit}")
    return _pairs_of(shared.filter((F.col("c") == 0) | (F.col("c") > CLASSES) | enough))


def fragments(s: np.ndarray, wide: int) -> list[tuple]:
    """Number and n-grams of the wide fragments of a set, those that aren't empty."""
    at = [*np.searchsorted(s, (np.arange(wide) * (2.0**64 / wide)).astype(np.uint64)), len(s)]
    return [(f, s[x:y].tobytes()) for f, (x, y) in enumerate(zip(at, at[1:])) if x < y]


def sketch(s: np.ndarray, limit: int) -> list[tuple]:
    """For each class that a set is compared in: class, size, and of each fragment 16 bits of its content's hash and its size (255 at most)."""
    n, out, spread = len(s), [], mix(s)
    own = int(np.searchsorted(bounds(limit), n, side="right")) - 1
    for c in (own, own + 1) if 100 * n // limit >= bounds(limit)[own + 1] else (own,):
        parts = cuts(c, limit)[0]
        at = np.append(np.searchsorted(s, (np.arange(parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)), n)
        sums = np.append(np.uint64(0), np.cumsum(spread, dtype=np.uint64))
        content = mix(sums[at[1:]] - sums[at[:-1]])  # modulo 2**64
        out.append((c, n, (content >> np.uint64(48)).astype(np.uint16).tobytes(), np.minimum(np.diff(at), 255).astype(np.uint8).tobytes()))
    return out


def differ_at_least(equal: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """How many n-grams set i and the others differ in at least, by their sketches (a row each).

    Fragments of unequal content differ in one n-gram at least, in as many as their sizes do, and in two if the sizes are equal.
    """
    x = sizes[others].astype(np.int16)
    apart = np.abs(x - sizes[i].astype(np.int16))
    apart[(apart == 0) & (x < 255)] = 2
    np.maximum(apart, 1, out=apart)
    return np.where(equal[others] != equal[i], apart, 0).sum(1, dtype=np.int64)


def _from_texts(source: DataFrame, classes: DataFrame, keys: DataFrame, words: int, rows_of, schema: str) -> DataFrame:
    """key and rows_of(set) for the sets with these keys. A bitmap tells which texts to read; other texts of the same ids come along."""
    wanted = bitmap(keys.join(classes, "key").select(F.xxhash64("rep").alias("h")), "h")
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in slices(batches):
            found = {}
            for i in np.flatnonzero(in_bitmap(wanted.value, b.column("h").to_numpy(zero_copy_only=False))):
                s = gram_set(b.column("text")[int(i)].as_py(), words)
                if len(s):
                    found[key_of(s)] = s
            cols = list(zip(*((k, *r) for k, s in found.items() for r in rows_of(s)))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return source.withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, schema)


def _dealt(pairs: DataFrame) -> DataFrame:
    """task, key, own (size), with (key, n of its partners there): pairs with a common neighbourhood are in one task.

    So a set is sent once for all its pairs there. Neighbourhoods of more than BLOCK n-grams are cut into pairs of blocks.
    """
    pairs = cut(pairs)
    both = pairs.select(F.col("ka").alias("key"), F.col("kb").alias("other")).unionByName(pairs.select(F.col("kb").alias("key"), F.col("ka").alias("other")))
    least = cut(both.groupBy("key").agg(F.min(F.least("key", "other")).alias("least")))
    placed = pairs.join(least.select(F.col("key").alias("ka"), F.col("least").alias("la")), "ka").join(least.select(F.col("key").alias("kb"), F.col("least").alias("lb")), "kb")
    placed = cut(placed.withColumn("near", F.least("la", "lb")).drop("la", "lb"))
    sized = placed.select("near", F.col("ka").alias("key"), F.col("na").alias("n")).unionByName(placed.select("near", "kb", "nb").toDF("near", "key", "n")).distinct()
    sized = sized.groupBy("near").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    block = lambda k: F.pmod(F.xxhash64(k), F.col("blocks"))
    placed = placed.join(sized, "near").withColumn("task", F.xxhash64("near", F.least(block("ka"), block("kb")), F.greatest(block("ka"), block("kb"))))
    one = F.struct(F.col("ka").alias("key"), F.col("na").alias("n"))
    dealt = placed.select("task", F.col("kb").alias("key"), F.col("nb").alias("own"), one.alias("with")).unionByName(placed.select("task", F.col("ka").alias("key"), F.col("na").alias("own"), F.lit(None).cast("struct<key: bigint, n: bigint>").alias("with")))
    return cut(dealt.groupBy("task", "key", "own").agg(F.collect_set("with").alias("with")))


def _hopeful(pairs: DataFrame, sketches: DataFrame, limit: int) -> DataFrame:
    """The pairs that may link by their sketches."""
    sent = _dealt(pairs).join(sketches.drop("n"), "key").select("task", "key", "own", "c", "equal", "sizes", F.col("with.key").alias("others"))

    def prune(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        keys, own, classes_, out = t["key"].to_pylist(), t["own"].to_pylist(), t["c"].to_pylist(), set()
        edges = bounds(limit)
        at = {(k, c): i for i, (k, c) in enumerate(zip(keys, classes_))}
        content = [np.frombuffer(x, np.uint16) for x in t["equal"].to_pylist()]
        sizes = [np.frombuffer(x, np.uint8) for x in t["sizes"].to_pylist()]
        size = dict(zip(keys, own))
        for (k, c), i in at.items():
            for o in t["others"][i].as_py():
                j = at.get((o, c))
                if j is not None and int(np.searchsorted(edges, max(size[k], size[o]), side="right")) - 1 == c:
                    least = differ_at_least(np.stack([content[i], content[j]]), np.stack([sizes[i], sizes[j]]), 0, np.array([1]))[0]
                    if least <= (size[k] + size[o]) * (100 - limit) // (100 + limit):
                        out.add((o, size[o], k, size[k]))
        cols = list(zip(*sorted(out))) or [()] * 4
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("ka", "na", "kb", "nb"), cols)})

    return sent.groupBy("task").applyInArrow(prune, "ka long, na long, kb long, nb long")


def _verified(pairs: DataFrame, sets_of, limit: int) -> DataFrame:
    """The pairs (ka, kb) of candidates that link. Each wide fragment of the global order has tasks of its own; the
    partial overlaps are summed per pair."""
    dealt = _dealt(pairs)
    sent = dealt.join(sets_of(dealt.select("key").distinct()), "key").select("task", "f", "key", "own", F.col("with.key").alias("others"), F.col("with.n").alias("sizes"), "grams")

    def partial(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        keys = t["key"].to_pylist()
        first = {k: i for i, k in reversed(list(enumerate(keys)))}
        grams = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()]
        out = []
        for k, i in first.items():
            own, others, sizes = t["own"][i].as_py(), t["others"][i].as_py(), t["sizes"][i].as_py()
            for o, n in zip(others, sizes):
                if o in first and (m := _overlap(grams[i], grams[first[o]])):
                    out.append((o, n, k, own, m))
        cols = list(zip(*out)) or [()] * 5
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("ka", "na", "kb", "nb", "n"), cols)})

    counted = sent.groupBy("task", "f").applyInArrow(partial, "ka long, na long, kb long, nb long, n long")
    counted = counted.groupBy("ka", "na", "kb", "nb").agg(F.sum("n").alias("n"))
    return counted.filter(f"100 * n >= {limit} * (na + nb - n)").select("ka", "kb")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many n-grams two sorted fragments share."""
    both = np.sort(np.concatenate([a, b]))
    return int((both[1:] == both[:-1]).sum())


def _large_groups(large: DataFrame, links: DataFrame, sketches: DataFrame, limit: int) -> DataFrame:
    """Pairs (ka, na, kb, nb) of sets of large groups that may link and that links don't connect yet.

    Signatures with one hub are one group, in which a set stands once. Sets that are connected with the hub already
    (ring 0) aren't compared with each other; the rest (ring 1) meets all, in blocks of bounded size. A block holds
    the sets' signatures, not their n-grams.
    """
    found = components(links.select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    of = lambda k, c: found.select(F.col("node").alias(k), F.col("component").alias(c))
    at = large.select(F.col("hub.key").alias("hk"), "key", "n").distinct().join(of("key", "own"), "key", "left").join(of("hk", "hubs"), "hk", "left")
    at = at.withColumns({"own": F.coalesce("own", "key"), "hubs": F.coalesce("hubs", "hk")})
    at = cut(at.select("hk", "key", "n", "own", (F.col("own") != F.col("hubs")).cast("int").alias("ring")))
    whole = at.groupBy("hk").agg(F.sum("ring").alias("rest"), ((F.sum("n") <= BLOCK) & (F.count(F.lit(1)) <= SETS)).alias("one")).filter("rest > 0")
    at = cut(at.join(whole, "hk").withColumn("ring", F.when(F.col("one"), 1).otherwise(F.col("ring"))))  # a group that fits one block is one
    blocks = cut(at.groupBy("hk", "ring").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count(F.lit(1)) / SETS)).alias("blocks")))
    other = blocks.select("hk", F.col("ring").alias("ring2"), F.col("blocks").alias("blocks2"))
    at = at.join(blocks, ["hk", "ring"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    met = at.join(other, "hk").filter("ring = 1 or ring2 = 1")
    met = met.withColumn("block2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
    me, it = F.struct(F.col("ring").cast("long"), F.col("block").cast("long")), F.struct(F.col("ring2").cast("long"), F.col("block2").cast("long"))
    task = F.xxhash64("hk", F.least(me, it), F.greatest(me, it))
    dealt = cut(met.select(task.alias("task"), "key", "own").distinct())
    sent = dealt.join(sketches, "key").select("task", "key", "own", "n", "c", "equal", "sizes")

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        keys, n = t["key"].to_numpy(), t["n"].to_numpy()
        pairs = may_link(keys, n, t["own"].to_numpy(), t["c"].to_numpy(), t["equal"].to_pylist(), t["sizes"].to_pylist(), limit)
        cols = list(zip(*((int(keys[i]), int(n[i]), int(keys[j]), int(n[j])) for i, j in pairs))) or [()] * 4
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("ka", "na", "kb", "nb"), cols)})

    return sent.groupBy("task").applyInArrow(compare, "ka long, na long, kb long, nb long")


def may_link(keys: np.ndarray, n: np.ndarray, known: np.ndarray, c: np.ndarray, equal: list[bytes], sizes: list[bytes], limit: int) -> list[tuple[int, int]]:
    """Rows of pairs of sets of different known components that may link by their sketches: sets' keys, sizes, components, and the sketch of a class in each row."""
    label, members = np.unique(known, return_inverse=True, return_counts=True)[1:]
    most, edges, found = int(np.argmax(members)), bounds(limit), []  # the largest component's sets needn't be compared with each other
    for k in np.unique(c).tolist():
        of = np.flatnonzero(c == k)
        of = of[np.unique(keys[of], return_index=True)[1]]  # copies of a row once
        content, size = np.stack([np.frombuffer(equal[i], np.uint16) for i in of]), np.stack([np.frombuffer(sizes[i], np.uint8) for i in of])
        m, own, group = n[of], np.searchsorted(edges, n[of], side="right") - 1, label[of]
        for i in np.flatnonzero(group != most).tolist():
            may = (group != group[i]) & (100 * np.minimum(m, m[i]) >= limit * np.maximum(m, m[i])) & (np.maximum(own, own[i]) == k)
            may[: i + 1] &= group[: i + 1] == most  # each pair once
            near = np.flatnonzero(may)
            near = near[(content[near] != content[i]).sum(1) <= (m[near] + m[i]) * (100 - limit) // (100 + limit)]
            near = near[differ_at_least(content, size, i, near) <= (m[near] + m[i]) * (100 - limit) // (100 + limit)]
            found += [(int(of[i]), int(of[j])) for j in near]
    return found


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b)."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        # Large star: each node's larger neighbours go to its smallest neighbour (or itself).
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = sym.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node and its smaller neighbours go to the smallest of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(edges.distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def jaccard_join(docs: DataFrame, words: int = 5, limit: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) for every row of docs.

    Documents without words, null texts among them, have an empty set and link with nothing. Repeated rows are equal
    sets, rows with one doc_id are one document, rows without one are documents that others may be linked through; their
    component_id is null where nothing they link with has an id. An empty table gives an empty one; extra columns are
    ignored.
    """
    ids, classes, links = jaccard_links(docs, words, limit)
    # Classes are the nodes, so one whose rows have no doc_id connects others too; so do rows of one doc_id.
    several = cut(ids.filter("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a != b"))
    again = ids.filter("key is not null").join(several, "doc_id").filter("key != a").select("a", F.col("key").alias("b")).distinct()
    found = components(links.select(F.col("ka").alias("a"), F.col("kb").alias("b")).unionByName(again))
    of = classes.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    of = cut(of.select("key", "rep", "component"))
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = written(of.join(least, "component").select("key", "component_id"))
    out = ids.join(named, "key", "left")  # copies of one text may be many: both sides are stored, so Spark can split one
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
