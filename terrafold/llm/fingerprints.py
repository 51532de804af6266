"""Document fingerprints: a homomorphic multiset hash of paragraphs, with DataFrame functions only.

A paragraph is what stands between line feeds; blank ones count, an empty text has none. Its vector has two parts.
Eight exact lanes are hashes of the paragraph under four seeds. 64 wide lanes hold a sketch of its inside: each pair of
neighbouring words adds 1 or -1 to one lane. A text's fingerprint is the sum of its paragraphs' vectors, the exact lanes
modulo 2^32 and the wide lanes modulo 2^16. So the order of paragraphs doesn't matter, texts with the same paragraphs
have equal fingerprints, and paragraphs are inserted and deleted by adding and subtracting vectors. The likeness of two
fingerprints is twice the inner product of their wide lanes over the sum of their squares, between 0 and 1; it
estimates the share of common word pairs.

The next document in descending order of ids comes from a window over ranges of the rows' order. Ranges begin at
quantiles of a bounded sample of the rows, so ids may lie anywhere and one id, or none, may stand in many rows. A range
begins with a row of the sample, which is thus known before; it is the next one of the last row before the range.
Texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.llm.common import texts

#: Lanes; documents of a range, ranges at most (a power of 4), rows of the sample for each range.
EXACT, WIDE, RANGE, RANGES, SAMPLE = 8, 64, 96, 1 << 14, 16
_EXACT_POWER, _WIDE_POWER = 1 << 32, 1 << 16
_KEY = "struct<f: boolean, nd: bigint, h: bigint, s: bigint>"


def _place() -> Column:
    """Where a row stands in the order: by descending doc_id, nulls last, then by a hash of the text; s tells equal rows apart."""
    return F.struct(F.col("doc_id").isNull().alias("f"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("nd"), F.xxhash64("text").alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("s"))


def range_starts(source: DataFrame) -> list[tuple]:
    """The places where ranges begin, in order, the first row's first; none of an empty table."""
    n = source.select("doc_id").count()
    if not n:
        return []
    ranges = max(1, min(RANGES, n // RANGE))
    placed = source.select(_place().alias("p"))
    share = min(1.0, ranges * SAMPLE / n)
    few = placed.filter(F.shiftrightunsigned(F.xxhash64("p.s"), 11) < int(share * (1 << 53)))
    least = placed.agg(F.min(F.struct("p.f", "p.nd", "p.h")).alias("p")).first().p
    found = sorted(tuple(r) for r in few.select("p.*").collect())  # RANGES * SAMPLE rows or about so many
    first = (least.f, least.nd, least.h, -(1 << 63))
    starts = sorted({first, *found[:: max(1, len(found) // ranges)]})
    # Only equal rows that more than one range holds are told apart.
    seen, out = {}, []
    for x in starts:
        seen[x[:3]] = seen.get(x[:3], -1) + 1
        out.append((*x[:3], x[3] if seen[x[:3]] else -(1 << 63)))
    return out


def next_texts(docs: DataFrame) -> DataFrame:
    """r, k, doc_id, text, next, last for all rows.

    next is the text of the next row by descending doc_id (nulls last, then by a hash of the text); after the last comes
    the first. r and k identify a row: its range, its place there; last tells the last ones of ranges.
    """
    source = texts(docs)
    starts = range_starts(source)
    step = 1
    while step * step < len(starts):
        step *= 2
    # One row that all tasks get: starts of ranges, and of every step-th one.
    groups = [starts[i : i + step] for i in range(0, len(starts), step)]
    known = source.sparkSession.createDataFrame([([g[0] for g in groups], groups)], f"coarse array<{_KEY}>, fine array<array<{_KEY}>>")
    upto = lambda places: F.size(F.filter(places, lambda x: x <= F.col("p")))
    placed = source.withColumn("p", _place()).join(F.broadcast(known)).withColumn("g", F.greatest(upto("coarse"), F.lit(1)))
    ranged = placed.withColumn("r", (F.col("g") - 1) * step + F.greatest(upto(F.element_at("fine", F.col("g"))), F.lit(1)) - 1).select("r", "p", "doc_id", "text")
    # The first row of each range, for the range before.
    before = [((i - 1) % len(starts), *x[1:3], x[0]) for i, x in enumerate(starts)]
    heads = F.broadcast(source.sparkSession.createDataFrame(before, "r int, nd bigint, h bigint, f boolean"))
    heads = placed.select("p.f", "p.nd", "p.h", "text").join(heads, ["f", "nd", "h"]).groupBy("r").agg(F.first("text").alias("head"))
    order = W.partitionBy("r").orderBy(F.desc_nulls_last("doc_id"), "p.h", "p.s")
    within = ranged.select("r", "doc_id", "text", F.row_number().over(order).alias("k"), F.lead("text").over(order).alias("next"))
    return within.join(heads, "r", "left").select("r", "k", "doc_id", "text", F.coalesce("next", "head").alias("next"), F.col("next").isNull().alias("last"))


def _pairs(words: Column) -> Column:
    """Hashes of the pairs of neighbouring words; of the only word if there is one."""
    n = F.size(words) - 1
    return F.when(n > 0, F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))).otherwise(F.transform(words, lambda a: F.xxhash64(a)))


def vectors(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, exact (8 longs), packed (32 longs of two wide lanes each): sums over the paragraphs of each row; keys identify rows.

    Rows that are dealt by one of the keys aren't shuffled again.
    """
    words = df.select(*keys, F.col(text) != "", F.explode(F.split(text, "\n"))).toDF(*keys, "some", "p").withColumn("words", F.split("p", " "))
    exact = [f"e{j}" for j in range(EXACT // 2)]
    hashed = words.select(*keys, *(F.when(F.col("some"), F.xxhash64(F.lit(j), "p")).alias(e) for j, e in enumerate(exact)), F.when(F.col("p") != "", _pairs(F.col("words"))).alias("h"))
    units = hashed.select(*keys, *exact, F.posexplode_outer("h").alias("i", "h"))
    half = lambda j: F.col(exact[j // 2]).bitwiseAND(F.lit(_EXACT_POWER - 1)) if j % 2 == 0 else F.shiftrightunsigned(exact[j // 2], 32)
    step = F.when(F.col("h").bitwiseAND(F.lit(1 << 20)) == 0, F.lit(1)).otherwise(F.lit(-1)) * F.when(F.col("h").bitwiseAND(F.lit(1 << 21)) == 0, F.lit(1)).otherwise(F.lit(1 << 32))
    laid = units.withColumn("lane", F.col("h").bitwiseAND(F.lit(WIDE // 2 - 1))).withColumn("step", step)
    sums = [F.sum(F.when(F.coalesce("i", F.lit(0)) == 0, half(j))).alias(f"x{j}") for j in range(EXACT)] + [F.sum(F.when(F.col("lane") == j, F.col("step"))).alias(f"w{j}") for j in range(WIDE // 2)]
    total = laid.groupBy(*keys).agg(*sums)
    return total.select(*keys, F.array(*(F.pmod(F.coalesce(f"x{j}", F.lit(0)), F.lit(_EXACT_POWER)) for j in range(EXACT))).alias("exact"), F.array(*(F.coalesce(f"w{j}", F.lit(0)) for j in range(WIDE // 2))).alias("packed"))


def unpack(packed: Column) -> Column:
    """64 lanes, each modulo 2^16 and signed, of 32 longs that hold two each."""
    signed = lambda x, bits: F.shiftright(F.shiftleft(x, 64 - bits), 64 - bits)
    return F.concat(F.transform(packed, lambda x: signed(x, 16)), F.transform(packed, lambda x: signed(F.shiftright(x - signed(x, 32), 32), 16)))


def insert(a: Column, b: Column, power: int = _EXACT_POWER) -> Column:
    """Lanes of the two multisets together."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(power)))


def delete(a: Column, b: Column, power: int = _EXACT_POWER) -> Column:
    """Lanes of a without b, which is part of it."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(power)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """Of wide lanes; two without any word are alike."""
    squares = _dot(a, a) + _dot(b, b)
    return F.when(squares == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * _dot(a, b) / F.greatest(squares, F.lit(1)))))


def as_text(exact: Column, wide: Column) -> Column:
    digits = lambda x, n: F.lower(F.lpad(F.hex(x), n, "0"))
    return F.concat(F.array_join(F.transform(exact, lambda x: digits(x, 8)), ""), F.lit(":"), F.array_join(F.transform(wide, lambda x: digits(F.pmod(x, F.lit(_WIDE_POWER)), 4)), ""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    Null texts are empty: a fingerprint of zeros. Rows with one doc_id follow each other by a hash of their texts; null
    doc_ids come last. A single row's next is itself. An empty table gives an empty one; extra columns are ignored.
    """
    keys, of = ["r", "k", "doc_id", "n_chars", "sha", "last"], ["text", "edited", "after"]
    n = F.char_length("text").cast("long")
    cut_at = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - cut_at).cast("int")), F.substring(F.col("next"), F.lit(1), cut_at))
    known = next_texts(docs).select("r", "k", "doc_id", "last", n.alias("n_chars"), edited.alias("edited"), "text", F.when(F.col("last"), F.col("next")).alias("after")).withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
    each = known.select(*keys, F.posexplode(F.array(*of)).alias("which", "t")).filter("t is not null")
    put = [F.first(F.when(F.col("which") == i, F.col(c)), ignorenulls=True).alias(f"{c}{i}") for i in range(3) for c in ("exact", "packed")]
    found = vectors(each, [*keys, "which"], "t").groupBy(*keys).agg(*put)
    # The next row's vector stands in the window, but for the last row of a range, which brought the text along.
    found = found.withColumn("packed2", F.coalesce("packed2", F.lead("packed0").over(W.partitionBy("r").orderBy("k"))))
    w = found.select(*keys, "exact0", "exact1", *(unpack(F.col(f"packed{i}")).alias(f"wide{i}") for i in range(3)))
    return w.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), as_text(F.col("exact0"), F.col("wide0")).alias("fingerprint"), as_text(F.col("exact1"), F.col("wide1")).alias("edited_fingerprint"),
        likeness(F.col("wide0"), F.col("wide1")).alias("near_edited"), likeness(F.col("wide0"), F.col("wide2")).alias("near_next"),
    )
