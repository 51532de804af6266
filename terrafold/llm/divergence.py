"""Divergence audit of sources: how far each source's terms lie from the other sources' and from its language's.

Tasks count the terms of their rows in bounded tables, per language and source, together with the rows that hold a
term; Spark sums both. A language keeps the terms of at least ``least`` rows. Its kept terms are dealt by hash into
blocks and its sources into blocks, and a block of terms meets two blocks of sources as a dense numpy int64 matrix of
groups by terms. Each group's row is broadcast against all others at once; what comes out is a partial matrix of pairs,
which Spark sums, and for each group a heap of its largest terms, which Spark merges in two steps.

Nothing is gathered by language or source: a task holds one tile of ``TERMS`` terms and two blocks of about ``SOURCES``
sources, whatever the input's size. All arithmetic is exact in 64 bits while a language has fewer than 9e15 terms.

Null text, lang and source are ''. Repeated rows are rows of their own, whatever their ids (null or equal). A language
without kept terms has zeros for its pairs; an empty table gives an empty result. Extra columns are ignored.
"""

import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import slices, written

#: Terms of a tile, and sources of a block of sources on average.
TERMS, SOURCES = 4096, 128
#: Entries and bytes of text that a task's table takes up before it is sent on.
ENTRIES, BYTES = 200_000, 64_000_000
SCALE = 1_000_000_000

#: Bytes that aren't part of terms become spaces, A-Z small letters.
_FOLD = bytes(b if b >= 0x80 or chr(b) in string.ascii_lowercase else b + 32 if chr(b) in string.ascii_uppercase else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences, d rows that hold it: partial sums of each task."""

    def rows(tables) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for (lang, source), (n, d) in tables.items():
            for c, values in zip(cols, ([lang] * len(n), [source] * len(n), n.keys(), n.values(), map(d.__getitem__, n)), strict=True):
                c.extend(values)
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*made[:2], made[2].cast(pa.string()), *made[3:]], ["lang", "source", "term", "n", "d"])

    def count(batches):
        tables: dict = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for b in slices(batches):
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                found = terms_of(text)
                n, d = tables[lang, source]
                n.update(found)
                d.update(set(found))
                size += len(text)
            if size > BYTES or sum(len(n) for n, _ in tables.values()) > ENTRIES:
                yield rows(tables)
                tables.clear()
                size = 0
        yield rows(tables)

    found = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return found.mapInArrow(count, "lang string, source string, term string, n long, d long")


def scaled(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), by long division in three steps of a thousand each."""
    out, rest = np.zeros_like(count), count + 1
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + step
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _tile(top: int):
    """Partial sums of pairs between two blocks of sources, and heaps of the first block's sources if both are one."""

    def run(key: tuple[pa.Scalar, ...], terms: pa.Table, blocks: pa.Table) -> pa.Table:
        lang, _, i, j = (k.as_py() for k in key)
        out: list[tuple] = []
        if blocks.num_rows:
            sources = [s for x in blocks["sources"].to_pylist() for s in x]
            side = np.repeat(blocks["block"].to_numpy(), [len(x) for x in blocks["sources"].to_pylist()])
            n = np.array([x for y in blocks["sizes"].to_pylist() for x in y], np.int64)
            kept, size = blocks["kept"][0].as_py(), blocks["size"][0].as_py()
            names = terms["term"].to_pylist()
            order = sorted(range(len(names)), key=names.__getitem__)
            names, totals = [names[k] for k in order], terms["total"].to_numpy()[order]
            place = {s: k for k, s in enumerate(sources)}
            counts = np.zeros((len(sources), len(names)), np.int64)
            held, at = terms["held"].combine_chunks(), np.empty(len(names), np.int64)
            at[order] = np.arange(len(names))
            flat = held.flatten()
            of = np.array([place[s] for s in flat.field("source").to_pylist()], np.int64)
            counts[of, np.repeat(at, np.diff(held.offsets.to_numpy()))] = flat.field("n").to_numpy(zero_copy_only=False)
            p = scaled(counts, (n + kept)[:, None]) if names else counts
            for a, source in enumerate(sources):
                others = np.flatnonzero(side == (j if side[a] == i else i))
                sums = apart(p[a], p[others]).sum(axis=1)
                out += [(lang, source, "pair", sources[b], v) for b, v in zip(others.tolist(), sums.tolist(), strict=True) if b != a]
            if i == j and names:
                q = scaled(totals, size + kept)
                for a, source in enumerate(sources):
                    over = np.flatnonzero((counts[a] > 0) & (p[a] > q))
                    value = apart(p[a][over], q[over])
                    out += [(lang, source, "term", names[over[k]], int(value[k])) for k in np.argsort(-value, kind="stable")[:top]]
        cols = list(zip(*out)) or [()] * 5
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("lang", "source", "part", "item", "value"), cols, (pa.string(),) * 4 + (pa.int64(),), strict=True)})

    return run


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank: see the module's text.

    Part pair has each other source of the language; part term has the ``top`` terms that the source uses more than its
    language does. Values are floor((p - q)^2 / q) of shares p and q in billionths with one added to each count, summed
    over all kept terms for pairs; ties go by item.
    """
    summed = _counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by_term = summed.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("held"))
    kept = written(by_term.filter(F.col("d") >= least).drop("d"))

    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    used = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.n").alias("n"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_sources")).join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("size")), "lang", "left")
    langs = written(
        langs.fillna(0, ["kept", "size"])
        .withColumn("tiles", F.greatest(F.lit(1), F.ceil(F.col("kept") / terms)).cast("int"))
        .withColumn("blocks", F.ceil(F.col("n_sources") / sources).cast("int"))
    )
    source_block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    blocks = groups.join(used, ["lang", "source"], "left").fillna(0, ["n"]).join(langs, "lang").withColumn("block", source_block)
    blocks = blocks.groupBy("lang", "block", "kept", "size", "tiles", "blocks").agg(F.collect_list(F.struct("source", "n")).alias("s"))

    # A tile of terms meets every two blocks of sources i <= j once.
    def pairs(df: DataFrame, at: str) -> DataFrame:
        """Rows of a block go to all pairs that it is in, rows of terms to all pairs."""
        every = F.expr("sequence(0, blocks - 1)")
        if at == "block":
            return df.withColumn("other", F.explode(every)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        return df.withColumn("i", F.explode(every)).withColumn("j", F.explode(F.expr("sequence(i, blocks - 1)")))

    right = pairs(blocks.withColumn("tile", F.explode(F.expr("sequence(0, tiles - 1)"))), "block").select("lang", "tile", "i", "j", "block", "kept", "size", F.col("s.source").alias("sources"), F.col("s.n").alias("sizes"))
    left = kept.join(langs, "lang").withColumn("tile", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int"))
    held = F.expr("filter(held, h -> blocks = 1 or pmod(xxhash64(h.source), blocks) in (i, j))")
    left = pairs(left, "term").select("lang", "tile", "i", "j", "term", "total", held.alias("held"))
    keys = ("lang", "tile", "i", "j")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(top), "lang string, source string, part string, item string, value long")
    found = written(found)

    order = (F.desc("value"), F.asc("item"))
    whole = Window.partitionBy("lang", "source").orderBy(*order)
    pair = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    heap = found.filter("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(64)))
    heap = heap.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("salt")
    columns = ("lang", "source", "part", "item", "value", "rank")
    term = heap.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(whole)).select(*columns).unionByName(term.select(*columns))
