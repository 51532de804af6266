"""Token counts by a map-side two-tier lookup, and the ids of whole texts by the same lookup.

A text is cut before every space that a character other than white space follows. Byte-level pre-tokenizers
start a pre-token at such a space whatever stands before it, so each piece is made of whole pre-tokens, and a
text's tokens are its pieces' tokens in turn. No pre-token is ever shuffled:

* tier 1: a broadcast table of frequent pieces and their lengths. Tasks count pieces in a bounded table and send
  their most frequent ones; the sums' largest ``FREQUENT`` go out. The table only sets the speed, never a result.
* tier 2: a cache in each Python worker for all other pieces. The tokenizer library encodes what neither tier
  holds. A full cache is emptied.

Null texts are empty and have no tokens; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import slices, texts

#: Entries of the broadcast table; entries that a task sends towards it; entries of a task's table.
FREQUENT, SENT, COUNTED = 20_000, 1_000, 200_000
#: Entries of a worker's cache, and the longest piece it keeps.
CACHED, LONGEST = 400_000, 48

CUT = re.compile(r" (?=\S)")
UNEVEN = re.compile(r" (?:\s|\Z)")
#: Pre-tokens of byte-level BPE (fixed by the tokenizer), and pieces that go to the library whole: with a special
#: string, or with control characters that not all libraries take for white space.
PRE_TOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ODD = re.compile(r"<\||[\x1c-\x1f]")


def pieces(text: str) -> list[str]:
    """The first piece as it is, the others without their leading space."""
    return CUT.split(text) if UNEVEN.search(text) else text.split(" ")


@cache
def library(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))


def encode(name: str, parts: list[str]) -> list[list[int]]:
    return [x.ids for x in library(name).encode_batch_fast(parts, add_special_tokens=False)]


class Lookup:
    """Both tiers. make(ids) gives what is kept of a pre-token, join what is kept of several.

    Pieces that neither tier holds are cut into pre-tokens, which are far fewer, and only pre-tokens that the worker
    hasn't kept go to the library. What is kept stays; once a tier is full, others are made anew each time.
    """

    def __init__(self, name: str, make, join, first: dict[str, object]):
        self.name, self.make, self.join, self.kept, self.parts = name, make, join, _Tier(first), _Tier()
        self.most = CACHED + len(first)

    def values(self, pieces_: list[str]) -> list:
        search, cut = ODD.search, PRE_TOKEN.findall
        found = [[p] if search(p) else cut(p) for p in pieces_]
        new = list(set().union(*found).difference(self.parts))
        made = dict(zip(new, map(self.make, encode(self.name, new)), strict=True))
        self.parts.add(made, CACHED)
        join, get = self.join, self.parts.__getitem__
        return [join(map(get, f)) for f in found]

    def fill(self, parts: list[list[str]]) -> tuple[dict, list]:
        """Values of all pieces but each text's first, and of the first ones."""
        new = list(set().union(*(x[1:] for x in parts)).difference(self.kept)) if parts else []
        heads = self.values([x[0] for x in parts])
        self.kept.add(dict(zip(new, self.values([" " + x for x in new]), strict=True)), self.most)
        return self.kept, heads


class _Tier(dict):
    """What is kept, up to a bound, and behind it what was made last."""

    made: dict = {}

    def add(self, made: dict, most: int) -> None:
        room = most - len(self)
        if room > 0:
            self.update([(k, v) for k, v in made.items() if len(k) <= LONGEST][:room])
        self.made = made

    def __missing__(self, key):
        return self.made[key]


_LOOKUPS: dict[tuple, Lookup] = {}


def lookup(name: str, kind: str, make, join, first: dict) -> Lookup:
    """The worker's own lookup, that later tasks find filled."""
    key = (name, kind, hash(frozenset(first)))
    if key not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[key] = Lookup(name, make, join, first)
    return _LOOKUPS[key]


def frequent(docs: DataFrame, entries: int = FREQUENT) -> list[str]:
    """Pieces that stand often in all of docs; at most ``entries`` rows reach the driver."""

    def count(batches):
        found: Counter = Counter()
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                found.update(pieces(t)[1:])
            if len(found) > COUNTED:
                found = Counter(dict(found.most_common(COUNTED // 4)))
        top = [(k, n) for k, n in found.most_common(SENT) if len(k) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    found = texts(docs).select("text").mapInArrow(count, "piece string, n long")
    rows = found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(entries).collect()
    return [r.piece for r in rows]


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, entries: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    An empty table gives an empty one. Special strings inside texts count as the library takes them by default.
    """
    spark = docs.sparkSession
    top = frequent(docs, entries)
    sizes = dict(zip(top, map(len, encode(tokenizer, [" " + x for x in top])), strict=True))
    sent = spark.sparkContext.broadcast(sizes)

    def count(batches):
        tiers = lookup(tokenizer, "length", len, sum, sent.value)
        for b in slices(batches):
            parts = [pieces(t) for t in b.column("text").to_pylist()]
            values, heads = tiers.fill(parts)
            get = values.__getitem__
            n = np.array([h + sum(map(get, p[1:])) for h, p in zip(heads, parts, strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.compute.binary_length(b.column("text")).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
