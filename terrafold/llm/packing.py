"""Best-fit packing of documents into sequences by the sum-of-squares rule.

Each document's ids (and the end id) make one piece, or pieces of exactly ``capacity`` ids with the remainder as
the first piece. Pieces are dealt by hash into groups of about ``GROUP`` pieces, whose number follows the input.
A group holds no ids, only lengths, and packs by itself: N[g] is the number of open sequences with g places
left, and a piece goes where the sum of N[g] squared becomes smallest (into an open sequence, or a new one).

One group's last sequences can't be filled by another group's pieces, so after the first round the sequences that
are not full are dissolved, and their pieces are dealt again into fewer, mixed groups.
"""

import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import cut, slices, texts
from terrafold.llm.tokens import ODD, PRE_TOKEN, encode, library

GROUP = 1_500
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@cache
def ranks(tokenizer: str):
    """The byte-level BPE of a tokenizer file by a faster library: its vocabulary as ranks, its pre-tokens' pattern."""
    import tiktoken

    from_bytes = {c: b for b, c in _byte_letters().items()}
    vocabulary = library(tokenizer).get_vocab(with_added_tokens=False)
    added = {str(x) for x in library(tokenizer).get_added_tokens_decoder().values()}
    merged = {bytes(from_bytes[c] for c in token): i for token, i in vocabulary.items() if token not in added}
    return tiktoken.Encoding(tokenizer, pat_str=PRE_TOKEN.pattern, mergeable_ranks=merged, special_tokens={})


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable letter: itself, or else the next letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def token_ids(tokenizer: str, texts_: list[str]) -> list[np.ndarray]:
    """Ids of whole texts as the tokenizers library gives them without added tokens.

    Texts with special strings or with control characters that libraries treat differently go to that library;
    all others to the same vocabulary and merges in a library that is five times as fast, with equal results.
    """
    quick = ranks(tokenizer)
    odd = [i for i, t in enumerate(texts_) if ODD.search(t)]
    slow = dict(zip(odd, encode(tokenizer, [texts_[i] for i in odd]), strict=True))
    return [np.array(slow[i], "<u4") if i in slow else quick.encode_to_numpy(t, disallowed_special=()) for i, t in enumerate(texts_)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece: where it begins among its document's ids, its length, the checksum of its ids."""
    end = np.array([end_id], "<u4").tobytes()

    def split(batches):
        for b in slices(batches):
            out = []
            for d, found in zip(b.column("doc_id").to_pylist(), token_ids(tokenizer, b.column("text").to_pylist()), strict=True):
                ids = found.astype("<u4").tobytes() + end
                n = len(ids) // 4
                at = [0, *range(n % capacity or min(n, capacity), n, capacity), n] if n > capacity else [0, n]
                out += [(d, k, i, j - i, zlib.crc32(ids[4 * i : 4 * j])) for k, (i, j) in enumerate(zip(at, at[1:]))]
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(split, PIECE)


def sum_of_squares(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, in the order given."""
    open_ = np.zeros(capacity + 1, np.int64)  # N[g] for g places left; full sequences don't count
    stacks: dict[int, list[int]] = defaultdict(list)
    level: list[int] = []
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, s in enumerate(lengths):
        # From gap g to gap g - s: the sum of squares grows by 2 (N[g - s] - N[g]) + 2; an exact fit frees a gap, 1 - 2 N[g].
        gain = open_[: capacity + 1 - s] - open_[s:]
        cost = np.where(open_[s:] > 0, 2 * gain + 2, np.iinfo(np.int64).max)
        if open_[s]:
            cost[0] = 1 - 2 * open_[s]
        best = int(np.argmin(cost))
        new = 2 * open_[capacity - s] + 1 if s < capacity else 0
        if cost[best] <= new and open_[best + s]:
            i = stacks[best + s].pop()
            open_[best + s] -= 1
        else:
            best, i = capacity - s, len(level)
            level.append(0)
        seq[k], off[k] = i, level[i]
        level[i] += s
        if best:
            open_[best] += 1
            stacks[best].append(i)
    return seq, off


def _pack(capacity: int, tag: int):
    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        order = np.lexsort((t["piece"].to_numpy(), t["doc_id"].to_numpy(zero_copy_only=False), -t["length"].to_numpy()))
        t = t.take(order)
        seq, off = sum_of_squares(t["length"].to_pylist(), capacity)
        filled = np.bincount(seq, weights=t["length"].to_numpy(), minlength=1)[seq] == capacity
        at = (tag << 60) + (key[0].as_py() << 32) + seq
        for name, values in (("sequence_id", at), ("offset", off), ("filled", filled)):
            t = t.append_column(name, pa.array(values))
        return t.select(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "filled"])

    return pack


def best_fit_packing(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of every document.

    Null and empty texts have one piece with the end id only. Repeated rows are packed each for itself. An empty
    table gives an empty one. Extra columns are ignored.
    """
    found = cut(token_pieces(docs, tokenizer, capacity, end_id))

    def rounds(df: DataFrame, tag: int, size: int) -> DataFrame:
        n = max(1, -(-df.count() // size))
        dealt = df.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "start", F.lit(tag)), F.lit(n)))
        return dealt.groupBy("g").applyInArrow(_pack(capacity, tag), PIECE + ", sequence_id long, offset long, filled boolean")

    first = cut(rounds(found, 0, group))
    rest = first.filter("not filled").select(*found.columns)
    return first.filter("filled").unionByName(rounds(rest, 1, 2 * group)).drop("filled")
