"""Helpers that the text operators share."""

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.session import cut, shared_folder  # noqa: F401

#: Bytes of text that one slice of an Arrow batch holds at most (a single longer text still goes whole).
SLICE_BYTES = 4_000_000
#: Caches that tasks fill; cleared when a task has read its rows.
CACHES: list = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (long) and the text (null: empty); other columns, whatever their names, stay behind."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def written(df: DataFrame, *parts: str) -> DataFrame:
    """df, written to the shared folder (in folders by parts) and read again: lineage ends there, columns are compressed."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def slices(batches, column: str = "text"):
    """Cuts Arrow batches so that each holds a bounded number of bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        at = size = 0
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > SLICE_BYTES:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n or 0
        yield batch.slice(at)
    # Workers live on between tasks; what one operator has cached isn't kept beside the next one's.
    for cache in CACHES:
        cache.clear()
    released()


def released() -> None:
    """Gives memory that isn't used any more back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bitmap(df: DataFrame, column: str, most: int = 1 << 30):
    """A broadcast bitmap of a column of hashes (long): sixteen bits a row, ``most`` bits at most. See in_bitmap().

    Tasks set the bits, each in a part of its own; the driver only lays the parts (128 MB at most) side by side.
    """
    n = df.count()
    bits = min(most, max(1 << 16, 1 << (16 * max(n, 1)).bit_length()))
    size = bits // max(64, bits >> 20)
    place = df.select(F.shiftrightunsigned(column, 6).bitwiseAND(F.lit(bits - 1)).alias("p"))
    words = place.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("b"))

    def part(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        out = np.zeros(size // 32, np.uint32)
        out[t["w"].to_numpy() % (size // 32)] = t["b"].to_numpy().astype(np.uint32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    parts = words.withColumn("part", F.expr(f"w div {size // 32}")).groupBy("part").applyInArrow(part, "part long, bits binary")
    held = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        held[r.part * size // 8 : (r.part + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return df.sparkSession.sparkContext.broadcast(held)


def in_bitmap(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where hashes may be in the bitmap: true for all that are, and for a few others."""
    p = (hashes.view(np.uint64) >> np.uint64(6)).astype(np.int64) & np.int64(len(held) * 8 - 1)
    return (held[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone (doc_id, distinct); rows without a doc_id stay.

    A bitmap of a bounded size lets most rows pass where they are; only those that it may hold are joined.
    """
    held = bitmap(gone.select(F.xxhash64("doc_id").alias("h")), "h")

    def part(inside: bool):
        def run(batches):
            for b in batches:
                hit = in_bitmap(held.value, b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)) if b.num_rows else np.empty(0, bool)
                kept = b.filter(pa.array(hit == inside))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], schema=pa.schema(list(kept.schema)[:-1]))

        return docs.select("*", F.xxhash64(docs["doc_id"].cast("long")).alias("_hash_of_id")).mapInArrow(run, docs.schema)

    rest = part(True)
    return part(False).unionByName(rest.join(gone, rest["doc_id"] == gone["doc_id"], "left_anti"))


def packed(x: np.ndarray) -> bytes:
    """Numbers of eight bytes, byte by byte of their value, compressed: leading zeros take no room."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)
