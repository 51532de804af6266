"""A store of rows by key in hash buckets, with a manifest for each version.

A version is one small file that names, for every bucket, the folder with its rows. A merge reads and writes only the
buckets that its keys fall into, into a new folder, and then puts a new manifest in place by one rename. Readers
take the last manifest; a job that dies before the rename leaves the store as it was. A version is written once: when a
batch comes again, the manifest of its version is there already and nothing changes.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.session import large

BUCKETS = 64
_MANIFEST = re.compile(r"(\d{19})\.json")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the store's versions, in order; none if there is no store."""
    fs, p = _fs(spark, f"{store}/manifests")
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(m[1]) for n in names if (m := _MANIFEST.fullmatch(n)))


def _manifest(spark: SparkSession, store: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{store}/manifests/{version:019d}.json", wholetext=True).first().value)


def _commit(spark: SparkSession, store: str, version: int, manifest: dict) -> bool:
    """Puts a manifest in place; False if the version has one."""
    fs, final = _fs(spark, f"{store}/manifests/{version:019d}.json")
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifests/.{version:019d}.{manifest['folder']}")
    fs.mkdirs(final.getParent())
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return not fs.exists(final) and fs.rename(temporary, final)


def bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def read(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one if none is named."""
    known = versions(spark, store)
    if not known or version not in (None, *known):
        raise ValueError("the store has no such version")
    m = _manifest(spark, store, known[-1] if version is None else version)
    return _rows(spark, store, m, m["at"])


def _rows(spark: SparkSession, store: str, manifest: dict, at: dict[str, str]) -> DataFrame:
    paths = [f"{store}/data/{folder}/_bucket={b}" for b, folder in at.items()]
    return spark.read.schema(manifest["schema"]).parquet(*paths) if paths else spark.createDataFrame([], manifest["schema"])


def merge_version(rows: DataFrame, store: str, key: str, version: int, buckets: int = BUCKETS) -> bool:
    """Merges rows (one for each key) into the store as a new version; False if that version was there.

    The first merge makes the store and sets its number of buckets and columns. Rows with a null key are one key.
    """
    spark, known = rows.sparkSession, versions(rows.sparkSession, store)
    if version in known:
        return False
    if known and version < known[-1]:
        raise ValueError("versions go forward")
    old = _manifest(spark, store, known[-1]) if known else {"buckets": buckets, "schema": _ddl(rows), "at": {}}
    n, folder = old["buckets"], f"{version:019d}-{spark._jvm.java.util.UUID.randomUUID()}"
    new = rows.select(*spark.createDataFrame([], old["schema"]).columns).withColumn("_bucket", bucket(key, n))
    touched = sorted(r._bucket for r in new.select("_bucket").distinct().collect())  # buckets at most
    had = {str(b): old["at"][str(b)] for b in touched if str(b) in old["at"]}
    if had:
        rest, names = _rows(spark, store, old, had).withColumn("_bucket", bucket(key, n)), new.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"))
        new = rest.join(large(names), (F.col("_bucket") == F.col("_b")) & F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(new)
    if touched:
        new.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{store}/data/{folder}")
    return _commit(spark, store, version, old | {"folder": folder, "at": old["at"] | {str(b): folder for b in touched}})


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def forget(spark: SparkSession, store: str, keep: int = 1) -> int:
    """Deletes all versions but the last keep, and the folders that only they name; gives how many folders went."""
    known = versions(spark, store)
    kept = {f for v in known[-keep:] for f in _manifest(spark, store, v)["at"].values()}
    gone = {f for v in known[:-keep] for f in _manifest(spark, store, v)["at"].values()} - kept
    for path in [f"{store}/manifests/{v:019d}.json" for v in known[:-keep]] + [f"{store}/data/{f}" for f in sorted(gone)]:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return len(gone)
