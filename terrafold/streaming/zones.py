"""Zone observations as a stream: daily degree days, records once, zones merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrafold.sources.stores import merge
from terrafold.sources.versions import BUCKETS, merge_version


def daily_gdd(obs: DataFrame, base: float = 10.0, cutoff: float = 30.0, late: str = "2 days") -> DataFrame:
    """has_agri_parcel, zone_id, day, gdd, n: a row for each zone and day, final once the watermark has passed it."""
    degrees = F.greatest(F.lit(0.0), (F.least(F.col("t_max"), F.lit(cutoff)) + F.col("t_min")) / 2 - base)
    days = obs.withWatermark("observed_at", late).groupBy("has_agri_parcel", "zone_id", F.window("observed_at", "1 day").alias("w"))
    return days.agg(F.sum(degrees).alias("gdd"), F.count(F.lit(1)).alias("n")).select("has_agri_parcel", "zone_id", F.to_date("w.start").alias("day"), "gdd", "n")


def once(records: DataFrame, key: str = "id", time: str = "observed_at", late: str = "2 days") -> DataFrame:
    """Each record the first time it comes; repeats within the watermark are dropped."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def last_of_batch(batch: DataFrame, key: str, time: str) -> DataFrame:
    """A row for each key: the last observed, of equal times the largest."""
    return batch.groupBy(key).agg(F.max(F.struct(time, *(c for c in batch.columns if c not in (key, time)))).alias("last")).select(key, "last.*").select(*batch.columns)


def merge_stream(stream: DataFrame, store: str, checkpoint: str, key: str = "id", time: str = "observed_at") -> StreamingQuery:
    """Merges each batch into a new version of the Parquet store (folders v0, v1, ...); runs what is there and ends.

    Of several rows of a batch with one key the last observed stays (of equal times the largest row). Every batch writes
    the whole store: that is for small ones, see merge_buckets.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = last_of_batch(batch, key, time)
        if epoch:
            rows = merge(spark.read.parquet(f"{store}/v{epoch - 1}"), rows, key)
        rows.write.mode("overwrite").parquet(f"{store}/v{epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_buckets(stream: DataFrame, store: str, checkpoint: str, key: str = "id", time: str = "observed_at", buckets: int = BUCKETS) -> StreamingQuery:
    """Merges each batch as a version of the store; runs what is there and ends.

    A batch rewrites the buckets of its keys; one that comes again after a restart changes nothing. versions.read()
    gives the rows.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        merge_version(last_of_batch(batch, key, time), store, key, epoch, buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
