"""Growing degree days of a parcel's zones."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.entities import any_urn


def season(start: str, now: datetime) -> datetime:
    """The season's first moment; ValueError unless it is a calendar date (YYYY-MM-DD) before now."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", start):
        raise ValueError("season_start must be YYYY-MM-DD")
    first = datetime.fromisoformat(start)
    if first >= now:
        raise ValueError("season_start must lie before now")
    return first


def gdd_by_zone(obs: DataFrame, parcel: str | None, start: datetime, now: datetime, base: float = 10.0, cutoff: float = 30.0) -> DataFrame:
    """has_agri_parcel, zone_id, gdd, days: sums of daily degrees over base, highs cut off, over start <= t < now.

    One shuffle, after partial aggregates; parcel and time are filtered at the scan. A null extreme doesn't count.
    """
    rows = obs.filter((F.col("observed_at") >= F.lit(start)) & (F.col("observed_at") < F.lit(now)))
    if parcel is not None:
        rows = rows.filter(F.col("has_agri_parcel") == any_urn(F.lit(parcel)))
    degrees = F.greatest(F.lit(0.0), (F.least(F.col("t_max"), F.lit(cutoff)) + F.col("t_min")) / 2 - base)
    return rows.groupBy("has_agri_parcel", "zone_id").agg(F.sum(degrees).alias("gdd"), F.count_distinct(F.to_date("observed_at")).alias("days"))


def gdd_totals(zones: DataFrame) -> DataFrame:
    """has_agri_parcel, gdd_total, days_count, mean_daily, n_zones: sums over zones; days of the zone with the most."""
    total = zones.groupBy("has_agri_parcel").agg(F.sum("gdd").alias("g"), F.max("days").alias("days_count"), F.count(F.lit(1)).alias("n_zones"))
    mean = F.when(F.col("days_count") > 0, F.round(F.col("g") / F.col("days_count"), 2)).otherwise(0.0)
    return total.select("has_agri_parcel", F.round("g", 1).alias("gdd_total"), "days_count", mean.alias("mean_daily"), "n_zones")
