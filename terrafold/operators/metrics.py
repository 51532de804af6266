"""The seven metrics of each pixel in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions import physics as P


def resolve_weather(weather: DataFrame) -> DataFrame:
    """The known fields under their main names, defaults where neither name has a value; doy from the date if there is none."""
    kept = [c for c in weather.columns if c not in {n for w in P.WEATHER for n in w[:2]} | {"doy"}]
    doy = F.coalesce(F.col("doy"), F.dayofyear("date")) if "doy" in weather.columns else F.dayofyear("date")
    return weather.select(*kept, *(P.weather_field(n).alias(n) for n, _, _ in P.WEATHER), doy.cast("int").alias("doy"))


def with_soil(df: DataFrame, soil: DataFrame, key: str = "parcel_id") -> DataFrame:
    """df with wp, fc and awc of its parcel's soil, of loam where the soil isn't known."""
    s = soil.select(F.col(key), F.col("sand_pct"), F.col("clay_pct"))
    joined = df.join(s, key, "left")
    sand, clay = F.coalesce("sand_pct", F.lit(P.LOAM[0])), F.coalesce("clay_pct", F.lit(P.LOAM[2]))
    out = joined.withColumn("wp", P.wilting_point(sand, clay)).withColumn("fc", P.field_capacity(sand, clay))
    return out.withColumn("awc", F.col("fc") - F.col("wp")).drop("sand_pct", "clay_pct")


def _own(pixels: DataFrame) -> DataFrame:
    """pixels with what doesn't depend on their tile: temperatures, radiation, evapotranspiration."""
    c = F.col
    t = lambda name: P.lapse_temperature(c(name), c("elevation_m"), c("elev"))
    df = pixels.withColumn("temperature_avg", t("t_avg")).withColumn("temperature_min", t("t_min")).withColumn("temperature_max", t("t_max"))
    df = df.withColumn("solar_radiation", P.tilted_radiation(c("solar_rad_w_m2"), c("lat"), c("aspect"), c("slope"), c("doy")))
    return df.withColumn("eto", P.evapotranspiration(c("temperature_avg"), c("temperature_min"), c("temperature_max"), c("solar_radiation"), c("wind_speed_ms"), c("rh_avg"), c("elev")))


def tile_values(pixels: DataFrame) -> DataFrame:
    """tile_id, tile_eto, tile_min: a tile's mean evapotranspiration and lowest elevation, by partial aggregates."""
    return _own(pixels).groupBy("tile_id").agg(F.avg("eto").alias("tile_eto"), F.min("elev").alias("tile_min"))


def all_metrics(pixels: DataFrame, days: int = 5) -> DataFrame:
    """pixels with a column for each metric.

    Needs tile_id, elev, lat, slope, aspect, the weather's fields and doy, wp, fc, awc. Temperatures and radiation are
    computed once; the tile's mean evapotranspiration and lowest elevation come from one window by tile, if pixels
    don't carry them (see tile_values).
    """
    c, tile = F.col, W.partitionBy("tile_id")
    df = _own(pixels)
    if "tile_eto" not in pixels.columns:
        df = df.withColumn("tile_eto", F.avg("eto").over(tile)).withColumn("tile_min", F.min("elev").over(tile))
    df = df.withColumn("water_balance", P.water_balance(c("precip_mm") * days, c("tile_eto") * days))
    df = df.withColumn("frost_risk", P.frost_risk(c("temperature_min"), c("elev"), c("tile_min")))
    df = df.withColumn("soil_moisture", P.soil_moisture(c("awc"), c("fc"), c("wp"), c("precip_mm") * days, c("tile_eto") * days))
    return df.select(*pixels.columns, *P.METRICS)


def long_form(df: DataFrame, keys: list[str], metrics: tuple[str, ...] = P.METRICS) -> DataFrame:
    """keys, metric, value."""
    return df.unpivot(keys, list(metrics), "metric", "value")
