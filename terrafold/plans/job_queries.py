"""The jobs over the test tables, from parcels to what they have stored, each beside the same as SQL.

Terrain, stations and forecasts are derived from the tables for the map tiles that the parcels lie in.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold import jobs
from terrafold.functions import geo
from terrafold.functions.physics import METRICS
from terrafold.operators import terrain
from terrafold.plans import views as V
from terrafold.plans.catalogue import Query, _COVER
from terrafold.session import shared_folder, written
from terrafold.sources import stores, versions

TENANT, ON, AT = "t1", date.fromisoformat(V.DAY), "2024-01-15T06:00:00Z"
SIDE = 20
PIXEL = 360 / 2**jobs.ZOOM / SIDE


def parcels(spark: SparkSession, d: str) -> DataFrame:
    return V.parcels(spark, d).select("id", geo.square(F.col("lon"), F.col("lat")).alias("geometry"))


def dem(spark: SparkSession, d: str) -> DataFrame:
    """A terrain tile for each map tile of the parcels; a seventh of the tiles has none."""
    t, cell = F.col("x") * 7 + F.col("y"), lambda r, c: (100 + 30 * (t % 5) + 6 * F.abs(r - (4 + t % 11)) + 4 * F.abs(c - (5 + t % 7))).cast("double")
    places = F.sequence(F.lit(0), F.lit(SIDE - 1))
    held = jobs.tiles_of(parcels(spark, d)).select("z", "x", "y").distinct().filter(t % 7 != 0).withColumn("b", geo.tile_bounds(F.col("z"), F.col("x"), F.col("y")))
    return held.select("z", "x", "y", F.col("b.min_lon").alias("origin_lon"), F.col("b.min_lat").alias("origin_lat"), F.lit(PIXEL).alias("pixel_size_deg"), F.lit(SIDE).alias("rows"), F.lit(SIDE).alias("cols"), F.transform(places, lambda r: F.transform(places, lambda c: cell(r, c))).alias("elevations"))


def weather(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("station")
    return V.weather(spark, d).withColumns({"lon": (s.cast("double") * 0.02 - 2), "lat": 42.5 + (s * 7 % 10).cast("double") * 0.1})


def _stored(spark: SparkSession, d: str) -> str:
    at = f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"
    jobs.rasters(parcels(spark, d), dem(spark, d), weather(spark, d), V.soil(spark, d), f"{at}/rasters", f"{at}/pointers", TENANT, ON)
    return at


def job_rasters(spark: SparkSession, d: str) -> DataFrame:
    """The raster job's tiles, read again from its store."""
    at = _stored(spark, d)
    px = stores.read_rasters(spark, f"{at}/rasters", TENANT, on=ON, bounds=True)
    one = lambda f, c: F.round(f(c), 3)
    return px.groupBy("metric", "x", "y").agg(F.count("value").alias("n"), one(F.avg, F.col("value").cast("double")).alias("mean"), one(F.min, F.col("value").cast("double")).alias("least"), one(F.max, F.col("value").cast("double")).alias("most"), F.round(F.max("west"), 6).alias("west"), F.round(F.max("north"), 6).alias("north"))


def job_records(spark: SparkSession, d: str) -> DataFrame:
    """The records that the raster job leaves of each parcel, read again from the versioned store; written twice, kept once."""
    at = _stored(spark, d)
    stats = written(jobs.zonal_stats(parcels(spark, d), f"{at}/rasters", f"{at}/pointers", TENANT, ("eto", "frost_risk", "soil_moisture")))
    for _ in range(2):
        jobs.persist_zonal_stats(stats, f"{at}/records", TENANT, AT)
    value = lambda n: F.round(F.get_json_object("record", f"$.{n}.value").cast("double"), 3)
    return versions.read(spark, f"{at}/records").select("id", "parcel", value("eto").alias("eto"), value("frostRisk").alias("frost_risk"), value("soilMoistureVwc").alias("soil_moisture"))


def job_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone entities that the zoning job leaves, read again from the versioned store."""
    at = f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"
    table = jobs.zone_table(parcels(spark, d), dem(spark, d), weather(spark, d), V.devices(spark, d), ON, min_pixels=10)
    jobs.zones(table, at, TENANT, AT)
    value = lambda n: F.get_json_object("entity", f"$['{n}'].value").cast("double")
    return versions.read(spark, at).select("id", "parcel", value("nkz:elevationMean").alias("elevation_mean"), value("nkz:pixelCount").alias("pixel_count"), value("tMin").alias("t_min"), value("eto").alias("eto"), value("nkz:sensorDistanceM").alias("distance_m"))




def terrain_store(spark: SparkSession, d: str) -> DataFrame:
    """Terrain written as a store and read again for the tiles of one tenant's parcels; tiles, their bounds and mean heights."""
    at = f"{shared_folder(spark)}/terrain-{uuid.uuid4().hex}"
    stores.write_terrain(dem(spark, d), at)
    of = V.parcels(spark, d).filter("tenant = 'BUILDING'").select("id", geo.square(F.col("lon"), F.col("lat")).alias("geometry"))
    found = stores.read_terrain(spark, at, jobs.tiles_of(of).select("z", "x", "y").distinct())
    px = stores.with_bounds(terrain.explode_grid(terrain.valid_tiles(found)))
    return px.groupBy("x", "y").agg(F.count("elev").alias("n"), F.round(F.avg("elev"), 6).alias("mean"), F.round(F.max("south"), 6).alias("south"), F.round(F.max("east"), 6).alias("east"))


_HAVERSINE = "2 * 6371000.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h))"
_VIEWS = {
    "dem": f"""SELECT (x::BIGINT << 32) | y AS tile_id, x, y, r, c, (100 + 30 * (t % 5) + 6 * abs(r - (4 + t % 11)) + 4 * abs(c - (5 + t % 7)))::DOUBLE AS elev, {PIXEL!r}::DOUBLE AS ps, x / 16384.0::DOUBLE * 360 - 180 AS origin_lon,
        degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 16384.0::DOUBLE)))) AS origin_lat, degrees(atan(sinh(pi() * (1 - 2 * y / 16384.0::DOUBLE)))) AS top
        FROM (SELECT *, x * 7 + y AS t FROM (SELECT DISTINCT x, y FROM cover)), (SELECT unnest(generate_series(0, 19)) AS r), (SELECT unnest(generate_series(0, 19)) AS c) WHERE t % 7 <> 0""",
    "terrain": V.SQL["terrain"].replace("SELECT tile_id,", "SELECT tile_id, x, y, origin_lon, origin_lat, top,"),
    "weather": f"""SELECT station, coalesce(arg_max(12 + n % 13, date) FILTER (n % 4 <> 0), arg_max(11 + n % 5, date) FILTER (n % 4 = 0 AND n % 8 <> 0), 15)::DOUBLE AS t_avg, arg_max(6 + n % 7, date)::DOUBLE AS t_min, arg_max(19 + n % 11, date)::DOUBLE AS t_max,
        coalesce(arg_max(40 + n % 50, date) FILTER (n % 5 <> 0), 60)::DOUBLE AS rh_avg, arg_max((n % 7)::DOUBLE / 2 + 0.5, date) AS wind_speed_ms, arg_max(120 + n * 7 % 300, date)::DOUBLE AS solar_rad_w_m2, arg_max((n % 9)::DOUBLE * 0.4::DOUBLE, date) AS precip_mm,
        (station * 137 % 800)::DOUBLE AS elevation_m, dayofyear(DATE '{V.DAY}')::INT AS doy FROM stations WHERE date > DATE '{V.DAY}' - 5 AND date <= DATE '{V.DAY}' GROUP BY station""",
    "soils": V.SQL["soils"].replace("SELECT DISTINCT tile_id, 'urn:ngsi-ld:AgriParcel:' || tile_id AS id FROM dem", "SELECT (x::BIGINT << 32) | y AS tile_id, min(id) AS id FROM (SELECT x, y, 'urn:ngsi-ld:AgriParcel:' || k AS id FROM cover) GROUP BY 1"),
    "px": f"""SELECT t.*, w.*, s.wp, s.fc, s.fc - s.wp AS awc FROM terrain t JOIN (
            SELECT tile_id, arg_min(station, {{'d': {_HAVERSINE}, 's': station}}) AS near FROM (SELECT *, pow(sin(radians(b - lat) / 2), 2) + cos(radians(lat)) * cos(radians(b)) * pow(sin(radians(a - lon) / 2), 2) AS h FROM (
                SELECT tile_id, station, any_value(origin_lon + 180 / 16384.0::DOUBLE) AS lon, any_value((origin_lat + top) / 2) AS lat, station * 0.02::DOUBLE - 2 AS a, 42.5::DOUBLE + (station * 7 % 10) * 0.1::DOUBLE AS b FROM dem, weather GROUP BY tile_id, station)) GROUP BY 1) n USING (tile_id)
        JOIN weather w ON w.station = n.near JOIN soils s ON s.tile_id = t.tile_id""",
}


def _sql(rest: str) -> str:
    text = V.with_views("parcels", "metrics")
    for name, sql in _VIEWS.items():
        assert f"{name} AS ({V.SQL[name]})" in text
        text = text.replace(f"{name} AS ({V.SQL[name]})", f"{name} AS MATERIALIZED ({sql})")
    head, dem_, tail = text.partition("dem AS MATERIALIZED")
    return head + _COVER + ",\n" + dem_ + tail.rstrip() + ",\n" + rest


_LONG = "long AS (SELECT x, y, r, c, origin_lon AS west, origin_lat + ps * 20 AS north, ps, unnest(['{}']) AS metric, unnest([{}])::FLOAT::DOUBLE AS value FROM metrics)".format("', '".join(METRICS), ", ".join(METRICS))
SQL = {
    "job_rasters": _sql(_LONG + "\nSELECT metric, x::INT AS x, y::INT AS y, count(value) AS n, round(avg(value), 3) AS mean, round(min(value), 3) AS least, round(max(value), 3) AS most, round(max(west), 6) AS west, round(max(north), 6) AS north FROM long GROUP BY 1, 2, 3"),
    "terrain_store": _sql("SELECT x::INT AS x, y::INT AS y, count(*) AS n, round(avg(elev), 6) AS mean, round(max(origin_lat), 6) AS south, round(max(origin_lon + ps * 20), 6) AS east FROM dem JOIN (SELECT DISTINCT x, y FROM cover WHERE tenant = 'BUILDING') USING (x, y) GROUP BY 1, 2"),
    "job_records": _sql(_LONG + f""", cells AS (SELECT *, west + c * ps AS x0, north - r * ps AS y1 FROM long),
        z AS (SELECT k, metric, avg(value) AS mean FROM (SELECT DISTINCT p.k, p.lon, p.lat, v.x, v.y FROM parcels p JOIN cover v ON v.k = p.k) p JOIN cells ON cells.x = p.x AND cells.y = p.y AND x0 <= lon + 0.0005::DOUBLE AND x0 + ps >= lon - 0.0005::DOUBLE AND y1 - ps <= lat + 0.0005::DOUBLE AND y1 >= lat - 0.0005::DOUBLE GROUP BY 1, 2)
        SELECT 'urn:ngsi-ld:AgriParcelRecord:weather-{TENANT}-' || k || '-20240115060000' AS id, '{V.URN}' || k AS parcel, round(max(mean) FILTER (metric = 'eto'), 3) AS eto, round(max(mean) FILTER (metric = 'frost_risk'), 3) AS frost_risk, round(max(mean) FILTER (metric = 'soil_moisture'), 3) AS soil_moisture FROM parcels LEFT JOIN z USING (k) GROUP BY k"""),
}


def queries() -> dict[str, Query]:
    return {"job_rasters": job_rasters, "job_records": job_records, "job_zones": job_zones, "terrain_store": terrain_store}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
