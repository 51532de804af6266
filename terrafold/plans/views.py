"""Domain views over the test tables, as DataFrames and as the same SQL.

The test tables hold no terrain or weather, so tiles come from orders, observations from events, parcels from customers,
stations and devices from suppliers, soils from parts and pixel values from line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.physics import METRICS
from terrafold.operators.metrics import resolve_weather, with_soil
from terrafold.operators.terrain import horn, pixel_grid

URN = "urn:ngsi-ld:AgriParcel:"
DAY = "2024-01-15"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def zone_obs(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("value") % 45
    return table(spark, d, "events").select(F.concat(F.lit(URN), "event_type").alias("has_agri_parcel"), F.concat(F.lit("z"), (F.col("user_id") % 8).cast("string")).alias("zone_id"), F.col("ts").alias("observed_at"), t.alias("t_max"), (t - 9).alias("t_min"))


def dem(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    cells = table(spark, d, "orders").select(F.expr("o_orderkey div 400").alias("tile_id"), F.expr("(o_orderkey % 400) div 20").alias("r"), (k % 20).alias("c"))
    whole = cells.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 400").select("tile_id")
    t, c = F.col("tile_id"), F.col
    elev = 100 + 30 * (t % 5) + 6 * F.abs(c("r") - (4 + t % 11)) + 4 * F.abs(c("c") - (5 + t % 7))
    return cells.join(whole, "tile_id").select(
        "tile_id", "r", "c", elev.cast("double").alias("elev"), F.lit(1e-4).alias("pixel_size_deg"), F.lit(20).alias("rows"), F.lit(20).alias("cols"),
        ((t % 50).cast("double") / 100 - 2).alias("origin_lon"), (F.floor(t / 50).cast("double") / 100 + 40).alias("origin_lat"),
    )


def terrain(spark: SparkSession, d: str) -> DataFrame:
    return horn(pixel_grid(dem(spark, d)))


def parcels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.lit("AgriParcel").alias("type"), F.col("c_mktsegment").alias("tenant"), F.concat(F.lit(URN), k.cast("string")).alias("id"), k.alias("k"),
        ((k % 50).cast("double") * 0.004 - 2).alias("lon"), (F.floor(k / 50).cast("double") * 0.004 + 42.5).alias("lat"),
    )


def weather(spark: SparkSession, d: str) -> DataFrame:
    """Some fields stand under their other name, some are missing."""
    n, s = F.col("n"), F.col("station")
    by = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("station"), F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    real = lambda x: x.cast("double")
    none = F.lit(None).cast("double")
    return by.select(
        "station", "date", F.when(n % 4 != 0, real(12 + n % 13)).alias("t_avg"), F.when((n % 4 == 0) & (n % 8 != 0), real(11 + n % 5)).alias("temperature_avg"),
        real(6 + n % 7).alias("t_min"), none.alias("temperature_min"), real(19 + n % 11).alias("t_max"), none.alias("temperature_max"), F.when(n % 5 != 0, real(40 + n % 50)).alias("rh_avg"), none.alias("humidity"),
        (real(n % 7) / 2 + 0.5).alias("wind_speed_ms"), none.alias("wind_speed"), real(120 + n * 7 % 300).alias("solar_rad_w_m2"), none.alias("solar_radiation"),
        (real(n % 9) * 0.4).alias("precip_mm"), none.alias("precipitation"), none.alias("elevation_m"), real(s * 137 % 800).alias("elevation"),
    )


def soil(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").filter(k % 3 != 0).select(F.concat(F.lit(URN), k.cast("string")).alias("parcel_id"), (20 + F.col("p_size") % 50).cast("double").alias("sand_pct"), (5 + k % 40).cast("double").alias("clay_pct"))


def weather_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Terrain with the day's weather of a station and the soil of a parcel for each tile; few stations and soils, whose size Spark checks."""
    day = resolve_weather(weather(spark, d)).filter(F.col("date") == F.lit(DAY).cast("date"))
    px = terrain(spark, d).withColumn("station", F.col("tile_id") % 10).withColumn("parcel_id", F.concat(F.lit(URN), F.col("tile_id").cast("string")))
    return with_soil(px.join(day, "station"), soil(spark, d))


def pixel_value(spark: SparkSession, d: str) -> DataFrame:
    """parcel, metric, value; every threshold of the shares occurs."""
    q = F.col("l_quantity").cast("double")
    scaled = (q - 5, q - 15, q * 20, q * 0.25, q * 1.25 - 30, q * 2, q * 1.0)
    metric = F.element_at(F.array(*map(F.lit, METRICS)), F.col("l_linenumber").cast("int"))
    value = F.element_at(F.array(*scaled), F.col("l_linenumber").cast("int"))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("parcel"), metric.alias("metric"), value.alias("value"))


def devices(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("device"), ((k * 7919 % 2000).cast("double") / 10000 - 2).alias("lon"), ((k * 104729 % 1300).cast("double") / 10000 + 42.5).alias("lat"))


# The same as SQL

_N = "count(*)"
SQL = {
    "zone_obs": f"SELECT '{URN}' || event_type AS has_agri_parcel, 'z' || (user_id % 8) AS zone_id, ts AS observed_at, value % 45 AS t_max, value % 45 - 9 AS t_min FROM events",
    "dem": """SELECT t AS tile_id, r, c, (100 + 30 * (t % 5) + 6 * abs(r - (4 + t % 11)) + 4 * abs(c - (5 + t % 7)))::DOUBLE AS elev, 0.0001::DOUBLE AS ps,
        (t % 50)::DOUBLE / 100 - 2 AS origin_lon, (t // 50)::DOUBLE / 100 + 40 AS origin_lat
        FROM (SELECT o_orderkey // 400 AS t, (o_orderkey % 400) // 20 AS r, o_orderkey % 20 AS c, count(*) OVER (PARTITION BY o_orderkey // 400) AS n FROM orders) WHERE n = 400""",
    "near1": "SELECT *, lag(elev) OVER (PARTITION BY tile_id, r ORDER BY c) AS w, lead(elev) OVER (PARTITION BY tile_id, r ORDER BY c) AS e FROM dem",
    "near": """SELECT *, lag(w) OVER v AS nw, lag(elev) OVER v AS n, lag(e) OVER v AS ne, lead(w) OVER v AS sw, lead(elev) OVER v AS s, lead(e) OVER v AS se
        FROM near1 WINDOW v AS (PARTITION BY tile_id, c ORDER BY r)""",
    "slopes": """SELECT *, coalesce(((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8 * ps * 111320.0::DOUBLE), 0) AS dzdx, coalesce(((sw + 2 * s + se) - (nw + 2 * n + ne)) / (8 * ps * 111320.0::DOUBLE), 0) AS dzdy FROM near""",
    "terrain": """SELECT tile_id, r, c, elev, ps, dzdx, dzdy, origin_lon + c * ps * 20 / 19 AS lon, origin_lat + r * ps * 20 / 19 AS lat, degrees(atan(sqrt(dzdx * dzdx + dzdy * dzdy))) AS slope,
        CASE WHEN dzdx = 0 AND dzdy = 0 THEN 0 WHEN atan2(-dzdx, dzdy) < 0 THEN degrees(atan2(-dzdx, dzdy)) + 360 ELSE degrees(atan2(-dzdx, dzdy)) END AS aspect FROM slopes""",
    "parcels": f"SELECT 'AgriParcel' AS type, c_mktsegment AS tenant, '{URN}' || c_custkey AS id, c_custkey AS k, (c_custkey % 50)::DOUBLE * 0.004::DOUBLE - 2 AS lon, (c_custkey // 50)::DOUBLE * 0.004::DOUBLE + 42.5::DOUBLE AS lat FROM customer",
    "stations": "SELECT user_id % 10 AS station, ts::DATE AS date, count(*) AS n FROM events GROUP BY ALL",
    "weather": """SELECT station, date, coalesce(CASE WHEN n % 4 <> 0 THEN 12 + n % 13 END, CASE WHEN n % 4 = 0 AND n % 8 <> 0 THEN 11 + n % 5 END, 15)::DOUBLE AS t_avg, (6 + n % 7)::DOUBLE AS t_min, (19 + n % 11)::DOUBLE AS t_max,
        coalesce(CASE WHEN n % 5 <> 0 THEN 40 + n % 50 END, 60)::DOUBLE AS rh_avg, (n % 7)::DOUBLE / 2 + 0.5 AS wind_speed_ms, (120 + n * 7 % 300)::DOUBLE AS solar_rad_w_m2, (n % 9)::DOUBLE * 0.4::DOUBLE AS precip_mm,
        (station * 137 % 800)::DOUBLE AS elevation_m, dayofyear(date)::INT AS doy FROM stations""",
    "soil": f"SELECT '{URN}' || p_partkey AS parcel_id, (20 + p_size % 50)::DOUBLE AS sand_pct, (5 + p_partkey % 40)::DOUBLE AS clay_pct FROM part WHERE p_partkey % 3 <> 0",
    "soils": """SELECT *, greatest(-0.024::DOUBLE * sand + 0.487::DOUBLE * clay + 0.011::DOUBLE * sand * clay + 0.013::DOUBLE, 0.01::DOUBLE) AS wp,
        greatest(-0.251::DOUBLE * sand + 0.195::DOUBLE * clay + 0.017::DOUBLE * sand * clay + 0.027::DOUBLE, greatest(-0.024::DOUBLE * sand + 0.487::DOUBLE * clay + 0.011::DOUBLE * sand * clay + 0.013::DOUBLE, 0.01::DOUBLE) + 0.01::DOUBLE) AS fc
        FROM (SELECT p.id AS parcel_id, coalesce(sand_pct, 50) AS sand, coalesce(clay_pct, 20) AS clay, p.tile_id FROM (SELECT DISTINCT tile_id, '""" + URN + """' || tile_id AS id FROM dem) p LEFT JOIN soil USING (parcel_id) )""".replace("LEFT JOIN soil USING (parcel_id)", "LEFT JOIN soil ON soil.parcel_id = p.id"),
    "px": f"SELECT t.*, w.* EXCLUDE (date), s.wp, s.fc, s.fc - s.wp AS awc FROM terrain t JOIN weather w ON w.station = t.tile_id % 10 AND w.date = DATE '{DAY}' JOIN soils s ON s.tile_id = t.tile_id",
    "pixel_value": f"""SELECT l_suppkey AS parcel, ['{"', '".join(METRICS)}'][l_linenumber] AS metric,
        CASE l_linenumber WHEN 1 THEN l_quantity - 5 WHEN 2 THEN l_quantity - 15 WHEN 3 THEN l_quantity * 20 WHEN 4 THEN l_quantity * 0.25::DOUBLE WHEN 5 THEN l_quantity * 1.25::DOUBLE - 30 WHEN 6 THEN l_quantity * 2 ELSE l_quantity END::DOUBLE AS value FROM lineitem""",
    "devices": "SELECT s_suppkey AS device, (s_suppkey * 7919 % 2000)::DOUBLE / 10000 - 2 AS lon, (s_suppkey * 104729 % 1300)::DOUBLE / 10000 + 42.5::DOUBLE AS lat FROM supplier",
}
_NEEDS = {"near1": "dem", "near": "near1", "slopes": "near", "terrain": "slopes", "weather": "stations", "soils": "dem soil", "px": "terrain weather soils"}

#: Formulas of pixels (px) as SQL.
_T = "({0} - 0.0065::DOUBLE * (elev - elevation_m))"
_E = "(0.6108::DOUBLE * exp(17.27::DOUBLE * {0} / ({0} + 237.3::DOUBLE)))"
SQL["sun"] = """SELECT *, 1440 / pi() * 0.0820::DOUBLE * (1 + 0.033::DOUBLE * cos(2 * pi() * doy / 365)) * (om * sin(phi) * sin(de) + cos(phi) * cos(de) * sin(om)) AS ra, -cos(radians(aspect)) AS ka, radians(slope) AS sg
    FROM (SELECT *, acos(greatest(-1, least(1, -tan(phi) * tan(de)))) AS om FROM (SELECT *, radians(lat) AS phi, 0.409::DOUBLE * sin(2 * pi() * doy / 365 - 1.39::DOUBLE) AS de FROM px))"""
SQL["beam"] = """SELECT *, 0.75::DOUBLE * ra AS rso, greatest(0.1::DOUBLE, least(2, (sin(de) * sin(phi) * cos(sg) - sin(de) * cos(phi) * sin(sg) * ka + cos(de) * cos(phi) * cos(sg) * cos(om) + cos(de) * sin(phi) * sin(sg) * ka * sin(om))
    / CASE WHEN abs(sin(de) * sin(phi) + cos(de) * cos(phi) * cos(om)) <= 1e-10 THEN 1e-10 ELSE sin(de) * sin(phi) + cos(de) * cos(phi) * cos(om) END)) AS rb FROM sun"""
SQL["lit"] = f"""SELECT *, greatest(0, least(1200, 11.6::DOUBLE * greatest(0, (0.75::DOUBLE + 0.25::DOUBLE * greatest(0, least(1, solar_rad_w_m2 / 11.6::DOUBLE / CASE WHEN rso > 0.01 THEN rso ELSE 0.01 END))) * rb * ra - 0.25::DOUBLE * (rb - 1) * rso))) AS solar_radiation,
    {_T.format("t_avg")} AS temperature_avg, {_T.format("t_min")} AS temperature_min, {_T.format("t_max")} AS temperature_max FROM beam"""


def eto_sql(avg: str, low: str, high: str, rad: str, z: str, source: str, name: str = "eto") -> str:
    """SELECT with the evapotranspiration of source's columns added."""
    es = f"(({_E.format(low)} + {_E.format(high)}) / 2)"
    return f"""SELECT *, CASE WHEN below <= 1e-10 THEN 0 ELSE greatest(0, least(15, (0.408::DOUBLE * sl * greatest(0.77::DOUBLE * rs - rnl, 0) + ga * 900 / ({avg} + 273) * wind_speed_ms * (es - ea)) / below)) END AS {name} FROM (
        SELECT *, sl + ga * (1 + 0.34::DOUBLE * wind_speed_ms) AS below, 4.903e-9::DOUBLE * pow({avg} + 273.16::DOUBLE, 4) * (0.34::DOUBLE - 0.14::DOUBLE * sqrt(ea)) * (1.35::DOUBLE * (rs / greatest(rs, 1e-10)) - 0.35::DOUBLE) AS rnl FROM (
        SELECT *, 0.000665::DOUBLE * 101.3::DOUBLE * pow((293 - 0.0065::DOUBLE * {z}) / 293, 5.26::DOUBLE) AS ga, {es} AS es, {es} * rh_avg / 100 AS ea, 4098 * {_E.format(avg)} / pow({avg} + 237.3::DOUBLE, 2) AS sl, {rad} / 11.6::DOUBLE AS rs FROM {source}))"""


SQL["wet"] = eto_sql("temperature_avg", "temperature_min", "temperature_max", "solar_radiation", "elev", "lit")
SQL["metrics"] = """SELECT *, precip_mm * 5 - te * 5 AS water_balance, 100 / (1 + exp(0.5::DOUBLE * (temperature_min - 2 * exp(-(elev - tm) / 50) - 1))) AS frost_risk,
    greatest(wp, least(fc, 0.6::DOUBLE * fc + 0.7::DOUBLE * (precip_mm * 5) / awc - te * 5 / awc)) AS soil_moisture
    FROM (SELECT *, avg(eto) OVER (PARTITION BY tile_id) AS te, min(elev) OVER (PARTITION BY tile_id) AS tm FROM wet)"""
SQL["classed"] = "SELECT *, floor(elev / 50)::INT AS band, CASE WHEN slope < 2 THEN 0 ELSE floor(((aspect + 22.5::DOUBLE) % 360) / 45)::INT + 1 END AS sector FROM terrain"
#: Smallest place r * 20 + c that each pixel reaches through neighbours of its own band and sector.
SQL["reach"] = "SELECT tile_id, r, c, band, sector, (SELECT 1) AS one FROM classed"
_NEEDS |= {"sun": "px", "beam": "sun", "lit": "beam", "wet": "lit", "metrics": "wet", "classed": "terrain"}
del SQL["reach"]


def with_views(*names: str) -> str:
    """WITH clause of the views named and all that they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, "").split():
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n"
