"""Stores: rasters by (tenant, metric, date), the latest pointer, records that are appended, zones that are merged.

A raster store is a Parquet folder tenant=/metric=/date=. A row is a tile with its pixels' values as an array; it is
read as a row for each pixel. Within a partition tiles are dealt by blocks and sorted, so reading a tile skips all other
row groups. What a store holds is read from the names of its folders; no file is opened.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions.entities import parcel_urn
from terrafold.functions.geo import unwrap

RASTER = "tenant string, metric string, date date, z int, x int, y int, r int, c int, value float"
BOUNDS = ("west", "south", "east", "north")
#: A tile as it is stored. values are in the order of places (r and c in one number, see place), which are null where the
#: tile has each of its rows x cols pixels once.
TILE = "tenant string, metric string, date date, z int, x int, y int, places array<bigint>, values array<float>, west double, south double, east double, north double, rows int, cols int"
_PARTITION = "tenant string, metric string, date date"
DEM = "z int, x int, y int, origin_lon double, origin_lat double, pixel_size_deg double, rows int, cols int, elevations array<array<double>>"


def read_dem(spark: SparkSession, path: str) -> DataFrame:
    """Terrain tiles as JSON lines; pixel_size_deg falls back to pixel_size, then 0.0001; sizes to the array's."""
    raw = spark.read.schema(DEM + ", pixel_size double").json(path)
    sized = raw.withColumn("pixel_size_deg", F.coalesce("pixel_size_deg", "pixel_size", F.lit(1e-4))).drop("pixel_size")
    return sized.withColumn("rows", F.coalesce("rows", F.size("elevations"))).withColumn("cols", F.coalesce("cols", F.size(F.col("elevations")[0])))


def write_terrain(tiles: DataFrame, path: str) -> None:
    """Terrain tiles (see DEM) as a folder z=/x=, sorted by y within."""
    tiles.repartition("z", "x").sortWithinPartitions("z", "x", "y").write.mode("overwrite").partitionBy("z", "x").parquet(path)


def read_terrain(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Terrain tiles of such a folder: all, or those wanted (z, x, y; distinct).

    Only the columns of tiles that are wanted are read: what z and x are is found out while the job runs, and other
    folders are left aside.
    """
    held = spark.read.schema(DEM).parquet(path)
    return held if wanted is None else held.join(wanted.select("z", "x", "y"), ["z", "x", "y"], "left_semi")


def with_bounds(pixels: DataFrame) -> DataFrame:
    """pixels with their tile's bounds (west, south, east, north): from the origin, size and number of its pixels."""
    lon, lat, size = F.col("origin_lon"), F.col("origin_lat"), F.col("pixel_size_deg")
    return pixels.withColumns(dict(zip(BOUNDS, (lon, lat, lon + size * F.col("cols"), lat + size * F.col("rows")))))


def place(r: Column, c: Column) -> Column:
    return F.shiftleft(r.cast("long"), 32) + c.cast("long")


def packed(pixels: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row for each tile, of pixels with columns r, c and names: places, and arrays of floats by names, null for NaN.

    All other columns are the tile's. Where pixels are dealt by some of these already, none is shuffled.
    """
    keys = [c for c in pixels.columns if c not in {"r", "c", *names}]
    clean = [F.nanvl(F.col(n).cast("float"), F.lit(None).cast("float")).alias(n) for n in names]
    rows = pixels.select(*keys, F.struct(place(F.col("r"), F.col("c")).alias("place"), *clean).alias("_cell"))
    tiles = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_cell")).alias("_cells"))
    part = lambda n: F.transform("_cells", lambda v: v[n])
    places = part("place")
    if {"rows", "cols"} <= set(keys):
        all_ = F.transform(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1), lambda i: place(F.floor(i / F.col("cols")), i % F.col("cols")))
        full = (F.col("rows") > 0) & (F.col("cols") > 0) & (F.size("_cells") == F.col("rows") * F.col("cols"))
        places = F.when(F.coalesce(full, F.lit(False)), F.when(places != all_, places)).otherwise(places)
    return tiles.select(*keys, places.alias("places"), *(part(n).alias(n) for n in names))


def _dealt(tiles: DataFrame, blocks: int, partition: tuple[str, ...] = ("tenant", "metric", "date")) -> DataFrame:
    """tiles dealt by partition and block, sorted by tile."""
    keys = (*partition, "_block")
    dealt = tiles.withColumn("_block", F.pmod(F.xxhash64("z", "x", "y"), F.lit(blocks)))
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "z", "x", "y")


def _packed(rasters: DataFrame) -> DataFrame:
    return packed(rasters, ["value"]).withColumnRenamed("value", "values")


def write_rasters(rasters: DataFrame, path: str, blocks: int = 8) -> None:
    """Overwrites the partitions that rasters has, keeps the others; blocks: files of a partition at most."""
    _dealt(_packed(rasters), blocks).drop("_block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant", "metric", "date").parquet(path)


def publish(rasters: DataFrame, path: str, pointers: str, tenant: str, on: date, metrics: tuple[str, ...], blocks: int = 8) -> dict[str, int]:
    """publish_tiles() of a row for each pixel (metric, z, x, y, r, c, value and more columns of the tile)."""
    return publish_tiles(_packed(rasters), path, pointers, tenant, on, metrics, blocks)


def publish_tiles(tiles: DataFrame, path: str, pointers: str, tenant: str, on: date, metrics: tuple[str, ...], blocks: int = 8) -> dict[str, int]:
    """Writes a tenant's rasters of a day, then moves the pointers of the metrics of which a tile has a valid pixel.

    All rows (metric, and see TILE) are taken as the tenant's of that day; a metric that isn't in metrics is an error.
    Tiles are counted while they are written, by an observation on the same job, and returned by metric. A pointer
    never moves back.
    """
    spark = tiles.sparkSession
    unknown = F.raise_error(F.concat(F.lit("unknown metric: "), F.coalesce("metric", F.lit("null"))))
    rows = tiles.withColumn("metric", F.when(F.col("metric").isin(*metrics), F.col("metric")).otherwise(unknown))
    # Rows are dealt and sorted by tile already; a tile that has several counts at its first with a valid pixel. Constants come after the window:
    # Spark drops them from its keys, which then differ from those that rows were dealt by, and would deal all rows again.
    before = W.partitionBy("metric", "_block", "z", "x", "y").orderBy("z").rowsBetween(W.unboundedPreceding, -1)
    valid = F.col("_valid")
    dealt = _dealt(rows.withColumn("_valid", F.exists("values", lambda v: v.isNotNull())), blocks, ("metric",))
    flagged = dealt.withColumn("_first", valid & (F.coalesce(F.max(valid.cast("int")).over(before), F.lit(0)) == 0))
    seen = Observation()
    counts = [F.sum((F.col("_first") & (F.col("metric") == m)).cast("long")).alias(m) for m in metrics]
    flagged.observe(seen, *counts).drop("_first", "_valid", "_block").withColumns({"tenant": F.lit(tenant), "date": F.lit(on)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant", "metric", "date").parquet(path)
    found = {m: seen.get.get(m) or 0 for m in metrics}
    move_pointers(spark, pointers, tenant, {m: on for m, n in found.items() if n})
    return found


def read_pointers(spark: SparkSession, pointers: str, tenant: str) -> dict[str, date]:
    """Metric and date of a tenant's pointers (a row for each metric at most)."""
    at = f"{pointers}/tenant={quote(tenant, safe='')}"
    return {r.metric: r.date for r in spark.read.schema("metric string, date date").json(at).collect()} if _exists(spark, at) else {}


def move_pointers(spark: SparkSession, pointers: str, tenant: str, moved: dict[str, date]) -> None:
    """Writes a tenant's pointers anew if one moves forward: the new file is complete before it takes the old one's place."""
    old = read_pointers(spark, pointers, tenant)
    new = old | {m: d for m, d in moved.items() if m not in old or d > old[m]}
    if new == old:
        return
    at = f"{pointers}/tenant={quote(tenant, safe='')}"
    spark.createDataFrame(sorted(new.items()), "metric string, date date").coalesce(1).write.mode("overwrite").json(f"{at}.next")
    fs, folder = _folder(spark, at)
    fs.delete(folder, True)
    fs.rename(_folder(spark, f"{at}.next")[1], folder)


def read_tiles(spark: SparkSession, path: str, tenant: str, metric: str | None = None, on: date | None = None) -> DataFrame:
    """A tenant's tiles (see TILE); metric and date prune partitions."""
    df = spark.read.schema(TILE).parquet(path).filter(F.col("tenant") == tenant)
    df = df if metric is None else df.filter(F.col("metric") == metric)
    return df if on is None else df.filter(F.col("date") == F.lit(on))


def read_rasters(spark: SparkSession, path: str, tenant: str, metric: str | None = None, on: date | None = None, bounds: bool = False) -> DataFrame:
    """A tenant's rasters by pixel, with their tiles' bounds, rows and cols if asked for; metric and date prune partitions."""
    about = [*BOUNDS, "rows", "cols"]
    px = read_tiles(spark, path, tenant, metric, on).select("tenant", "metric", "date", "z", "x", "y", *about, "places", F.posexplode("values").alias("_i", "value"))
    at = F.get("places", F.col("_i"))
    r = F.coalesce(F.shiftright(at, 32), F.floor(F.col("_i") / F.col("cols"))).cast("int")
    c = F.coalesce(at - F.shiftleft(F.shiftright(at, 32), 32), F.col("_i") % F.col("cols")).cast("int")
    return px.select("tenant", "metric", "date", "z", "x", "y", r.alias("r"), c.alias("c"), "value", *(about if bounds else ()))


def latest(rasters: DataFrame) -> DataFrame:
    """tenant, metric, date: the last date for which there is any pixel."""
    return rasters.groupBy("tenant", "metric").agg(F.max("date").alias("date"))


def written_counts(rasters: DataFrame) -> DataFrame:
    """tenant, metric, date, n_tiles: tiles with any valid pixel."""
    tile = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.struct("z", "x", "y"))
    return rasters.groupBy("tenant", "metric", "date").agg(F.count_distinct(tile).alias("n_tiles"))


def pointed(pointers: DataFrame, counts: DataFrame) -> DataFrame:
    """tenant, metric, date: the pointers after a run. Only metrics of which a tile was written move, and never back."""
    moved = counts.filter("n_tiles > 0").select("tenant", "metric", "date")
    return pointers.select("tenant", "metric", "date").unionByName(moved).groupBy("tenant", "metric").agg(F.max("date").alias("date"))


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def _partitions(spark: SparkSession, path: str, tenant: str, metric: str | None = None) -> list[tuple[str, date, str]]:
    """Metric, date and folder of a tenant's partitions, by the names of folders; what isn't a date stays out."""
    fs, root = _folder(spark, path)

    def below(p, key: str) -> list[tuple]:
        names = [(*x.getPath().getName().partition("="), x.getPath()) for x in fs.listStatus(p)]
        return [(unquote(value), at) for name, _, value, at in names if name == key]

    out: list[tuple[str, date, str]] = []
    for m, at in [m for t, top in below(root, "tenant") if t == tenant for m in below(top, "metric")] if fs.exists(root) else []:
        for day, folder in below(at, "date") if metric in (None, m) else []:
            try:
                out.append((m, date.fromisoformat(day), folder.toString()))
            except ValueError:
                continue
    return out


def stored_partitions(spark: SparkSession, path: str, tenant: str, metric: str | None = None) -> DataFrame:
    """tenant, metric, date of what a raster store holds for a tenant: folders are listed, no file is read."""
    return spark.createDataFrame([(tenant, m, d) for m, d, _ in _partitions(spark, path, tenant, metric)], _PARTITION)


def delete_old(spark: SparkSession, path: str, tenant: str, now: datetime, days: int = 30) -> list[tuple[str, date]]:
    """Deletes a tenant's partitions whose day began more than so many days before now; gives their metrics and dates.

    A whole folder goes at once. Pointers and folders that aren't dates stay.
    """
    limit = now.replace(tzinfo=None) - timedelta(days=days)
    old = [(m, d, f) for m, d, f in _partitions(spark, path, tenant) if datetime(d.year, d.month, d.day) < limit]
    for _, _, folder in old:
        fs, p = _folder(spark, folder)
        fs.delete(p, True)
    return sorted((m, d) for m, d, _ in old)


def retained(rasters: DataFrame, today: date, days: int = 30) -> DataFrame:
    """Rows not older than so many days."""
    return rasters.filter(F.col("date") >= F.lit(today - timedelta(days=days)))


def append_if_absent(store: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """store and the rows of new whose key it doesn't have; of several new rows with one key the smallest stays."""
    fresh = new.join(store.select(key), key, "left_anti").select(*store.columns)
    w = W.partitionBy(key).orderBy(*fresh.columns)
    return store.unionByName(fresh.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n"))


def merge(store: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """new, and the rows of store whose key it doesn't have."""
    return store.join(new.select(key), key, "left_anti").select(*store.columns).unionByName(new.select(*store.columns))


def tenant_parcels(entities: DataFrame, tenant: str, most: int = 100) -> DataFrame:
    """The first parcels of a tenant by id, then without those that have no location."""
    first = entities.filter((F.col("tenant") == tenant) & (F.col("type") == "AgriParcel")).orderBy("id").limit(most)
    return first.filter("location is not null")


def attribute(entities: DataFrame, id_: str, name: str) -> DataFrame:
    """id and value of one attribute of one entity (text of a column, or member of its JSON under attributes); none if it has none."""
    found = entities.filter(F.col("id") == id_)
    value = F.col(name).cast("string") if name in entities.columns else F.get_json_object("attributes", f"$['{name}'].value") if "attributes" in entities.columns else F.lit(None).cast("string")
    return found.select("id", value.alias("value")).filter("value is not null")


def parcel_by_id(entities: DataFrame, id_: str) -> DataFrame:
    """id and geometry of one parcel, its id with or without prefix; none if it has no geometry."""
    found = entities.filter(F.col("id") == parcel_urn(F.lit(id_)))
    geometry = F.coalesce(unwrap(F.col("location")), unwrap(F.col("geometry"))) if "geometry" in entities.columns else unwrap(F.col("location"))
    return found.select("id", geometry.alias("geometry")).filter("geometry is not null")


def devices(entities: DataFrame) -> DataFrame:
    """id, location (geometry) of devices that have a position."""
    return entities.filter("type = 'Device'").select("id", unwrap(F.col("location")).alias("location")).filter("location is not null")


def latest_zones(zones: DataFrame, parcel: str, n: int = 20) -> DataFrame:
    """A parcel's zones, the last observed first; ValueError unless 1 <= n <= 50."""
    if not 1 <= n <= 50:
        raise ValueError("limit must be between 1 and 50")
    return zones.filter((F.col("type") == "AgriParcelZone") & (F.col("has_agri_parcel") == parcel_urn(F.lit(parcel)))).orderBy(F.desc("observed_at"), "id").limit(n)


def tenants(text: str) -> list[str]:
    return [t.strip() for t in text.split(",") if t.strip()]


def forecast(df: DataFrame, days: int = 7) -> DataFrame:
    """day, et0, precip, deficitAfter of the first days of an array (date, eto_mm, precip_mm) under forecast; ValueError unless 1 <= days <= 14."""
    if not 1 <= days <= 14:
        raise ValueError("days must be between 1 and 14")
    df = df.withColumn("forecast", F.slice("forecast", 1, days))
    day = df.select(*(c for c in df.columns if c != "forecast"), F.explode("forecast").alias("d"))
    kept = [c for c in day.columns if c != "d"]
    return day.select(*kept, F.coalesce("d.date", F.lit("")).alias("day"), F.coalesce("d.eto_mm", F.lit(0.0)).alias("et0"), F.coalesce("d.precip_mm", F.lit(0.0)).alias("precip"), F.lit(0.0).alias("deficitAfter"))
