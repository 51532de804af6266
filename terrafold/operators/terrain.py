"""Slope, aspect, gradients, sectors and bands of terrain grids (tile_id, r, c, elev).

All windows here are partitioned by the tile first, so one exchange by tile_id serves every window of a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions import geo

METRES_PER_DEGREE = 111_320.0


def _neighbours(dem: DataFrame) -> DataFrame:
    """Eight neighbours by place; null outside the tile. Rows above and below come from windows over columns."""
    row, col = W.partitionBy("tile_id", "r").orderBy("c"), W.partitionBy("tile_id", "c").orderBy("r")
    df = dem.withColumn("w", F.lag("elev").over(row)).withColumn("e", F.lead("elev").over(row))
    trio = F.struct("w", "elev", "e")
    df = df.withColumn("up", F.lag(trio).over(col)).withColumn("down", F.lead(trio).over(col))
    return df.select(*dem.columns, "w", "e", F.col("up.w").alias("nw"), F.col("up.elev").alias("n"), F.col("up.e").alias("ne"), F.col("down.w").alias("sw"), F.col("down.elev").alias("s"), F.col("down.e").alias("se"))


def horn(dem: DataFrame) -> DataFrame:
    """dem with slope and aspect in degrees by Horn's 3 x 3 stencil; 0 at the border and beside missing cells.

    Needs the column pixel_size_deg.
    """
    return _sloped(_neighbours(dem), dem.columns)


def _sloped(df: DataFrame, kept: list[str]) -> DataFrame:
    """The columns kept, with slope and aspect from the eight neighbours of df."""
    c = F.col
    scale = 8 * c("pixel_size_deg") * METRES_PER_DEGREE
    dx = ((c("ne") + 2 * c("e") + c("se")) - (c("nw") + 2 * c("w") + c("sw"))) / scale
    dy = ((c("sw") + 2 * c("s") + c("se")) - (c("nw") + 2 * c("n") + c("ne"))) / scale
    df = df.select(*kept, F.coalesce(dx, F.lit(0.0)).alias("dzdx"), F.coalesce(dy, F.lit(0.0)).alias("dzdy"))
    angle = F.degrees(F.atan2(-c("dzdx"), c("dzdy")))
    flat = (c("dzdx") == 0) & (c("dzdy") == 0)
    aspect = F.when(flat, 0.0).when(angle < 0, angle + 360).otherwise(angle)
    return df.withColumn("slope", F.degrees(F.atan(F.sqrt(c("dzdx") * c("dzdx") + c("dzdy") * c("dzdy"))))).withColumn("aspect", aspect)


def central_gradient(dem: DataFrame, metres_per_degree: float = METRES_PER_DEGREE) -> DataFrame:
    """dem with gx and gy by central differences; 0 at the border. metres_per_degree=1 keeps degrees as the unit of length."""
    span = 2 * F.col("pixel_size_deg") * metres_per_degree
    df = _neighbours(dem)
    inside = F.col("n").isNotNull() & F.col("s").isNotNull() & F.col("w").isNotNull() & F.col("e").isNotNull()
    return df.select(*dem.columns, F.when(inside, (F.col("e") - F.col("w")) / span).otherwise(0.0).alias("gx"), F.when(inside, (F.col("s") - F.col("n")) / span).otherwise(0.0).alias("gy"))


def aspect_sector(aspect: Column, slope: Column, flat: float = 2.0) -> Column:
    """0 flat, 1 to 8 for N, NE, ... NW."""
    return F.when(slope < flat, 0).otherwise(F.floor(F.pmod(aspect + 22.5, F.lit(360.0)) / 45).cast("int") + 1)


def elevation_band(elev: Column, height: float = 50.0) -> Column:
    return F.floor(elev / height).cast("int")


def pixel_grid(dem: DataFrame) -> DataFrame:
    """dem with the pixels' lon and lat: evenly spaced from the origin, both ends included.

    Needs origin_lon, origin_lat, pixel_size_deg, rows, cols.
    """
    at = lambda o, i, n: F.col(o) + F.col(i) * F.col("pixel_size_deg") * F.col(n) / (F.col(n) - 1)
    return dem.withColumn("lon", at("origin_lon", "c", "cols")).withColumn("lat", at("origin_lat", "r", "rows"))


def valid_tiles(tiles: DataFrame, least: int = 2) -> DataFrame:
    return tiles.filter((F.col("rows") >= least) & (F.col("cols") >= least))


def explode_grid(tiles: DataFrame) -> DataFrame:
    """The long form (r, c, elev) of tiles with an array of arrays; missing values are null."""
    rows = tiles.select(*(c for c in tiles.columns if c != "elevations"), F.posexplode("elevations").alias("r", "line"))
    return rows.select(*(c for c in rows.columns if c != "line"), F.posexplode("line").alias("c", "elev")).withColumn("elev", F.nanvl("elev", F.lit(None).cast("double")))


def explode_sloped(tiles: DataFrame) -> DataFrame:
    """explode_grid() with slope and aspect as by horn(): neighbours are taken from the tile's own lines, so pixels are
    neither shuffled nor sorted."""
    kept, line = [c for c in tiles.columns if c != "elevations"], lambda r: F.get("elevations", r)
    trios = F.transform("elevations", lambda mid, r: F.struct(line(r - 1).alias("up"), mid.alias("mid"), line(r + 1).alias("down")))
    rows = tiles.select(*kept, F.posexplode(trios).alias("r", "_t")).select(*kept, "r", "_t.*")
    cells = rows.select(*kept, "r", "up", "mid", "down", F.posexplode("mid").alias("c", "elev"))
    at = lambda name, i: F.nanvl(F.get(name, F.col("c") + i), F.lit(None).cast("double"))
    places = {"nw": ("up", -1), "n": ("up", 0), "ne": ("up", 1), "w": ("mid", -1), "e": ("mid", 1), "sw": ("down", -1), "s": ("down", 0), "se": ("down", 1)}
    elev = F.nanvl("elev", F.lit(None).cast("double")).alias("elev")
    return _sloped(cells.select(*kept, "r", "c", elev, *(at(*p).alias(n) for n, p in places.items())), [*kept, "r", "c", "elev"])


def parcel_tiles(parcels: DataFrame, dem: DataFrame, zoom: int) -> DataFrame:
    """parcels (geometry) with each terrain tile (z, x, y) of their bounds; those without any stay out.

    An equi-join on tiles; a parcel is a row for each tile, and only the tile's other columns come along.
    """
    p = geo.computed(parcels, "_b", geo.bounds(F.col("geometry"))).filter("_b is not null").select("*", "_b.*").drop("_b")
    return geo.tile_cover(p, zoom, edges=False).drop("min_lon", "min_lat", "max_lon", "max_lat").join(dem, ["z", "x", "y"])
