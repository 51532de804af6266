"""Connected terrain zones of tiles and their summaries."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions import geo, physics
from terrafold.functions.entities import sector_name
from terrafold.operators.terrain import aspect_sector, elevation_band
from terrafold.session import large

HECTARES_PER_PIXEL = 0.01


def classed(pixels: DataFrame, band: float = 50.0, flat: float = 2.0) -> DataFrame:
    """pixels with band and sector."""
    return pixels.withColumn("band", elevation_band(F.col("elev"), band)).withColumn("sector", aspect_sector(F.col("aspect"), F.col("slope"), flat))


def _roots(r: np.ndarray, c: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Smallest index of each pixel's 4-connected component of one kind: rounds of minima over neighbours and of jumps."""
    height, width = int(r.max()) + 1, int(c.max()) + 1
    place = np.full((height, width), -1)
    place[r, c] = np.arange(len(r))
    pairs = []
    for a, b in ((place[1:], place[:-1]), (place[:, 1:], place[:, :-1])):
        both = (a >= 0) & (b >= 0)
        x, y = a[both], b[both]
        same = kind[x] == kind[y]
        pairs.append((x[same], y[same]))
    x, y = (np.concatenate(p) for p in zip(*pairs))
    root = np.arange(len(r))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(pixels: DataFrame, min_pixels: int = 50) -> DataFrame:
    """tile_id, r, c, label: 4-connected pixels of equal (band, sector), labels 1, 2, ... in each tile.

    Labels go by band, sector and the first pixel in row order. Components with fewer pixels than min_pixels have
    label 0, as do pixels of band 0 and sector 0. A task holds one tile (65,536 pixels at most in a map tile of 256).
    """

    def label(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.dropna(subset=["band", "sector"]).sort_values(["r", "c"], ignore_index=True)
        out = tile[["tile_id", "r", "c"]].assign(label=0)
        if not len(tile):
            return out
        band, sector = tile["band"].to_numpy(np.int64), tile["sector"].to_numpy(np.int64)
        root = _roots(tile["r"].to_numpy(np.int64), tile["c"].to_numpy(np.int64), band * 16 + sector)
        size = np.bincount(root, minlength=len(root))
        first = np.unique(root)
        kept = first[(size[first] >= min_pixels) & ~((band[first] == 0) & (sector[first] == 0))]
        kept = kept[np.lexsort((kept, sector[kept], band[kept]))]
        number = np.zeros(len(root), np.int32)
        number[kept] = np.arange(1, len(kept) + 1)
        return out.assign(label=number[root])

    narrow = pixels.select(F.col("tile_id").cast("long").alias("tile_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "band", "sector")
    return narrow.groupBy("tile_id").applyInPandas(label, "tile_id long, r int, c int, label int")


def dominant_sector(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sector: the most frequent one, of several the smallest."""
    counted = labelled.groupBy(*keys, "sector").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.min_by("sector", F.struct(-F.col("n"), F.col("sector"))).alias("sector"))


def summaries(labelled: DataFrame) -> DataFrame:
    """A row for each (tile_id, label > 0): elevations, pixel count, centre, mean aspect, area, dominant sector and its name.

    Needs elev, aspect, lon, lat, sector.
    """
    keys = ["tile_id", "label"]
    found = labelled.filter("label > 0")
    c = F.col
    stats = found.groupBy(*keys).agg(
        F.avg("elev").alias("elevation_mean"), F.min("elev").alias("elevation_min"), F.max("elev").alias("elevation_max"), F.count(F.lit(1)).alias("pixel_count"),
        F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.avg("aspect").alias("aspect_mean"),
    )
    out = stats.join(large(dominant_sector(found, keys)), keys)
    return out.withColumn("aspect_sector", sector_name(c("sector"))).withColumn("area_ha", c("pixel_count") * HECTARES_PER_PIXEL)


def zone_id(summary: DataFrame, band: float = 50.0) -> DataFrame:
    """summary with zone_id: geohash of the centre, band of the mean elevation, sector of the mean aspect."""
    c = F.col
    sector = F.pmod(F.rint(c("aspect_mean") / 45), F.lit(8.0)).cast("int") + 1
    return summary.withColumn("zone_id", F.concat(F.lit("z"), geo.geohash(c("lon"), c("lat")), F.lit("-e"), (c("elevation_mean") / band).cast("int").cast("string"), F.lit("-"), sector.cast("string")))


def largest(summary: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The n zones with the most pixels of each key, with their rank; ties go by tile and label."""
    w = W.partitionBy(*keys).orderBy(F.desc("pixel_count"), "tile_id", "label")
    return summary.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def zone_metrics(summary: DataFrame) -> DataFrame:
    """summary, joined with its weather before, with t_min, t_max and eto at the zone's mean elevation; radiation as measured."""
    c = F.col
    t = lambda name: physics.lapse_temperature(c(name), c("elevation_m"), c("elevation_mean"))
    low, high = t("t_min"), t("t_max")
    eto = physics.evapotranspiration((low + high) / 2, low, high, c("solar_rad_w_m2"), c("wind_speed_ms"), c("rh_avg"), c("elevation_mean"))
    return summary.withColumn("zone_t_min", low).withColumn("zone_t_max", high).withColumn("zone_eto", eto)
