"""Stencils and zones over tiles that meet: what lies on both sides of a border counts as on one tile.

Tiles lie in a grid (x to the east, y to the south) and have equal sizes; row 0 of a tile is its southern one. Only
pixels on borders travel: a tile gets a ring of its neighbours' pixels for a stencil, and zones are labelled tile by
tile and joined where equal pixels meet across a border.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators import terrain
from terrafold.operators.graph import connected
from terrafold.operators.zones import components
from terrafold.session import large, written


def with_ring(pixels: DataFrame) -> DataFrame:
    """pixels (x, y, r, c, rows, cols) and, with ring = true, copies of their neighbours' border pixels around each tile.

    A pixel has a copy for each neighbour that it borders on, three in a corner; tiles that aren't there get a ring
    alone, which whoever filters by ring drops.
    """
    step = lambda at, size: F.when(F.col(at) == 0, F.array(F.lit(0), F.lit(-1))).when(F.col(at) == F.col(size) - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    one = (F.col("rows") == 1) | (F.col("cols") == 1)
    wide = lambda at, size: F.when(one, F.array(F.lit(0), F.lit(-1), F.lit(1))).otherwise(step(at, size))
    east, north = F.explode(wide("c", "cols")).alias("_east"), F.explode(wide("r", "rows")).alias("_north")
    copies = pixels.select("*", east).select("*", north)
    moved = {"x": F.col("x") + F.col("_east"), "y": F.col("y") - F.col("_north"), "c": F.col("c") - F.col("_east") * F.col("cols"), "r": F.col("r") - F.col("_north") * F.col("rows")}
    return copies.withColumns({**moved, "ring": (F.col("_east") != 0) | (F.col("_north") != 0)}).drop("_east", "_north")


def horn(dem: DataFrame) -> DataFrame:
    """terrain.horn over all tiles (x, y) at once: only the outermost pixels have no neighbours."""
    kept = dem.columns
    ringed = with_ring(dem).withColumn("tile_id", F.struct("x", "y"))
    return terrain.horn(ringed.filter(_near())).filter("not ring").select(*(c for c in kept if c != "tile_id"), "slope", "aspect")


def _near():
    """A ring is one pixel wide; in tiles of one row or column copies may land beyond it."""
    return (F.col("r") >= -1) & (F.col("r") <= F.col("rows")) & (F.col("c") >= -1) & (F.col("c") <= F.col("cols"))


def zones(classed: DataFrame, min_pixels: int = 50) -> DataFrame:
    """x, y, r, c, zone_x, zone_y, label, pixel_count: 4-connected pixels of equal band and sector, across tiles.

    A zone is named by its smallest tile and the label that it has there; pixels of band 0 and sector 0, and of zones of
    fewer than min_pixels pixels in all, have label 0. Needs x, y, r, c, rows, cols, band, sector.
    """
    px = written(classed.select(*(F.col(c).cast("int").alias(c) for c in ("x", "y", "r", "c", "rows", "cols", "band", "sector"))).filter("band is not null and sector is not null"))
    tile = F.shiftleft(F.col("x").cast("long"), 32).bitwiseOR(F.col("y").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    own = components(px.withColumn("tile_id", tile).select("tile_id", "r", "c", "band", "sector"), min_pixels=1)
    labelled = written(px.withColumn("tile_id", tile).join(large(own), ["tile_id", "r", "c"]).drop("tile_id"))
    # Where two tiles meet: the pixel in the east or north is moved to the tile that it borders on and met there.
    border = lambda cond, moved: labelled.filter(cond).select(*(e.alias(n) for n, e in moved.items()), "band", "sector", F.struct("x", "y", "label").alias("b"))
    x, y, r, c = (F.col(n) for n in ("x", "y", "r", "c"))
    west = border(c == 0, {"x": x - 1, "y": y, "r": r, "c": F.col("cols") - 1})
    south = border(r == 0, {"x": x, "y": y + 1, "r": F.col("rows") - 1, "c": c})
    met = labelled.filter("label > 0 and (c = cols - 1 or r = rows - 1)").select("x", "y", "r", "c", "band", "sector", F.struct("x", "y", "label").alias("a"))
    edges = met.join(large(west.unionByName(south).filter("b.label > 0")), ["x", "y", "r", "c", "band", "sector"]).select("a", "b").distinct()
    roots = connected(edges)
    zone = F.struct("x", "y", "label")
    sizes = labelled.filter("label > 0").groupBy(zone.alias("node")).agg(F.count(F.lit(1)).alias("n"))
    whole = written(sizes.join(large(roots), "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = written(whole.join(large(whole.groupBy("root").agg(F.sum("n").alias("pixel_count"))), "root").filter(F.col("pixel_count") >= min_pixels).select("node", "root", "pixel_count"))
    out = labelled.withColumn("node", zone).join(large(named), "node", "left")
    zero = lambda v: F.coalesce(v, F.lit(0))
    return out.select("x", "y", "r", "c", F.col("root.x").alias("zone_x"), F.col("root.y").alias("zone_y"), zero(F.col("root.label")).alias("label"), zero(F.col("pixel_count")).alias("pixel_count"))
