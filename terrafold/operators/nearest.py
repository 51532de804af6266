"""Nearest neighbours on the globe: each left point's nearest right point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.geo import EARTH_M, haversine_m
from terrafold.session import cut

#: Right sides of at most so many positions are broadcast, after they are counted.
BROADCAST_ROWS = 200
#: Positions that a cell of the grid holds before it is split; cells that a search begins with; levels of the grid, each
#: with a quarter of the width before (the last one's cells are 2 m wide).
CAP, FIRST, LEVELS = 32, 64, 12
#: More than the errors of a dot product of unit vectors, and of distances (m) that are computed from one.
ROUNDING, SLACK_M = 1e-13, 0.5


def nearest(left: DataFrame, right: DataFrame, key: str, right_id: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """left with right_id and distance_m (1 place) of the nearest right point; ties go to the smallest right_id.

    Both need lon and lat. Points without a position stay, without a neighbour; keys may be null or repeat. A small
    right side (counted first) is broadcast as one array and every left row searches it, so no pair is a row. A larger
    one is searched by a grid that is finer where there are more points. The results are the same.
    """
    r = right.filter("lon is not null and lat is not null").groupBy(F.col("lon").alias("rlon"), F.col("lat").alias("rlat")).agg(F.min(right_id).alias("id"))
    r = cut(r)
    n = r.count()
    if n == 0:
        return left.withColumn(right_id, F.lit(None).cast(right.schema[right_id].dataType)).withColumn("distance_m", F.lit(None).cast("double"))
    if n <= rows:
        points = _with_vector(r, "rlon", "rlat", "r").agg(F.collect_list(F.struct("id", "rlon", "rlat", "rx", "ry", "rz")).alias("points"))
        best = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), _closest("points"))
        every = _with_vector(left.withColumn("_row", F.struct(*left.columns)), "lon", "lat", "p").join(F.broadcast(points))
        return every.withColumn("best", best).select("_row.*", F.col("best.id").alias(right_id), F.round("best.d", 1).alias("distance_m"))
    found = _by_grid(left.filter("lon is not null and lat is not null").select("lon", "lat").distinct(), r)
    found = found.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.col("best.id").alias(right_id), F.round("best.d", 1).alias("distance_m"))
    return left.join(found, (F.col("lon") == F.col("_lon")) & (F.col("lat") == F.col("_lat")), "left").drop("_lon", "_lat")


def _with_vector(df: DataFrame, lon: str, lat: str, to: str) -> DataFrame:
    """df with the position on the unit sphere: the nearest of two points has the larger dot product."""
    x, y = F.radians(F.col(lon).cast("double")), F.radians(F.col(lat).cast("double"))
    return df.withColumns({f"{to}x": F.cos(y) * F.cos(x), f"{to}y": F.cos(y) * F.sin(x), f"{to}z": F.sin(y)})


def _dot(x: Column, y: Column, z: Column) -> Column:
    return F.col("px") * x + F.col("py") * y + F.col("pz") * z


def _closest(points: str) -> Column:
    """struct(dot, d, id) of the row's nearest point of an array (id, rlon, rlat, rx, ry, rz), by distance and then id.

    Distances are computed only where the dot product, less its rounding, may be the largest.
    """
    none = F.struct(F.lit(-2.0).alias("dot"), F.lit(float("inf")).alias("d"), F.expr(f"{points}[0].id").alias("id"))

    def step(best: Column, p: Column) -> Column:
        dot = _dot(p["rx"], p["ry"], p["rz"])
        d = haversine_m(F.col("lon"), F.col("lat"), p["rlon"], p["rlat"])
        both = F.least(F.struct(best["d"].alias("d"), best["id"].alias("id")), F.struct(d.alias("d"), p["id"].alias("id")))
        return F.when(dot < best["dot"] - ROUNDING, best).otherwise(F.struct(F.greatest(best["dot"], dot).alias("dot"), both["d"].alias("d"), both["id"].alias("id")))

    return F.aggregate(points, none, step)


def _on_map(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The same place with a latitude from -90 to 90: past a pole it goes down on the other side."""
    turn = F.pmod(lat + 180.0, F.lit(360.0)) - 180.0
    within, over = F.abs(lat) <= 90.0, F.abs(turn) > 90.0
    return F.when(within | ~over, lon).otherwise(lon + 180.0), F.when(within, lat).when(over, F.signum(turn) * 180.0 - turn).otherwise(turn)


def _cell(lon: Column, lat: Column, level: Column | int) -> Column:
    """The cell of a position at a level; longitude 180 is -180."""
    n = F.pow(F.lit(4.0), F.lit(level) if isinstance(level, int) else level)
    at = lambda degrees: F.least(F.floor(degrees / 360.0 * n), n.cast("long") - 1)
    return F.shiftleft(at(F.pmod(lon + 180.0, F.lit(360.0))), 32).bitwiseOR(at(lat + 90.0))


def _parent(cell: Column) -> Column:
    return F.shiftleft(F.shiftright(cell, 34), 32).bitwiseOR(F.shiftright(cell.bitwiseAND(F.lit(0xFFFFFFFF)), 2))


def _least(lon: Column, lat: Column, cell: Column, level: int) -> Column:
    """No point of the cell is closer than this."""
    w = 360.0 / 4**level
    x, y = (F.shiftright(cell, 32) + 0.5) * w - 180.0, (cell.bitwiseAND(F.lit(0xFFFFFFFF)) + 0.5) * w - 90.0
    aside, apart = F.abs(F.pmod(lon - x + 180.0, F.lit(360.0)) - 180.0) - w / 2, F.abs(lat - y) - w / 2
    half = lambda degrees: F.pow(F.sin(F.radians(F.greatest(degrees, F.lit(0.0))) / 2), 2)
    narrow = F.cos(F.radians(F.least(F.abs(y) + w / 2, F.lit(90.0))))
    return F.greatest(F.lit(0.0), 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), half(apart) + F.cos(F.radians(lat)) * narrow * half(aside)))) * (1 - 1e-9) - 0.001)


def _by_grid(positions: DataFrame, r: DataFrame) -> DataFrame:
    """lon, lat, best (d, id): the search goes from wide cells to narrow ones, all positions at once.

    A cell's own sample point bounds the distance from above, its edges from below; cells that can't hold the nearest
    point are left. So few cells are open for a position at a time, however many points there are and wherever they lie.
    """
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), _cell(*_on_map(F.col("rlon"), F.col("rlat")), k).alias("cell")) for k in range(LEVELS + 1))))
    nodes = r.select(levels.alias("at"), "rlon", "rlat").groupBy("at.level", "at.cell").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rlon", "rlat")).alias("one"))
    nodes = cut(nodes)
    sizes = {x.level: (x.cells, x.most) for x in nodes.groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.max("n").alias("most")).collect()}  # a row for each level
    first = max(k for k in sizes if sizes[k][0] <= FIRST or k == 0)
    last = min([k for k in sizes if k >= first and sizes[k][1] <= CAP], default=LEVELS)
    to = lambda one: haversine_m(F.col("lon"), F.col("lat"), one["rlon"], one["rlat"])
    opened = lambda k: lambda x: F.struct(F.lit(k).alias("level"), x["cell"].alias("cell"), x["n"].alias("n"), _least(*_on_map(F.col("lon"), F.col("lat")), x["cell"], k).alias("least"))
    # The first cells (FIRST at most) are compared by dot products: with their points, then with their centres, from
    # which no point of a cell is farther than the cell is wide. What is derived from both is cut, so that Spark
    # doesn't move it into conditions that would compute it again for each cell.
    wide = 360.0 / 4**first
    centre = {"clon": (F.shiftright("cell", 32) + 0.5) * wide - 180.0, "clat": (F.col("cell").bitwiseAND(F.lit(0xFFFFFFFF)) + 0.5) * wide - 90.0}
    firsts = _with_vector(nodes.filter(F.col("level") == first).withColumns(centre | {"slon": F.col("one.rlon"), "slat": F.col("one.rlat")}), "slon", "slat", "s")
    firsts = F.broadcast(_with_vector(firsts, "clon", "clat", "c").agg(F.collect_list(F.struct("cell", "n", "sx", "sy", "sz", "cx", "cy", "cz")).alias("cells")))
    vectors = _with_vector(positions, "lon", "lat", "p")
    top = F.array_max(F.transform("cells", lambda c: _dot(c["sx"], c["sy"], c["sz"])))
    at = cut(vectors.join(firsts).select("lon", "lat", "px", "py", "pz", top.alias("top")))
    chord = F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("top")) / 2))
    at = at.withColumn("most", 2 * EARTH_M * F.asin(F.least(F.lit(1.0), chord)) + SLACK_M)
    at = at.withColumn("reach", F.cos(F.least(F.lit(3.14159265), F.col("most") / EARTH_M + F.radians(F.lit(wide)))))
    held = F.filter("cells", lambda c: _dot(c["cx"], c["cy"], c["cz"]) >= F.col("reach") - ROUNDING)
    at = cut(at.join(firsts).select("lon", "lat", "most", F.transform(held, opened(first)).alias("open")))
    near = lambda a: a.select("lon", "lat", "most", F.filter("open", lambda x: x["least"] <= F.col("most")).alias("open"))
    at = near(at)
    for k in range(first, last):
        # Cells of this level with more than CAP points give way to their parts; all others stay.
        each = at.select("lon", "lat", "most", F.explode("open").alias("x"))
        split = each.filter((F.col("x.level") == k) & (F.col("x.n") > CAP)).withColumn("parent", F.col("x.cell"))
        parts = nodes.filter(F.col("level") == k + 1).withColumn("parent", _parent(F.col("cell"))).select("parent", F.struct("cell", "n").alias("y"), "one")
        parts = split.join(parts, "parent").select("lon", "lat", F.least("most", to(F.col("one"))).alias("most"), opened(k + 1)(F.col("y")).alias("x"))
        stay = each.filter((F.col("x.level") != k) | (F.col("x.n") <= CAP)).select("lon", "lat", "most", "x")
        at = near(cut(parts.unionByName(stay).groupBy("lon", "lat").agg(F.min("most").alias("most"), F.collect_list("x").alias("open"))))
    # Points of a cell that can't be split go in parts of a bounded size.
    leaves = nodes.filter(f"n <= {CAP} or level = {last}").select("level", "cell", "n")
    known = _with_vector(r, "rlon", "rlat", "r")
    held = known.select(levels.alias("at"), "rlon", "rlat", "id", "rx", "ry", "rz").select("at.level", "at.cell", "rlon", "rlat", "id", "rx", "ry", "rz").filter(f"level between {first} and {last}").join(leaves, ["level", "cell"])
    held = held.groupBy("level", "cell", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CAP)).alias("part")).agg(F.collect_list(F.struct("rlon", "rlat", "id", "rx", "ry", "rz")).alias("points")).drop("part")
    pairs = at.select("lon", "lat", F.explode("open").alias("x")).select("lon", "lat", "x.level", "x.cell")
    pairs = _with_vector(pairs, "lon", "lat", "p").join(held, ["level", "cell"])
    found = pairs.select("lon", "lat", _closest("points").alias("best"))
    return found.groupBy("lon", "lat").agg(F.min(F.struct("best.d", "best.id")).alias("best"))
