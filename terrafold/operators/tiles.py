"""Tile images: windows, mosaics, pyramids and PNG bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def padded(pixels: DataFrame, keys: list[str], size: int = 256) -> DataFrame:
    """The top left size x size pixels of each tile; places without a pixel have a null value."""
    top = pixels.filter((F.col("r") < size) & (F.col("c") < size)).select(*keys, "r", "c", "value")
    cell = lambda n: F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(n)
    grid = pixels.select(*keys).distinct().select(*keys, cell("r")).select(*keys, "r", cell("c"))
    return grid.join(top.withColumns({n: F.col(n).cast("int") for n in ("r", "c")}), [*keys, "r", "c"], "left")


def mosaic(pixels: DataFrame, size: int, order: str = "ord") -> DataFrame:
    """x, y, value of pixels of all tiles in one grid; where tiles overlap the first valid value by order counts."""
    gx, gy = F.col("x") * size + F.col("c"), F.col("y") * size + F.col("r")
    valid = pixels.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return valid.groupBy(gx.alias("gx"), gy.alias("gy")).agg(F.min_by("value", order).alias("value"))


def pyramid_level(grid: DataFrame) -> DataFrame:
    """gx, gy, value one zoom level up: means of 2 x 2 pixels."""
    half = lambda n: F.floor(F.col(n) / 2).alias(n)
    return grid.groupBy(half("gx"), half("gy")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def pyramid(grid: DataFrame, z: int, up: int = 2, down: int = 1) -> DataFrame:
    """z, gx, gy, value, n of a grid at level z, of the levels above it (means of 2 x 2) and below it (each pixel as 2 x 2)."""
    same = grid.select(F.lit(z).alias("z"), "gx", "gy", "value", F.when(F.col("value").isNotNull(), 1).otherwise(0).cast("long").alias("n"))
    out, at = same, same
    for k in range(1, up + 1):
        # From sums of the pixels below, so that places without a value weigh nothing.
        at = at.groupBy(F.floor(F.col("gx") / 2).alias("gx"), F.floor(F.col("gy") / 2).alias("gy")).agg((F.sum(F.col("value") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("value"), F.sum("n").alias("n"))
        at = at.select(F.lit(z - k).alias("z"), "gx", "gy", "value", "n")
        out = out.unionByName(at)
    at = same
    half = lambda n: F.explode(F.array(F.col(n) * 2, F.col(n) * 2 + 1)).alias(n)
    for k in range(1, down + 1):
        at = at.select(F.lit(z + k).alias("z"), half("gx"), "gy", "value", "n").select("z", "gx", half("gy"), "value", "n")
        out = out.unionByName(at)
    return out


def rgba_tiles(coloured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, width, height, rgba: four bytes a pixel, row by row, of coloured pixels (r, c and red, green, blue, alpha as cr, cg, cb, ca)."""
    digits = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in ("cr", "cg", "cb", "ca")))
    joined = lambda name: F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "v"))), lambda x: x["v"]), ""))
    lines = coloured.select(*keys, "r", "c", digits.alias("v")).groupBy(*keys, "r").agg(joined("c").alias("line"), F.count(F.lit(1)).cast("int").alias("width"))
    hexed = lines.select(*keys, "r", F.hex("line").alias("v"), "width")
    return hexed.groupBy(*keys).agg(F.max("width").alias("width"), F.count(F.lit(1)).cast("int").alias("height"), joined("r").alias("rgba"))


def _png(rows: list[bytes], width: int) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def png_tiles(coloured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, png: images of coloured pixels (r, c and red, green, blue, alpha as cr, cg, cb, ca)."""

    @F.pandas_udf("binary")
    def encode(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rgba, width in parts:
            yield pd.Series([_png([bytes(x[i : i + 4 * w]) for i in range(0, len(x), 4 * w)], w) for x, w in zip(rgba, width)])

    return rgba_tiles(coloured, keys).select(*keys, encode("rgba", "width").alias("png"))
