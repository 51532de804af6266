"""Colour scales: palettes, lookup tables of 256 steps and colours of values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stops of each scale as (value, red, green, blue); alpha is 255.
PALETTES = {
    "temperature_avg": ((-5, 20, 20, 120), (0, 50, 80, 200), (10, 100, 180, 230), (20, 200, 220, 100), (30, 240, 150, 50), (40, 220, 60, 30), (45, 150, 0, 0)),
    "temperature_min": ((-10, 50, 0, 100), (0, 100, 80, 180), (10, 180, 200, 100), (20, 240, 180, 50), (30, 220, 80, 20)),
    "solar_radiation": ((0, 80, 80, 80), (200, 140, 140, 100), (500, 220, 220, 80), (800, 255, 240, 60), (1000, 255, 255, 200)),
    "eto": ((0, 50, 180, 50), (3, 100, 200, 80), (6, 200, 200, 50), (10, 220, 120, 40), (15, 200, 40, 30)),
    "water_balance": ((-30, 180, 0, 0), (-15, 220, 80, 30), (-5, 240, 200, 80), (5, 200, 220, 180), (15, 100, 200, 180), (30, 0, 100, 200)),
    "frost_risk": ((0, 50, 180, 50), (25, 180, 200, 50), (50, 220, 180, 40), (75, 240, 100, 30), (100, 180, 0, 0)),
    "soil_moisture": ((0, 120, 60, 20), (15, 180, 140, 60), (30, 100, 180, 100), (40, 60, 160, 200), (50, 20, 80, 200)),
}


def palette(spark: SparkSession) -> DataFrame:
    rows = [(m, k, float(v), r, g, b, 255) for m, stops in PALETTES.items() for k, (v, r, g, b) in enumerate(stops)]
    return spark.createDataFrame(rows, "metric string, stop int, value double, r int, g int, b int, a int")


def lookup_table(stops: DataFrame, steps: int = 256) -> DataFrame:
    """metric, idx, r, g, b, a: the stops interpolated at evenly spaced values, rounded half to even."""
    ends = stops.groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.array_sort(F.collect_list(F.struct("value", "r", "g", "b", "a"))).alias("stops"))
    at = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("idx")).withColumn("v", F.col("low") + (F.col("high") - F.col("low")) * F.col("idx") / (steps - 1))
    left = F.element_at(F.filter("stops", lambda s: s["value"] <= F.col("v")), -1)
    right = F.element_at(F.concat(F.filter("stops", lambda s: s["value"] > F.col("v")), F.slice("stops", -1, 1)), 1)
    at = at.withColumn("s", left).withColumn("t", right)
    share = F.when(F.col("t.value") > F.col("s.value"), (F.col("v") - F.col("s.value")) / (F.col("t.value") - F.col("s.value"))).otherwise(0.0)
    return at.select("metric", "idx", *(F.rint(F.col(f"s.{c}") + (F.col(f"t.{c}") - F.col(f"s.{c}")) * share).cast("int").alias(c) for c in "rgba"))


def colour_index(value: Column, low: Column, high: Column) -> Column:
    """0 to 255; null for null, NaN and infinite values."""
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint((value - low) / (high - low) * 255)))).cast("int")


def colorize(pixels: DataFrame, stops: DataFrame) -> DataFrame:
    """pixels with r, g, b, a; transparent black where there is no value. An unknown metric raises when it is run.

    The table has 256 rows a metric, known beforehand, so it is broadcast.
    """
    ranges = stops.groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    known = pixels.join(F.broadcast(ranges), "metric", "left")
    known = known.withColumn("idx", colour_index(F.col("value"), F.col("low"), F.col("high")))
    coloured = known.join(F.broadcast(lookup_table(stops)), ["metric", "idx"], "left")
    unknown = F.raise_error(F.concat(F.lit("unknown metric: "), F.coalesce("metric", F.lit("null")))).cast("int")
    return coloured.select(*pixels.columns, *(F.when(F.col("low").isNull(), unknown).otherwise(F.coalesce(c, F.lit(0))).alias(c) for c in "rgba"))
