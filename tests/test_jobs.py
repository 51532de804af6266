from datetime import date

import pytest
from pyspark.sql import functions as F
from terrafold import jobs
from terrafold.functions import geo
from terrafold.functions.physics import METRICS
from terrafold.operators import terrain, zonal
from terrafold.plans import job_queries as J
from terrafold.plans import views as V
from terrafold.sources import stores, versions

from tests.oracle import connect, difference
from tests.test_queries import decoded


@pytest.mark.parametrize("name", sorted(J.oracle_sql()))
def test_jobs_equal_their_sql(spark, sf_dir, name):
    assert difference(J.queries()[name](spark, sf_dir), connect(sf_dir), J.oracle_sql()[name]) is None


@pytest.fixture(scope="module")
def store(spark, sf_dir):
    return J._stored(spark, sf_dir)


def test_jobs_equal_their_sql_past_the_maps_northern_edge(spark, sf_dir, tmp_path):
    """Tiles of one row there share an id: soil is the row's first parcel's, as mean and lowest values are the row's."""
    keys = F.col("k").between(532_000, 532_025) | F.col("k").between(560_000, 560_004) | F.col("k").between(640_000, 640_003)
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        one = spark.read.parquet(f"{sf_dir}/{name}.parquet").drop(key).limit(1)
        spark.range(10**6).withColumnRenamed("id", "k").filter(keys).crossJoin(one).withColumnRenamed("k", key).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.read.parquet(f"{sf_dir}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = connect(tmp_path / "none")
    for name in ("customer", "part", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("job_rasters", "job_records"):
        assert difference(J.queries()[name](spark, str(tmp_path)), con, J.oracle_sql()[name]) is None


def test_a_stored_row_is_a_tile(spark, store):
    """So the raster job and the statistics of parcels shuffle tiles, never their pixels."""
    rows, px = spark.read.parquet(f"{store}/rasters"), stores.read_rasters(spark, f"{store}/rasters", J.TENANT)
    tiles = px.select("metric", "z", "x", "y").distinct().count()
    assert rows.count() == tiles and px.count() == tiles * J.SIDE**2 and rows.filter("places is not null").count() == 0


def test_pixels_of_parcels_come_from_whole_and_partial_tiles(spark, tmp_path):
    """As they do by pixel: tiles that are whole, lack pixels, have one twice, or aren't there for a metric."""
    rows = [("t", m, J.ON, 0, x, 0, r, c, float(100 * x + 10 * r + c), float(x), 0.0, x + 1.0, 1.0, 4, 4) for m in ("eto", "frost_risk") for x in range(3) for r in range(4) for c in range(4)]
    rows = [v for v in rows if not (v[4] == 1 and (v[6] + v[7]) % 2 or v[4] == 2 and v[1] == "eto")] + [v for v in rows if v[4] == 1 and v[6] == v[7]]
    px = spark.createDataFrame(rows, stores.RASTER.replace("value float", "value double") + ", west double, south double, east double, north double, rows int, cols int")
    stores.write_rasters(px, str(tmp_path))
    assert sorted(map(tuple, stores.read_rasters(spark, str(tmp_path), "t", bounds=True).select(px.columns).collect())) == sorted(rows)
    shapes = spark.createDataFrame([("a", 0.9, 0.4, 0.3), ("b", 1.5, 0.5, 0.25), ("c", 2.1, 0.1, 0.9), ("d", 7.0, 0.5, 0.1)], "id string, lon double, lat double, half double")
    ring = F.concat_ws(",", *(F.format_string("[%.3f,%.3f]", F.col("lon") + i * F.col("half"), F.col("lat") + j * F.col("half")) for i, j in ((-1, -1), (1, -1), (0, 1), (-1, -1))))
    shapes = shapes.select("id", F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")).alias("geometry"), F.lit(0).alias("z"), F.explode(F.array(*map(F.lit, range(3)))).alias("x"), F.lit(0).alias("y"))
    got = jobs.parcel_pixels(shapes, stores.read_tiles(spark, str(tmp_path), "t"))
    cells = px.withColumns({"x0": F.col("west") + F.col("c") / 4, "y1": F.col("north") - F.col("r") / 4}).withColumns({"x1": F.col("x0") + 0.25, "y0": F.col("y1") - 0.25})
    want = zonal.pixels_of_parcels(cells, shapes).select("id", "metric", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


def test_tiles_are_rendered_from_the_store(spark, sf_dir, store):
    path, pointers = f"{store}/rasters", f"{store}/pointers"
    x, y = J.dem(spark, sf_dir).select("x", "y").orderBy("x", "y").first()
    found = jobs.render_tile(spark, path, pointers, J.TENANT, "eto", 14, x, y, size=24).collect()
    assert [(r.z, r.x, r.y) for r in found] == [(14, x, y)]
    width, height, rgba = decoded(bytes(found[0].png))
    assert (width, height) == (24, 24) and rgba[3] == 255 and rgba[-1] == 0  # what lies outside of the raster is transparent
    assert jobs.render_tile(spark, path, pointers, J.TENANT, "eto", 14, 0, 0).count() == 0
    assert jobs.render_tile(spark, path, pointers, "nobody", "eto", 14, x, y).count() == 0
    with pytest.raises(ValueError, match="unknown metric"):
        jobs.render_tile(spark, path, pointers, J.TENANT, "nope", 14, x, y)


def test_statistics_of_unknown_metrics_days_and_parcels_are_errors(spark, sf_dir, store):
    path, pointers = f"{store}/rasters", f"{store}/pointers"
    far = spark.createDataFrame([("far",)], "id string").select("id", geo.square(F.lit(120.0), F.lit(-30.0)).alias("geometry"))
    some = J.parcels(spark, sf_dir).limit(3).unionByName(far)
    got = {(r.id, r.metric): r.error for r in jobs.zonal_stats(some, path, pointers, J.TENANT, ("eto", "nope")).collect()}
    assert len(got) == 8 and got["far", "eto"] == "no pixels" and {e for (_, m), e in got.items() if m == "nope"} == {"unknown metric: nope"}
    assert {r.error for r in jobs.zonal_stats(some, path, pointers, J.TENANT, ("eto",), on=date(2020, 1, 1)).collect()} == {"no pixels"}
    assert {r.error for r in jobs.zonal_stats(some, path, pointers, "nobody", ("eto",)).collect()} == {"no pixels"}


def test_slopes_from_a_tiles_lines_equal_those_by_windows(spark):
    nan = float("nan")
    grids = [(k, 0.5, [[(7.0 * r * r + 3 * c * k) % 11 if (r + c + k) % 5 else (nan if c % 2 else None) for c in range(6)] for r in range(5)]) for k in range(4)] + [(9, 0.5, [[1.0]])]
    tiles = spark.createDataFrame(grids, "tile_id long, pixel_size_deg double, elevations array<array<double>>")
    columns = ("tile_id", "r", "c", "elev", "slope", "aspect")
    got, want = (sorted(map(tuple, df.select(*columns).collect()), key=str) for df in (terrain.explode_sloped(tiles), terrain.horn(terrain.explode_grid(tiles))))
    assert got == want and len(got) == 121


def test_records_are_kept_once(spark, sf_dir, store, tmp_path):
    stats = jobs.zonal_stats(J.parcels(spark, sf_dir).limit(5), f"{store}/rasters", f"{store}/pointers", J.TENANT, ("eto",))
    assert jobs.persist_zonal_stats(stats, str(tmp_path), "t", J.AT) == 5
    assert jobs.persist_zonal_stats(stats, str(tmp_path), "t", J.AT) == 0
    assert versions.versions(spark, str(tmp_path)) == [0] and versions.read(spark, str(tmp_path)).count() == 5


def test_a_run_without_parcels_or_terrain_moves_nothing(spark, sf_dir, tmp_path):
    none = J.parcels(spark, sf_dir).limit(0)
    at = [str(tmp_path / n) for n in ("rasters", "pointers")]
    assert jobs.rasters(none, J.dem(spark, sf_dir), J.weather(spark, sf_dir), V.soil(spark, sf_dir), *at, "t", J.ON) == dict.fromkeys(METRICS, 0)
    assert stores.read_pointers(spark, at[1], "t") == {}


def test_zones_are_those_of_the_parcels_tiles(spark, sf_dir, tmp_path):
    parcels, dem = J.parcels(spark, sf_dir).limit(4), J.dem(spark, sf_dir)
    table = jobs.zone_table(parcels, dem, J.weather(spark, sf_dir), V.devices(spark, sf_dir), J.ON, min_pixels=10, most=3).collect()
    px = jobs.pixels_of_tiles(jobs.tiles_of(parcels).select("z", "x", "y").distinct(), dem)
    pixels = {}
    for r in px.select("tile_id", "elev").collect():
        pixels.setdefault(r.tile_id, []).append(r)
    assert table and {r.tile_id for r in table} <= set(pixels)
    of = {}
    for r in table:
        of.setdefault(r.id, []).append(r)
    for rows in of.values():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 3
        assert [r.pixel_count for r in rows] == sorted((r.pixel_count for r in rows), reverse=True)
        for r in rows:
            low, high = min(p.elev for p in pixels[r.tile_id]), max(p.elev for p in pixels[r.tile_id])
            assert low <= r.elevation_min <= r.elevation_mean <= r.elevation_max <= high and r.pixel_count >= 10 and r.distance_m is not None
    df = jobs.zone_table(parcels, dem, J.weather(spark, sf_dir), V.devices(spark, sf_dir), J.ON, min_pixels=10, most=3)
    n = jobs.zones(df, str(tmp_path), "t", J.AT)
    assert jobs.zones(df, str(tmp_path), "t", "2024-01-16T06:00:00Z") == n
    now = versions.read(spark, str(tmp_path))
    assert now.count() == n and {r.observed_at for r in now.collect()} == {"2024-01-16T06:00:00Z"}


def test_the_forecast_nearest_to_a_parcels_centre(spark):
    place = lambda x, y: geo.square(F.lit(x), F.lit(y))
    known = spark.range(1).select(F.lit(V.URN + "7").alias("id"), place(-2.0, 43.0).alias("location"))
    day = "array<struct<date: string, eto_mm: double, precip_mm: double>>"
    points = spark.createDataFrame([(1, -1.0, 43.0, [("2024-01-01", 9.0, 9.0)]), (2, -2.1, 43.1, [("2024-01-01", 1.5, None), ("2024-01-02", 2.0, 4.0)])], f"point long, lon double, lat double, forecast {day}")
    got = jobs.forecast_et0(known, "7", points).orderBy("day").collect()
    assert [(r.day, r.et0, r.precip, r.deficitAfter) for r in got] == [("2024-01-01", 1.5, 0.0, 0.0), ("2024-01-02", 2.0, 4.0, 0.0)]
    assert abs(got[0].lat - 43.0) < 1e-3 and abs(got[0].lon + 2.0) < 1e-3
    assert jobs.forecast_et0(known, V.URN + "8", points).count() == 0
    with pytest.raises(ValueError):
        jobs.forecast_et0(known, "7", points, days=15)


def test_weather_is_the_nearest_stations_as_last_known(spark):
    rows = [("near", -2.0, 43.0, date(2024, 1, 12), 7.0, None), ("near", -2.0, 43.0, date(2024, 1, 14), None, 55.0), ("near", -2.0, 43.0, date(2024, 1, 16), 99.0, 99.0), ("old", -1.99, 43.0, date(2023, 1, 1), 1.0, 1.0), ("far", 5.0, 43.0, date(2024, 1, 15), 2.0, 2.0)]
    w = spark.createDataFrame(rows, "station string, lon double, lat double, date date, t_avg double, humidity double")
    x, y = 8100, 5990
    got = jobs.tile_weather(spark.createDataFrame([(14, x, y)], "z int, x int, y int"), w, date(2024, 1, 15)).collect()
    assert [(r.station, r.t_avg, r.rh_avg, r.t_min, r.doy) for r in got] == [("near", 7.0, 55.0, 10.0, 15)]
