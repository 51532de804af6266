import json
import math

import pytest
from pyspark.sql import functions as F
from terrafold.functions import colours, entities, geo, physics


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


@pytest.mark.parametrize(("t", "station", "z", "want"), [(25, 100, 500, 22.4), (15, 200, 200, 15), (20, 0, 1000, 13.5), (10, 100, -50, 10.975)])
def test_lapse(spark, t, station, z, want):
    assert value(spark, physics.lapse_temperature(*lit(t, station, z))) == pytest.approx(want)


@pytest.mark.parametrize(
    ("args", "want"),
    [((350, 40, 0, 0, 172), 130.06157879), ((400, 40, 180, 10, 80), 604.98148074), ((400, 40, 0, 10, 80), 89.70415059), ((200, 40, 180, 15, 355), 284.23344761), ((200, 40, 0, 15, 355), 42.14495947), ((1200, 0, 0, 0, 80), 117.91698436)],
)
def test_tilted_radiation(spark, args, want):
    assert value(spark, physics.tilted_radiation(*lit(*args))) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("args", "want"), [((20, 15, 25, 300, 2, 60, 100), 4.713726), ((25, 20, 30, 100, 3, 50, 0), 3.192224), ((25, 20, 30, 400, 3, 50, 0), 7.912683), ((20, 15, 25, 300, 2, 60, 3000), 4.883879)])
def test_evapotranspiration(spark, args, want):
    assert value(spark, physics.evapotranspiration(*lit(*args))) == pytest.approx(want, abs=1e-6)


def test_frost_soil_and_balance(spark):
    assert value(spark, physics.frost_risk(*lit(5, 200, 200))) == pytest.approx(26.8941, abs=1e-3)
    assert value(spark, physics.frost_risk(*lit(-3, 200, 200))) > 80
    assert value(spark, physics.water_balance(*lit(25, 40))) == -15
    for (p, e, now), want in {(0, 0, None): 18, (20, 0, 15): 15.7, (0, 10, 15): 14.5, (0, 100, 10.5): 10, (100, 0, 28): 30}.items():
        assert value(spark, physics.soil_moisture(*lit(20, 30, 10, p, e), None if now is None else F.lit(float(now)))) == pytest.approx(want)
    for (sand, clay), (fc, wp) in {(50, 20): (19.563, 19.553), (85, 5): (5.093, 5.083), (10, 80): (47.543, 47.533)}.items():
        s, c = lit(sand, clay)
        assert (value(spark, physics.field_capacity(s, c)), value(spark, physics.wilting_point(s, c))) == (pytest.approx(fc), pytest.approx(wp))


def test_tiles(spark):
    z, x, y = F.lit(0), F.lit(0), F.lit(0)
    b = value(spark, geo.tile_bounds(z, x, y))
    assert (b.min_lon, b.max_lon) == (-180, 180) and b.max_lat == pytest.approx(85.0511287798) and b.min_lat == pytest.approx(-85.0511287798)
    box = spark.createDataFrame([(-1.66, 42.80, -1.64, 42.81, 14), (-2.0, 42.0, -1.0, 43.0, 5), (-10.0, 35.0, 30.0, 60.0, 8)], "min_lon double, min_lat double, max_lon double, max_lat double, zoom int")
    for r, want in zip(box.collect(), [({8116, 8117}, {6032}), ({15}, {11}), (set(range(120, 150)), set(range(74, 102)))]):
        t = geo.tile_cover(box.filter(F.col("zoom") == r.zoom), r.zoom).collect()
        assert ({q.x for q in t}, {q.y for q in t}) == want


def test_tiles_past_the_edges_of_the_map(spark):
    """Beyond 85.0511 degrees the map has no tiles; without edges the formula's rows stay, and what reaches over a pole has none."""
    box = spark.createDataFrame([(-2.0, lat - 0.0005, -1.999, lat + 0.0005) for lat in (85.04, 85.06, 89.0, 90.0, 90.9, 100.0)], "min_lon double, min_lat double, max_lon double, max_lat double")
    row = lambda lat: math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 16384)
    want = sorted((r.min_lat, y) for r in box.collect() for y in range(row(r.max_lat), row(r.min_lat) + 1))
    assert sorted((r.min_lat, r.y) for r in geo.tile_cover(box, 14, edges=False).select("min_lat", "y").distinct().collect()) == want
    assert sorted((r.min_lat, r.y) for r in geo.tile_cover(box, 14).select("min_lat", "y").distinct().collect()) == [w for w in want if 0 <= w[1] < 16384]
    over = box.selectExpr("10.0 as min_lon", "10.0 as min_lat", "9.0 as max_lon", "11.0 as max_lat")
    assert geo.tile_cover(over, 14).count() == 0


def test_geometry_is_parsed_once(spark):
    """However often a mean or bounds name their points, the plan parses them once for each column it gives."""
    g = spark.range(1).select(geo.square(F.col("id").cast("double"), F.lit(1.0)).alias("g"))
    for f in (geo.bounds, geo.centroid_open, geo.centroid_walk):
        plan = g.select(f(F.col("g")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") + plan.count("jsontostructs") <= 2  # Polygon and MultiPolygon


def test_distances_and_geohash(spark):
    assert value(spark, geo.haversine_m(*lit(-1.65, 42.8, -1.65, 42.8))) == 0
    assert value(spark, geo.haversine_m(*lit(-1.65, 42.8, -1.65, 42.8001))) == pytest.approx(11.1195, abs=1e-3)
    assert value(spark, geo.haversine_m(*lit(0, 0, 180, 0))) == pytest.approx(20_015_086.796, abs=0.01)
    assert value(spark, geo.geohash(*lit(10.40744, 57.64911))) == "u4pruyd"


SQUARE = {"type": "Polygon", "coordinates": [[[10, 20], [11, 20], [11, 21], [10, 21], [10, 20]]]}
MULTI = {"type": "MultiPolygon", "coordinates": [[[[0, 0], [4, 0], [4, 4], [0, 0]]], [[[6, 6, 9], [7, 6, 9], [7, 7, 9], [6, 6, 9]]]]}


def test_geometry(spark):
    j = lambda g: F.lit(json.dumps(g))
    assert tuple(value(spark, geo.centroid_open(j(SQUARE)))) == (10.5, 20.5)
    assert tuple(value(spark, geo.bounds(j(MULTI)))) == (0, 0, 7, 7)
    assert tuple(value(spark, geo.centroid_walk(j(MULTI)))) == (2, 1)  # corners with a height don't count
    assert tuple(value(spark, geo.centroid_ring(j({"type": "Point", "coordinates": [3, 4]})))) == (3, 4)
    assert value(spark, geo.bounds(j({}))) is None and value(spark, geo.bounds(j({"type": "Point", "coordinates": [1, 2]}))) is None
    assert tuple(value(spark, geo.centroid_open(j({})))) == (0, 0)
    assert json.loads(value(spark, geo.unwrap(j({"type": "GeoProperty", "value": SQUARE})))) == SQUARE
    assert value(spark, geo.unwrap(j({"type": "Property", "value": 1}))) is None and value(spark, geo.unwrap(F.lit(None).cast("string"))) is None
    assert value(spark, geo.parcel_geometry(F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(1.0))) is None
    hole = {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[3, 3], [7, 3], [7, 7], [3, 7], [3, 3]]]}
    touches = lambda g, x0, y0, x1, y1: geo.touches_cell(geo.band(geo.edges(geo.polygons(g)), y0, y1), x0, x1)
    for cell, want in {(4, 4, 5, 5): False, (2.5, 4, 3.5, 5): True, (1, 1, 2, 2): True, (11, 0, 12, 1): False, (10, 10, 11, 11): True, (-1, -1, 12, 12): True}.items():
        assert value(spark, touches(j(hole), *lit(*cell))) is want


def test_ids_and_lists(spark):
    assert value(spark, entities.short_id(F.lit("urn:ngsi-ld:AgriParcel:p 1/x_"))) == "p-1-x"
    assert value(spark, entities.parcel_urn(F.lit("p1"))) == value(spark, entities.parcel_urn(F.lit(entities.PARCEL + "p1"))) == entities.PARCEL + "p1"
    assert value(spark, entities.metric_list(F.lit(" eto, ,frost_risk,"))) == ["eto", "frost_risk"]
    assert value(spark, entities.zone_entity_id(F.lit("a"), F.lit(entities.PARCEL + "p1"), F.lit("zone-a"))) == "urn:ngsi-ld:AgriParcelZone:a:p1:zone-a"
    record = json.loads(value(spark, entities.parcel_record(F.lit("t"), F.lit(entities.PARCEL + "p"), F.lit("2024-01-01T00:00:00Z"), {"eto": F.lit(1.5), "nope": F.lit(2.0), "frost_risk": F.lit(None).cast("double")})))
    assert record["eto"]["value"] == 1.5 and "frostRisk" not in record and "nope" not in record and record["id"].startswith("urn:ngsi-ld:AgriParcelRecord:weather-t-p-2024")
    assert value(spark, entities.sector_name(F.lit(0))) == "flat" and value(spark, entities.sector_name(F.lit(8))) == "NW"


def test_colours(spark):
    lut = {(r.metric, r.idx): (r.r, r.g, r.b, r.a) for r in colours.lookup_table(colours.palette(spark)).collect()}
    assert len(lut) == 7 * 256
    for m, stops in colours.PALETTES.items():
        assert lut[m, 0] == (*stops[0][1:], 255) and lut[m, 255] == (*stops[-1][1:], 255)
    assert colours.lookup_table(colours.palette(spark), 128).count() == 7 * 128
    df = spark.createDataFrame([("temperature_avg", x) for x in (-100.0, 50.0, 20.0, float("nan"), float("inf"), None)], "metric string, value double")
    got = [tuple(r)[2:] for r in colours.colorize(df, colours.palette(spark)).collect()]
    assert (20, 20, 120, 255) in got and (150, 0, 0, 255) in got and got.count((0, 0, 0, 0)) == 3
    with pytest.raises(Exception, match="unknown metric"):
        colours.colorize(df.withColumn("metric", F.lit("nope")), colours.palette(spark)).collect()
