import zlib
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from terrafold.functions import geo
from terrafold.operators import asof, gdd, graph, mosaics, nearest, soil, terrain, tiles, zonal, zones
from terrafold.plans import catalogue
from terrafold.sources import stores, versions
from terrafold.streaming import zones as stream


def grid(spark, z, aspect=0.0, slope=0.0, tile=0):
    rows = [(tile, r, c, None if v is None else float(v), float(aspect), float(slope)) for r, line in enumerate(z) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "tile_id long, r int, c int, elev double, aspect double, slope double")


def labels(spark, df, **k):
    return {(r.r, r.c): r.label for r in zones.components(zones.classed(df), **k).collect()}


def test_zones(spark):
    got = labels(spark, grid(spark, [[100] * 8] * 8), min_pixels=1)
    assert set(got.values()) == {1} and len(got) == 64
    got = labels(spark, grid(spark, [[80] * 4] * 2 + [[30] * 4] * 2, aspect=180, slope=5), min_pixels=1)
    assert {got[r, 0] for r in (0, 1)} == {2} and {got[r, 0] for r in (2, 3)} == {1}
    z = [[10] * 10 for _ in range(10)]
    for r in range(3):
        for c in range(3):
            z[1 + r][1 + c] = z[6 + r][6 + c] = 120
    got = labels(spark, grid(spark, z), min_pixels=5)
    assert got[1, 1] != got[6, 6] and got[1, 1] > 0 and got[6, 6] > 0 and got[0, 0] == 0
    z = [[10] * 5 for _ in range(5)]
    z[2][2] = z[2][3] = 120
    assert set(labels(spark, grid(spark, z), min_pixels=5).values()) == {0}
    assert labels(spark, grid(spark, []), min_pixels=5) == {}


def test_components_of_spirals(spark):
    rng = np.random.default_rng(0)
    z = rng.integers(0, 2, (40, 40)) * 60 + 60
    got = labels(spark, grid(spark, z.tolist()), min_pixels=1)
    seen, want = set(), 0
    for s in got:
        if s in seen:
            continue
        want += 1
        todo, mine = [s], set()
        while todo:
            r, c = todo.pop()
            if (r, c) in mine or not (0 <= r < 40 and 0 <= c < 40) or z[r, c] != z[s]:
                continue
            mine.add((r, c))
            todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
        seen |= mine
        assert len({got[p] for p in mine}) == 1
    assert max(got.values()) == want


def test_horn_on_a_plane(spark):
    z = [[12 * r + 7 * c for c in range(5)] for r in range(5)]
    df = terrain.horn(grid(spark, z).select("tile_id", "r", "c", "elev").withColumn("pixel_size_deg", F.lit(1 / terrain.METRES_PER_DEGREE)))
    inner = df.filter("r between 1 and 3 and c between 1 and 3").collect()
    assert all(r.dzdx == pytest.approx(7) and r.dzdy == pytest.approx(12) for r in inner)
    assert {(r.slope, r.aspect) for r in df.filter("r = 0 or c = 4").collect()} == {(0, 0)}


@pytest.mark.parametrize(("aspect", "slope", "want"), [(0, 10, 1), (359, 10, 1), (160, 10, 5), (200, 10, 5), (22.4, 5, 1), (22.5, 5, 2), (67.4, 5, 2), (67.5, 5, 3), (90, 1.9, 0)])
def test_sectors(spark, aspect, slope, want):
    assert spark.range(1).select(terrain.aspect_sector(F.lit(float(aspect)), F.lit(float(slope)))).first()[0] == want


def test_zonal_statistics(spark):
    rows = [(1, "eto", v) for v in (1.0, 2.0, 3.0, 10.0, None, float("nan"), float("inf"), -9999.0)] + [(2, "eto", 5.0)] * 3 + [(3, "eto", v) for v in (0.0, 1.0, 2.0, 10.0)]
    px = spark.createDataFrame(rows, "parcel int, metric string, value double")
    asked = spark.createDataFrame([(1, "eto"), (2, "eto"), (3, "eto"), (1, "frost_risk"), (9, "nope")], "parcel int, metric string")
    got = {(r.parcel, r.metric): r for r in zonal.zonal_stats(px, asked, ["parcel"]).collect()}
    a = got[1, "eto"]
    assert (a.p25, a.p50, a.p75, a.pixel_count) == (1.75, 2.5, 4.75, 4) and a.std == pytest.approx(3.5355339059)
    assert got[2, "eto"].histogram == [0, 0, 0, 0, 0, 3, 0, 0, 0, 0] and got[3, "eto"].histogram == [1, 1, 1, 0, 0, 0, 0, 0, 0, 1]
    assert got[1, "frost_risk"].error == "no pixels" and got[9, "nope"].error == "unknown metric: nope" and a.error is None


def brute_nearest(left, right):
    """Each left row with the nearest right row, by all pairs."""
    if not right:
        return [(k, x, y, None) for k, x, y in left]
    ids, rx, ry = (np.array(v) for v in zip(*right))
    out = []
    for k, x, y in left:
        if x is None or y is None:
            out.append((k, x, y, None))
            continue
        a = np.sin(np.radians(ry - y) / 2) ** 2 + np.cos(np.radians(y)) * np.cos(np.radians(ry)) * np.sin(np.radians(rx - x) / 2) ** 2
        out.append((k, x, y, round(float((2 * 6_371_000.0 * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0, 1 - a)))).min()), 1)))
    return out


def test_quartiles_and_bins_of_a_group_that_has_most_rows(spark):
    rng = np.random.default_rng(7)
    hot = np.concatenate([rng.exponential(3.0, 40_000), np.full(9_000, 2.5), rng.normal(-5, 1e-6, 3_000)])
    groups = {"hot": hot, None: rng.normal(0, 1, 700), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "even": np.full(2_000, 3.0)}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("hot", None), ("hot", float("nan")), ("none", -9999.0)]
    px = spark.createDataFrame(rows, "parcel string, value double").repartition(16)
    got = {r.parcel: (r.p25, r.p50, r.p75) for r in zonal.percentiles(px, ["parcel"], accuracy=200).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert np.allclose(got[k], np.percentile(xs, [25, 50, 75]), rtol=1e-14, atol=0)
    bins = {r.parcel: r.histogram for r in zonal.histograms(px, ["parcel"]).collect()}
    for k, xs in groups.items():
        assert bins[k] == np.histogram(xs, 10)[0].tolist()


def test_brackets_leave_few_values_to_rank(spark):
    px = spark.range(200_000).selectExpr("'p' AS parcel", "cast(hash(id) AS double) AS value")
    stored = zonal._stored(px, ["parcel"])
    q = zonal._groups(stored, ["parcel"], accuracy=1000).first()._q
    assert all(stored.filter(f"value between {a} and {b}").count() < 200_000 * 12 / 1000 for a, b in zip(q[::2], q[1::2]))


def test_the_search_for_neighbours_joins_without_lambdas(spark):
    at = spark.range(400).selectExpr("id AS k", "cast(id % 20 AS double) AS lon", "cast(id div 20 AS double) AS lat")
    plan = nearest.nearest(at, at.withColumnRenamed("k", "id"), "k", "id", rows=0)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "lambda" in x]


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_ways_agree_with_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    left = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([-180, -90], [180, 90], (150, 2)))]
    left += [(1000 + i, x, y) for i, (x, y) in enumerate((x, y) for x in (-180.0, 180.0, 179.999, -179.9) for y in (90.0, -90.0, 89.9, 0.0))]
    left += [(2000, 170.0, 0.0), (2001, 179.9, 0.0), (2002, None, 1.0), (None, 3.0, 3.0), (None, 120.0, -3.0), (7, 1.0, 1.0), (7, 50.0, 50.0)]
    right = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([-180, -90], [180, 90], (60, 2)))]
    right += [(100 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([10, 20], [10.001, 20.001], (150, 2)))]
    right += [(600 + i, 5.0, 5.0) for i in range(40)] + [(700, 178.0, 0.0), (701, 156.0, 0.0), (702, 180.0, 0.0), (703, -180.0, -90.0)]
    of = lambda rows: spark.createDataFrame(rows, "k int, lon double, lat double")
    near = lambda r, n: sorted(map(repr, nearest.nearest(of(left), of(r).withColumnRenamed("k", "id"), "k", "id", rows=n).collect()))
    a, b = near(right, 10_000), near(right, 0)
    assert a == b
    got = sorted((repr(r.k), repr(r.lon), repr(r.lat), r.distance_m) for r in nearest.nearest(of(left), of(right).withColumnRenamed("k", "id"), "k", "id", rows=0).collect())
    want = sorted((repr(k), repr(x), repr(y), d) for k, x, y, d in brute_nearest(left, right))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(p[3] == q[3] or abs(p[3] - q[3]) <= 0.11 for p, q in zip(got, want) if q[3] is not None)
    assert {r.id for r in nearest.nearest(of(left), of([]).withColumnRenamed("k", "id"), "k", "id").collect()} == {None}


def test_nearest_past_the_poles(spark):
    rng = np.random.default_rng(1)
    of = lambda n, key, low, high: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([-180, low], [180, high], (n, 2)))], f"{key} long, lon double, lat double")
    left, right = of(60, "k", -400, 474), of(300, "id", -120, 120)
    near = lambda n: sorted(map(repr, nearest.nearest(left, right, "k", "id", rows=n).collect()))
    assert near(10_000) == near(0)


def test_gdd_validation():
    now = datetime(2024, 6, 1)
    assert gdd.season("2024-01-05", now) == datetime(2024, 1, 5)
    for bad in ("2024-1-5", "2024-02-31", "2024-07-01", "x"):
        with pytest.raises(ValueError):
            gdd.season(bad, now)


def test_stores(spark, tmp_path):
    old, new = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d"), (3, "e")]))
    assert sorted(map(tuple, stores.append_if_absent(old, new).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, stores.merge(old, new.filter("v != 'e'")).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    px = lambda on, m, v: spark.createDataFrame([("t", m, on, 14, 1, 2, 0, c, x) for c, x in enumerate(v)], stores.RASTER.replace("value float", "value double"))
    path = str(tmp_path / "r")
    stores.write_rasters(px(date(2024, 1, 1), "eto", [1.5, float("nan")]).unionByName(px(date(2024, 1, 2), "eto", [2.5])), path)
    stores.write_rasters(px(date(2024, 1, 2), "eto", [9.5]), path)
    got = stores.read_rasters(spark, path, "t", "eto")
    assert sorted((str(r.date), r.value) for r in got.fillna(-1).collect()) == [("2024-01-01", -1.0), ("2024-01-01", 1.5), ("2024-01-02", 9.5)]
    assert "PartitionFilters: [isnotnull(tenant" in got._jdf.queryExecution().toString()
    assert sorted(str(r.date) for r in stores.stored_partitions(spark, path, "t").collect()) == ["2024-01-01", "2024-01-02"]
    assert stores.latest(got).first().date == date(2024, 1, 2)
    assert stores.retained(got, date(2024, 1, 31), 29).count() == 1
    with pytest.raises(ValueError):
        stores.latest_zones(got, "p", 51)
    assert stores.tenants(" a, ,b,") == ["a", "b"]
    (tmp_path / "d.json").write_text('{"z":14,"x":1,"y":2,"origin_lon":0,"origin_lat":0,"pixel_size":0.5,"elevations":[[1,null],[3,4]]}\n')
    dem = stores.read_dem(spark, str(tmp_path / "d.json"))
    assert (dem.first().rows, dem.first().cols, dem.first().pixel_size_deg) == (2, 2, 0.5)
    assert [r.elev for r in terrain.explode_grid(terrain.valid_tiles(dem)).orderBy("r", "c").collect()] == [1, None, 3, 4]


def test_bounds_centres_and_forecasts_of_odd_input(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert tuple(one(geo.bounds_or_zero(F.lit("{}")))) == (0, 0, 0, 0)
    line = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,8],[0,0]]]}'
    assert tuple(one(geo.bounds_or_zero(F.lit(line)))) == (0, 0, 4, 8) and tuple(one(geo.centroid_lat_lon(F.lit(line)))) == (2, 2)
    assert one(geo.centroid_lat_lon(F.lit("{}"))) is None
    df = spark.sql("select 1 as id, array(named_struct('date', '2024-01-01', 'eto_mm', 1.0D, 'precip_mm', null), named_struct('date', null, 'eto_mm', null, 'precip_mm', 2.0D)) as forecast")
    assert stores.forecast(df, 1).count() == 1 and stores.forecast(df, 14).count() == 2
    for bad in (0, 15):
        with pytest.raises(ValueError):
            stores.forecast(df, bad)
    e = spark.createDataFrame([("a", '{"soil":{"value":"clay"}}'), ("b", None)], "id string, attributes string")
    assert [r.value for r in stores.attribute(e, "a", "soil").collect()] == ["clay"] and not stores.attribute(e, "b", "soil").collect() and not stores.attribute(e, "z", "soil").collect()


def test_png(spark):
    df = spark.createDataFrame([(0, r, c, 200 * r, c, 5, 255) for r in range(2) for c in range(3)], "tile_id int, r int, c int, cr int, cg int, cb int, ca int")
    png = bytes(tiles.png_tiles(df, ["tile_id"]).first().png)
    assert png.startswith(b"\x89PNG") and zlib.decompress(png[41:-16]) == b"".join(b"\0" + bytes(v for c in range(3) for v in (200 * r, c, 5, 255)) for r in range(2))


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    day = lambda n, h: datetime(2024, 1, n, h)
    rows = [("p", "z1", day(1, 3), 25.0, 11.0, 1), ("p", "z1", day(1, 9), 35.0, 15.0, 1), ("p", "z2", day(2, 3), 12.0, 2.0, 2), ("p", "z1", day(20, 3), 20.0, 10.0, 3)]
    schema = "has_agri_parcel string, zone_id string, observed_at timestamp, t_max double, t_min double, id int"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    read = lambda: spark.readStream.schema(schema).parquet(str(src))
    q = stream.daily_gdd(read()).writeStream.format("memory").queryName("gdd_days").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.zone_id, str(r.day), r.gdd, r.n) for r in spark.table("gdd_days").collect()} == {("z1", "2024-01-01", 8 + 12.5, 2), ("z2", "2024-01-02", 0.0, 1)}
    q = stream.once(read()).writeStream.format("memory").queryName("seen_once").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.table("seen_once").collect()) == [1, 2, 3]
    for k in range(2):
        if k:
            spark.createDataFrame([("p", "z9", day(21, 1), 1.0, 1.0, 3), ("p", "z9", day(21, 2), 1.0, 1.0, 4)], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream.merge_stream(read(), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.id, r.zone_id) for r in spark.read.parquet(str(tmp_path / "store" / "v1")).collect()} >= {(3, "z9"), (4, "z9")}


RUN = "metric string, z int, x int, y int, r int, c int, value double, origin_lon double, origin_lat double, pixel_size_deg double, rows int, cols int"


def run_rows(spark, metric, values, x=1):
    return spark.createDataFrame([(metric, 14, x, 2, k // 2, k % 2, v, -2.0, 40.0, 0.5, 2, 2) for k, v in enumerate(values)], RUN)


def stored(spark, px, path, day, metrics=("eto", "frost_risk"), tenant="t 1"):
    kept = stores.with_bounds(px).select("metric", "z", "x", "y", "r", "c", "value", *stores.BOUNDS)
    return stores.publish(kept, path, f"{path}-pointers", tenant, day, metrics)


def test_published_tiles_are_counted_in_the_same_job_and_move_pointers(spark, tmp_path):
    path, nan = str(tmp_path / "rasters"), float("nan")
    day = run_rows(spark, "eto", [nan, None, 2.0, 3.0]).unionByName(run_rows(spark, "eto", [nan] * 4, x=5)).unionByName(run_rows(spark, "eto", [1.0], x=6)).unionByName(run_rows(spark, "frost_risk", [None, nan]))
    assert stored(spark, day, path, date(2024, 1, 5)) == {"eto": 2, "frost_risk": 0}
    assert stores.read_pointers(spark, f"{path}-pointers", "t 1") == {"eto": date(2024, 1, 5)}
    stored(spark, day, path, date(2024, 1, 3))
    stored(spark, run_rows(spark, "frost_risk", [1.0]), path, date(2024, 1, 3))
    assert stores.read_pointers(spark, f"{path}-pointers", "t 1") == {"eto": date(2024, 1, 5), "frost_risk": date(2024, 1, 3)}
    assert stores.read_pointers(spark, f"{path}-pointers", "other") == {}
    got = stores.read_rasters(spark, path, "t 1", "eto", date(2024, 1, 5), bounds=True).filter("x = 1").orderBy("r", "c").collect()
    assert [r.value for r in got] == [None, None, 2.0, 3.0] and {(r.west, r.south, r.east, r.north) for r in got} == {(-2.0, 40.0, -1.0, 41.0)}
    with pytest.raises(Exception, match="unknown metric"):
        stored(spark, run_rows(spark, "other", [1.0]), path, date(2024, 1, 6))


def test_listing_reads_names_and_retention_deletes_folders(spark, tmp_path):
    path = str(tmp_path / "rasters")
    assert stores.stored_partitions(spark, path, "t 1").count() == 0
    for tenant in ("t 1", "a/b=c%", "é"):
        for k in (1, 2, 3):
            stored(spark, run_rows(spark, "eto", [1.0]), path, date(2024, 1, k), tenant=tenant)
    (tmp_path / "rasters" / "tenant=t 1" / "metric=eto" / "date=latest").mkdir()
    listed = stores.stored_partitions(spark, path, "t 1", "eto")
    assert "FileScan" not in listed._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, listed.collect())) == [("t 1", "eto", date(2024, 1, k)) for k in (1, 2, 3)]
    assert stores.stored_partitions(spark, path, "a/b=c%").count() == 3 and stores.stored_partitions(spark, path, "é", "other").count() == 0
    assert stores.delete_old(spark, path, "t 1", datetime(2024, 2, 1), days=30) == [("eto", date(2024, 1, 1))]
    assert stores.delete_old(spark, path, "t 1", datetime(2024, 2, 1, 0, 0, 1), days=30) == [("eto", date(2024, 1, 2))]
    assert not list((tmp_path / "rasters" / "tenant=t 1").rglob("date=2024-01-0[12]*")) and stores.stored_partitions(spark, path, "t 1").count() == 1
    assert stores.stored_partitions(spark, path, "é").count() == 3


def brute_last_known(asked, known, within=None):
    out = []
    for k, t in asked:
        row = []
        for f in (2, 3):
            seen = [(o[1], o[f]) for o in known if o[0] == k and k is not None and t is not None and o[1] is not None and o[1] <= t and o[f] is not None]
            best = max(seen, default=None)
            row.append(best[1] if best and (within is None or best[0] >= t - timedelta(seconds=within)) else None)
        out.append((k, t, *row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("within", [None, 3 * 86_400])
def test_last_known_values(spark, within):
    rng = np.random.default_rng(3)
    at = lambda days: datetime(2024, 1, 1) + timedelta(days=float(days))
    value = lambda: None if rng.random() < 0.5 else float(rng.integers(5))
    known = [(k, at(rng.integers(0, 40)), value(), value()) for k in ("a", "b", "hot") for _ in range(30)] + [("hot", at(k / 10), float(k), None) for k in range(300)] + [(None, at(1), 1.0, 1.0), ("a", None, 1.0, 1.0)]
    asked = [(k, at(rng.integers(-2, 60))) for k in ("a", "b", "hot", "none", None) for _ in range(25)] + [("hot", None)] + [("hot", at(20))] * 50
    left, right = spark.createDataFrame(asked, "station string, at timestamp_ntz"), spark.createDataFrame(known, "station string, at timestamp_ntz, t double, p double")
    got = asof.last_known(left, right, ["station"], "at", ["t", "p"], span=2 * 86_400, within=within)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_last_known(asked, known, within)
    assert asof.last_known(left, right.limit(0), ["station"], "at", ["t", "p"]).filter("t is not null").count() == 0


def test_versions_rewrite_touched_buckets_only(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id string, v int")
    assert versions.versions(spark, store) == []
    assert versions.merge_version(rows([*map(str, range(200)), None], 0), store, "id", 0, buckets=16)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "data").rglob("*.parquet")}
    before = files()
    assert versions.merge_version(rows(["3", "new", None], 1), store, "id", 5)
    after = files()
    assert before.items() <= after.items() and len({p.parent.name for p in after.keys() - before.keys()}) <= 3
    got = {r.id: r.v for r in versions.read(spark, store).collect()}
    assert got == {str(i): int(i == 3) for i in range(200)} | {"new": 1, None: 1}
    assert not versions.merge_version(rows(["3"], 9), store, "id", 5) and files() == after  # a batch that comes again
    with pytest.raises(ValueError):
        versions.merge_version(rows(["3"], 9), store, "id", 2)
    assert versions.read(spark, store, 0).filter("v = 1").count() == 0
    assert versions.merge_version(rows([], 9), store, "id", 6)
    assert versions.forget(spark, store) == 0 and versions.versions(spark, store) == [6] and versions.read(spark, store).count() == 202


def test_merge_buckets_as_a_stream(spark, tmp_path):
    src, store, cp = (str(tmp_path / n) for n in ("src", "store", "cp"))
    schema = "id string, observed_at timestamp_ntz, v int"
    for k in range(3):
        spark.createDataFrame([(str(i), datetime(2024, 1, 1 + k, i % 24), k) for i in range(k * 10, k * 10 + 20)] + [("0", datetime(2024, 1, 1 + k), 90 + k)], schema).write.mode("append").parquet(src)
        stream.merge_buckets(spark.readStream.schema(schema).parquet(src), store, cp, buckets=8).awaitTermination(120)
    got = {r.id: r.v for r in versions.read(spark, store).collect()}
    assert got == {str(i): min(2, i // 10) for i in range(40)} | {"0": 92}


def moisture_rows(days, tiles=(1, 2)):
    rng = np.random.default_rng(5)
    return [(t, r, c, date(2024, 1, 1) + timedelta(days=d), float(rng.integers(0, 9)), float(rng.integers(0, 6)), 3.0, 4.0, 1.0) for d in range(days) for t in tiles for r in range(3) for c in range(2)]


SOIL = "tile_id long, r int, c int, day date, precip_mm double, eto double, awc double, fc double, wp double"


def brute_moisture(rows):
    out, now = [], {}
    for t, r, c, day, p, e, awc, fc, wp in sorted(rows, key=lambda x: x[3]):
        now[t, r, c] = max(wp, min(fc, now.get((t, r, c), 0.6 * fc) + 0.7 * p / awc - e / awc))
        out.append((t, r, c, day, round(now[t, r, c], 9)))
    return sorted(out)


def test_moisture_is_carried_from_day_to_day(spark):
    rows = moisture_rows(12)
    got = [(*x[:4], round(x[4], 9)) for x in soil.carried_moisture(spark.createDataFrame(rows, SOIL)).collect()]
    assert sorted(got) == brute_moisture(rows)
    odd = [(1, 0, 0, date(2024, 1, 1), None, 1.0, 3.0, 4.0, 1.0), (1, 0, 0, None, 1.0, 1.0, 3.0, 4.0, 1.0), (1, 0, 0, date(2024, 1, 2), 0.0, 1.0, 0.0, 4.0, 1.0)]
    assert sorted(r.soil_moisture for r in soil.carried_moisture(spark.createDataFrame(odd, SOIL)).collect()) == [2.4, 2.4]


def test_moisture_of_a_stream_goes_on_after_a_restart(spark, tmp_path):
    rows, src, out, cp = moisture_rows(10), *(str(tmp_path / n) for n in ("src", "out", "cp"))
    for k in range(0, 10, 3):  # each round is a new query over what came meanwhile
        first, last = date(2024, 1, 1 + k), date(2024, 1, 1) + timedelta(days=k + 2)
        spark.createDataFrame([r for r in rows if first <= r[3] <= last], SOIL).coalesce(1).write.mode("append").parquet(src)
        q = soil.moisture_stream(spark.readStream.schema(SOIL).parquet(src)).writeStream.option("checkpointLocation", cp).trigger(availableNow=True).start(out)
        q.awaitTermination(180)
    got = [(*x[:4], round(x[4], 9)) for x in spark.read.schema(soil.RESULT).parquet(out).collect()]
    assert sorted(got) == brute_moisture(rows)


GRID = "x int, y int, r int, c int, elev double, pixel_size_deg double, rows int, cols int"


def tiles_of_grid(z, size):
    """Rows of tiles of size x size pixels cut from a grid whose row 0 is the southern one."""
    h, w = z.shape
    return [(gx // size, (h - 1 - gy) // size, (gy - (h - size * ((h - 1 - gy) // size + 1))), gx % size, float(z[gy, gx]), 1e-4, size, size) for gy in range(h) for gx in range(w)]


def test_slopes_across_tiles_are_those_of_one_tile(spark):
    rng = np.random.default_rng(8)
    z = rng.uniform(0, 50, (12, 18))
    rows = tiles_of_grid(z, 6)
    whole = spark.createDataFrame([(0, gy, gx, float(z[gy, gx]), 1e-4) for gy in range(12) for gx in range(18)], "tile_id long, r int, c int, elev double, pixel_size_deg double")
    want = {(r.r, r.c): (round(r.slope, 9), round(r.aspect, 6)) for r in terrain.horn(whole).collect()}
    got = {((1 - r.y) * 6 + r.r, r.x * 6 + r.c): (round(r.slope, 9), round(r.aspect, 6)) for r in mosaics.horn(spark.createDataFrame(rows, GRID)).collect()}
    assert got == want
    plane = spark.createDataFrame(tiles_of_grid(np.add.outer(np.arange(8.0), np.zeros(8)), 4), GRID)
    inside = mosaics.horn(plane).filter("not (x = 0 and c = 0 or x = 1 and c = 3 or y = 0 and r = 3 or y = 1 and r = 0)")
    assert inside.filter("slope < 1").count() == 0 and inside.count() == 36


def brute_zones(kind, least):
    h, w = kind.shape
    seen, out = {}, {}
    for start in np.ndindex(h, w):
        if start in seen:
            continue
        todo, mine = [start], set()
        while todo:
            p = todo.pop()
            if p in mine or not (0 <= p[0] < h and 0 <= p[1] < w) or kind[p] != kind[start]:
                continue
            mine.add(p)
            todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
        for p in mine:
            seen[p] = start
            out[p] = start if len(mine) >= least and kind[start] != 0 else None
    return out


@pytest.mark.parametrize("least", [1, 7])
def test_zones_across_tiles_equal_one_large_tile(spark, least):
    rng = np.random.default_rng(9)
    kind = rng.integers(0, 2, (15, 20)) + 2 * (rng.random((15, 20)) < 0.1)
    rows = [(x, y, r, c, n, s, int(v), 0) for x, y, r, c, v, _, n, s in tiles_of_grid(kind, 5)]
    got = mosaics.zones(spark.createDataFrame(rows, "x int, y int, r int, c int, rows int, cols int, band int, sector int"), least).collect()
    mine = {((2 - r.y) * 5 + r.r, r.x * 5 + r.c): (r.zone_x, r.zone_y, r.label) if r.label else None for r in got}
    want = brute_zones(kind, least)
    assert set(mine) == set(want) and all((mine[p] is None) == (want[p] is None) for p in want)
    pairs = {(mine[p], want[p]) for p in want if want[p] is not None}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) >= 3
    sizes = {}
    for z in mine.values():
        sizes[z] = sizes.get(z, 0) + 1
    assert all(sizes[(r.zone_x, r.zone_y, r.label)] == r.pixel_count for r in got if r.label)


def test_a_plane_over_four_tiles_is_one_zone(spark):
    rows = [(x, y, r, c, 4, 4, 1, 3) for x in range(-1, 1) for y in range(2) for r in range(4) for c in range(4)]
    got = mosaics.zones(spark.createDataFrame(rows, "x int, y int, r int, c int, rows int, cols int, band int, sector int"), 50).collect()
    assert {(r.zone_x, r.zone_y, r.label, r.pixel_count) for r in got} == {(-1, 0, 1, 64)}


def test_connected_nodes(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 0), (200, 201), (300, 300), (202, 200)]
    got = {r.node: r.root for r in graph.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(41), 100]} | {i: 200 for i in (200, 201, 202)}
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_country_among_fields_meets_no_more_blocks_than_a_field(spark):
    at = lambda k, x, y, size: (k, x, y, size)
    shapes = [at(f"f{i}", 0.013 + 0.11 * (i % 9), 0.017 + 0.11 * (i // 9), 0.004) for i in range(60)] + [at("country", 0.01, 0.01, 0.93)]
    parcels = spark.createDataFrame(shapes, "parcel string, a double, b double, size double")
    square = F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", *(F.concat(F.lit("["), (F.col("a") + i * F.col("size")).cast("string"), F.lit(","), (F.col("b") + j * F.col("size")).cast("string"), F.lit("]")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))), F.lit("]]}"))
    parcels = parcels.select("parcel", square.alias("geometry"), F.lit(0).alias("z"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    n = 120
    cells = spark.range(n * n).select(F.lit(0).alias("z"), F.lit(0).alias("x"), F.lit(0).alias("y"), (F.col("id") % n / n).alias("x0"), (F.floor(F.col("id") / n) / n).alias("y0"), "id").withColumns({"x1": F.col("x0") + 1 / n, "y1": F.col("y0") + 1 / n})
    want = set()
    for k, x, y, s in shapes:
        for i in range(n * n):
            x0, y0 = (i % n) / n, (i // n) / n
            if x0 + 1 / n >= x and x0 <= x + s and y0 + 1 / n >= y and y0 <= y + s:
                want.add((k, i))
    for block in (None, 0.002):
        got = [(r.parcel, r.id) for r in zonal.pixels_of_parcels(cells, parcels, block).select("parcel", "id").collect()]
        assert len(got) == len(want) and set(got) == want


def test_terrain_store_reads_the_tiles_that_are_wanted(spark, tmp_path):
    rows = [(14, x, y, 0.0, 0.0, 0.1, 1, 2, [[1.0, 2.0]]) for x in range(5) for y in range(3)]
    stores.write_terrain(spark.createDataFrame(rows, stores.DEM), str(tmp_path))
    assert stores.read_terrain(spark, str(tmp_path)).count() == 15
    wanted = spark.createDataFrame([(14, 1, 2), (14, 3, 0), (14, 9, 9)], "z int, x int, y int")
    got = stores.read_terrain(spark, str(tmp_path), wanted)
    assert sorted((r.x, r.y, r.elevations) for r in got.collect()) == [(1, 2, [[1.0, 2.0]]), (3, 0, [[1.0, 2.0]])]
    one = stores.read_terrain(spark, str(tmp_path)).filter("z = 14 and x = 3")
    assert "PartitionFilters: [isnotnull(z" in one._jdf.queryExecution().executedPlan().toString()


def test_moisture_in_arrays_equals_the_streams_days():
    """The batch folds a tile in arrays, with days as numbers; rows repeat, lack values, come in any order and not on all days."""
    rng = np.random.default_rng(3)
    n = 900
    rows = pd.DataFrame({"tile_id": 7, "r": rng.integers(-1, 4, n), "c": rng.integers(0, 5, n), "day": rng.integers(19_000, 19_020, n), "precip_mm": rng.integers(0, 4, n) * 1.0, "eto": rng.integers(0, 5, n) * 1.0, "awc": rng.integers(0, 3, n) * 1.0, "fc": 30.0, "wp": 10.0})
    rows.loc[rng.integers(0, n, 60), "precip_mm"] = np.nan
    rows.loc[rng.integers(0, n, 60), "fc"] = np.nan
    # What stands on one day of one place but for rain and evaporation is the same, so that the last row is defined.
    rows[["awc", "fc", "wp"]] = rows.groupby(["r", "c", "day"])[["awc", "fc", "wp"]].transform("max")
    dated = rows.assign(day=[date.fromordinal(date(1970, 1, 1).toordinal() + int(x)) for x in rows["day"]])
    want = {(a.r, a.c, a.day): a.soil_moisture for a in pd.concat(soil.Carried().days(dated)).itertuples()}
    got = soil._folded(rows)
    got = {(a.r, a.c, date.fromordinal(date(1970, 1, 1).toordinal() + int(a.day))): a.soil_moisture for a in got.itertuples()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want)


def test_large_tables_are_never_sent_whole(spark):
    """Written tables of few values are tiny files, whatever their rows: joins of pixels and of zones sort and merge."""
    raster = spark.range(100).selectExpr("0 as z", "0 as x", "0 as y", "id * 1.0 as x0", "0.0 as y0", "id + 1.0 as x1", "1.0 as y1", "id as pixel")
    parcels = spark.range(2).select("id", F.lit(0).alias("z"), F.lit(0).alias("x"), F.lit(0).alias("y"), geo.square(F.col("id").cast("double"), F.lit(0.5)).alias("geometry"))
    px = spark.range(16).selectExpr("cast(id % 2 as int) as x", "0 as y", "cast(id div 8 as int) as r", "cast(id div 2 % 4 as int) as c", "2 as rows", "4 as cols", "1 as band", "1 as sector")
    for df in (zonal.pixels_of_parcels(raster, parcels), mosaics.zones(px, 1), graph.connected(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString() and df.count()


def test_pixels_of_a_cell_are_summed_before_they_meet_parcels(spark, sf_dir, monkeypatch):
    met = []
    kept = zonal.pixels_of_parcels
    monkeypatch.setattr(zonal, "pixels_of_parcels", lambda raster, parcels: met.append(raster) or kept(raster, parcels))
    catalogue.queries()["pixel_concat"](spark, sf_dir)
    assert met[0].count() == met[0].select("x0", "y0").distinct().count()


def test_equal_geometries_are_searched_once(spark, monkeypatch):
    """However many parcels have them; parcels that stand twice, in two tiles or have no id keep all their rows."""
    met = []
    kept = geo.computed
    monkeypatch.setattr(geo, "computed", lambda df, name, value: met.append((name, df)) or kept(df, name, value))
    grid = "z int, x int, y int, x0 double, y0 double, x1 double, y1 double, pixel long"
    at = lambda i, n: (0, i // 2, 0, float(i) or (-0.0 if n else 0.0), 0.0, i + 1.0, 1.0, 10 * i + n)
    raster = spark.createDataFrame([at(i, n) for i in range(4) for n in range(3)], grid)
    here, both = geo.square(F.lit(0.5), F.lit(0.5), 0.2), geo.square(F.lit(2.0), F.lit(0.5), 0.7)
    rows = [(p, 0, x, 0, wide) for p, wide, tiles in ((1, False, (0,)), (2, False, (0, 0)), (None, False, (0,)), (4, True, (0, 1)), (5, True, (0, 1)), (6, True, (1,))) for x in tiles]
    parcels = spark.createDataFrame(rows, "parcel long, z int, x long, y int, wide boolean").select("parcel", "z", "x", "y", F.when(F.col("wide"), both).otherwise(here).alias("geometry"))
    got = zonal.pixels_of_parcels(raster, parcels).select("parcel", "pixel").collect()
    cells = [(1, 0), (2, 0), (2, 0), (None, 0), (4, 1), (4, 2), (5, 1), (5, 2), (6, 2)]
    want = [(p, 10 * i + n) for p, i in cells for n in range(3)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [df.count() for name, df in met if name == "edges"] == [3]


def test_a_lists_parcels_are_given_out_for_each_pixel_in_turn(spark):
    """So a result that is written repeats itself within a short distance; parcels keep all their columns, null ones too."""
    raster = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 1.0, 1.0, n) for n in range(3)], "z int, x int, y int, x0 double, y0 double, x1 double, y1 double, pixel long")
    parcels = spark.range(96).select(F.nullif("id", F.lit(7)).alias("parcel"), (F.col("id") % 3).alias("kind"), *(F.lit(0).alias(t) for t in "zxy"), geo.square(F.lit(0.5), F.lit(0.5), 0.2).alias("geometry"))
    for columns in (("parcel",), ("parcel", "kind")):
        got = [tuple(r) for r in zonal.pixels_of_parcels(raster, parcels.select(*columns, "z", "x", "y", "geometry")).select(*columns, "pixel").collect()]
        want = [(*p, n) for p in map(tuple, parcels.select(*columns).collect()) for n in range(3)]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert len({g[0] for g in got[: 3 * 32]}) == 32
    assert zonal.pixels_of_parcels(raster, parcels.drop("parcel", "kind")).select("pixel").count() == 288
