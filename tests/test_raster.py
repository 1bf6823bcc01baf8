import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from climaspark.functions import geo
from climaspark.operators import raster as R


def frame(spark, a, inside=None):
    return spark.createDataFrame([(i, j, None if np.isnan(a[i, j]) else float(a[i, j]), bool(inside is None or inside[i][j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "row int, col int, elevation double, inside boolean")


def array(df, h, w):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r["elevation"] is None else r["elevation"]
    return out


def test_terrarium(spark):
    d = spark.createDataFrame([(128, 0, 0), (128, 1, 128), (129, 44, 0)], "r int, g int, b int")
    assert [r[0] for r in d.select(geo.terrarium("r", "g", "b")).collect()] == [0.0, 1.5, 300.0]


def test_tiles(spark):
    p = spark.createDataFrame([(0.0, 0.0)], "lon double, lat double").select(geo.tile_x("lon", 1), geo.tile_y("lat", 1)).first()
    assert tuple(p) == pytest.approx((1, 1))
    got = R.tile_ranges(spark.createDataFrame([("a", -1.0, -1.0, 1.0, 1.0)], "name string, west double, south double, east double, north double"), 2)
    assert sorted((r["x"], r["y"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_cells_in_a_box(spark):
    got = R.cells_in_box(spark.createDataFrame([("a", 28.15, -15.55, 28.55, -15.2), ("b", 28.1, 0.1, 28.2, 0.2)], "name string, west double, south double, east double, north double"))
    assert sorted((r["lat"], r["lon"]) for r in got.collect()) == [(-15.5, 28.25), (-15.5, 28.5), (-15.25, 28.25), (-15.25, 28.5)]


def test_grid_round_trip(spark):
    g = geo.Grid(1000.0, 5000.0, 100.0, 20, 10)
    d = spark.createDataFrame([(2.5, 7.25)], "r double, c double")
    x, y = g.xy("r", "c")
    back = d.select(x.alias("x"), y.alias("y")).select(*g.pixel("x", "y")).first()
    assert tuple(back) == (2.5, 7.25) and g.cell_km2 == 0.01


def test_projection_round_trip_and_area(spark):
    p = geo.EqualArea(27.85, -13.15)
    d = spark.createDataFrame([(27.85, -13.15), (22.0, -18.0), (33.7, -8.2), (27.85, -8.0)], "lon double, lat double")
    x, y = p.forward("lon", "lat")
    xy = d.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = p.inverse("x", "y")
    for r in xy.select("lon", "lat", "x", "y", lon.alias("a"), lat.alias("b")).collect():
        assert r["a"] == pytest.approx(r["lon"], abs=1e-7) and r["b"] == pytest.approx(r["lat"], abs=1e-7)
    # A small box keeps its area on the ellipsoid.
    e = 0.01
    corners = spark.createDataFrame([(30.0, -10.0), (30.0 + e, -10.0), (30.0 + e, -10.0 + e), (30.0, -10.0 + e)], "lon double, lat double").select(*p.forward("lon", "lat")).collect()
    area = abs(sum(corners[i][0] * corners[(i + 1) % 4][1] - corners[(i + 1) % 4][0] * corners[i][1] for i in range(4))) / 2
    s = math.sin(math.radians(-10 + e / 2))
    m, n = geo.A * (1 - geo.E2) / (1 - geo.E2 * s * s) ** 1.5, geo.A / math.sqrt(1 - geo.E2 * s * s)
    assert area == pytest.approx(m * n * math.cos(math.asin(s)) * math.radians(e) ** 2, rel=1e-5)


def test_bands_and_stats(spark):
    a = np.array([[350.0, 700, 950, 1050, 1150, 1250]])
    got = R.area_by_band(frame(spark, a), (300, 600, 900, 1000, 1100, 1200, 1300)).collect()
    assert len(got) == 6 and all(r["share_pct"] == pytest.approx(100 / 6) for r in got)
    a = np.array([[500.0, 1500, 9999], [1000, 900, 1200]])
    s = R.elevation_stats(frame(spark, a, [[1, 1, 0], [1, 1, 1]]), 1.0).first()
    assert (s["area_km2"], s["min_m"], s["min_row"], s["min_col"], s["max_m"], s["max_row"], s["max_col"], s["above_1000_pct"]) == (5, 500, 0, 0, 1500, 0, 1, 60)


def test_profile_over_a_ramp(spark):
    g = geo.Grid(0.0, 10_000.0, 1000.0, 50, 10)
    a = np.tile(50 + 10 * (np.arange(50) + 0.5) - 5 * 0, (10, 1))
    line = spark.createDataFrame([("p", 5500.0, 5500.0, 35500.0, 5500.0)], "name string, x0 double, y0 double, x1 double, y1 double")
    got = R.profile(line, frame(spark, a), g, 31).orderBy("i").collect()
    assert got[-1]["distance_km"] == 30 and all(r["elevation"] == pytest.approx(50 + 10 * (5.5 + r["distance_km"])) for r in got)


def test_lines_of_one_task_become_samples_in_many(spark):
    lines = spark.range(3_000, numPartitions=1).select(F.col("id").alias("name"), F.lit(500.0).alias("x0"), F.lit(500.0).alias("y0"), F.lit(3500.0).alias("x1"), F.lit(500.0).alias("y1"))
    dealt = R.spread(lines, 81, 25_000)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 3_000 and R.spread(lines.limit(0), 81).count() == 0
    # The features need the samples once: lines are scanned once, for the one exchange of their samples by tile.
    told = R.profile_features(R.profile(lines, frame(spark, np.ones((4, 4))), geo.Grid(0.0, 4000.0, 1000.0, 4, 4), 5))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and told.count() == 3_000


def test_bilinear_outside_and_missing(spark):
    a = np.array([[1.0, 3.0], [np.nan, 5.0]])
    pts = spark.createDataFrame([(0, 0.5, 1.0), (1, -1.0, 0.5), (2, 1.0, 1.0)], "k int, r double, c double")
    got = {r["k"]: r["elevation"] for r in R.bilinear(pts, frame(spark, a), ("k",), 2, 2, clamp=False).collect()}
    assert got[0] == 2 and got[1] is None and got[2] == pytest.approx(3)


def despiked(a, floor=40.0, k=4.0):
    def med(x, n):
        p = np.pad(x, n // 2, mode="edge")
        return np.median(np.lib.stride_tricks.sliding_window_view(p, (n, n)), axis=(2, 3))

    m = med(a, 5)
    d = np.abs(a - m)
    return np.where(d > np.maximum(floor, k * med(d, 7)), m, a)


def test_despike(spark):
    a = np.full((30, 30), 1000.0)
    a[8, 8] = 1400
    a[20, 8:22] = 920
    a[:, 25:] = 400
    got = array(R.despike(frame(spark, a), 30, 30, tile=11), 30, 30)
    assert got[8, 8] == 1000 and (got[20, 8:22] == 1000).all() and (got[:, 26:] == 400).all() and (got[:, :9] == 1000).all()
    assert (got == despiked(a)).all()


def test_despike_by_tiles_equals_the_whole(spark):
    rng = np.random.default_rng(0)
    a = 1000 + rng.normal(0, 5, (37, 23)) + (rng.random((37, 23)) < 0.05) * 300
    assert array(R.despike(frame(spark, a), 37, 23, tile=8), 37, 23) == pytest.approx(despiked(a))
    assert array(R.despike_twice(frame(spark, a), 37, 23, tile=16), 37, 23) == pytest.approx(despiked(despiked(a), 25.0))


def test_block_mean_trims_and_misses(spark):
    a = np.arange(35.0).reshape(5, 7)
    a[0, 0] = np.nan
    got = {(r["row"], r["col"]): r["elevation"] for r in R.block_mean(frame(spark, a), 3, 5, 7).collect()}
    assert set(got) == {(0, 0), (0, 1)} and got[0, 0] is None and got[0, 1] == a[:3, 3:6].mean()


SQUARE = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]], [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0]]]


def test_polygon_with_a_hole(spark):
    shape = spark.createDataFrame([("s", [SQUARE]), ("e", None)], "name string, geometry array<array<array<array<double>>>>")
    edges = R.edges_of(R.vertices(shape))
    rng = random.Random(5)
    pts = spark.createDataFrame([(i, rng.uniform(-2, 12), rng.uniform(-2, 12)) for i in range(300)], "k int, x double, y double")
    want = {r["k"]: 0 < r["x"] < 10 and 0 < r["y"] < 10 and not (4 < r["x"] < 6 and 4 < r["y"] < 6) for r in pts.collect()}
    assert {r["k"]: r["inside"] for r in R.inside(pts, edges).collect()} == want
    assert {r["k"]: r["inside"] for r in R.inside_by_join(pts, edges, ("k",)).collect()} == want
    assert {r["k"]: r["inside"] for r in R.inside(pts, edges, strip=0.7).collect()} == want
    boxes = {r["name"]: r["west"] for r in R.bounding_boxes(shape).collect()}
    assert boxes == {"s": 0.0, "e": None} and R.in_view(R.bounding_boxes(shape), (9, 9, 20, 20)).count() == 1


def test_cell_weights(spark):
    edges = R.edges_of(R.vertices(spark.createDataFrame([("s", [[[[0.0, -1.0], [0.5, -1.0], [0.5, 1.0], [0.0, 1.0]]]])], "name string, geometry array<array<array<array<double>>>>")))
    got = R.cell_weights(spark.createDataFrame([(0.0, 0.5), (0.0, 0.25), (0.0, 2.0)], "lat double, lon double"), edges, 0.25).orderBy("lon").collect()
    assert [r["w"] for r in got] == pytest.approx([1, 0.5, 0])


def test_fill_from_the_nearest(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, (24, 30))
    a[rng.random(a.shape) < 0.5] = np.nan
    a[3:20, 5:25] = np.nan
    got = array(R.filled(frame(spark, a), strip=7), 24, 30)
    valid = np.argwhere(~np.isnan(a))
    for i, j in np.argwhere(np.isnan(a)):
        d = ((valid - (i, j)) ** 2).sum(1)
        assert got[i, j] == a[tuple(valid[d.argmin()])]
    full = np.ones((3, 3))
    assert (array(R.filled(frame(spark, full)), 3, 3) == full).all()


def test_marks_and_features(spark):
    # Sample 70 stands at 0.7 of the line and belongs to neither side; 35 stands 60 km before the low and is no rim; 20 lies outside.
    bumps = {95: -400, 60: 200, 70: -900, 35: 500, 20: 5000}
    rows = [("p", float(d), 1000.0 + bumps.get(d, 0) + (d < 20) * d, d != 20) for d in range(0, 101)]
    prof = spark.createDataFrame(rows, "name string, distance_km double, elevation double, inside boolean")
    f = R.profile_features(prof).first()
    plateau = float(np.median([r[2] for r in rows if r[1] < 70 and r[3]]))
    assert (f["low_km"], f["rim_km"], f["drop"], f["apart_km"], f["plateau"]) == (95, 60, 600, 35, plateau)
    lone = R.profile_features(prof.where("distance_km > 95")).first()
    assert lone["low_km"] == 96 and lone["rim"] is None and lone["drop"] is None and lone["plateau"] is None
    marks = spark.createDataFrame([("p", "m", 79.0), ("p", "n", 80.0)], "name string, mark string, distance_km double")
    assert {r["mark"]: r["highest"] for r in R.near_marks(prof, marks).collect()} == {"m": 1200, "n": 1000}


def test_pixels_of_image_rows(spark):
    image = F.struct(F.lit("file:/a/7/5/3.png").alias("origin"), F.lit(1).alias("height"), F.lit(2).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), F.lit(bytearray([0, 0, 128, 0, 44, 129])).alias("data"))
    got = R.pixels(spark.range(1).select(image.alias("image")), 2).orderBy("col").collect()
    assert [(r["x"], r["y"], r["row"], r["col"], r["r"], r["g"], r["b"]) for r in got] == [(5, 3, 6, 10, 128, 0, 0), (5, 3, 6, 11, 129, 44, 0)]


def test_regrid_outside_is_missing(spark):
    field = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 1.0, 3.0), (-1.0, 0.0, 5.0), (-1.0, 1.0, 7.0)], "lat double, lon double, v double")
    t = spark.createDataFrame([(0, -0.5, 0.5), (1, -9.0, 0.0)], "k int, lat double, lon double")
    assert {r["k"]: r["v"] for r in R.regrid(t, field, ("k",), 0.0, 0.0, 1.0, 2, 2, "v").collect()} == {0: 4.0, 1: None}


def test_median_of_units_and_values(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 200, 201):
        v = [round(rng.uniform(-3, 3), 2) for _ in range(n)]
        assert R.median_of(spark.createDataFrame([(x,) for x in v], "elevation double")) == pytest.approx(float(np.median(v)), abs=1e-12)
    assert R.median_of(spark.createDataFrame([], "elevation double")) is None


def test_stats_in_degrees(spark):
    a = np.array([[500.0, 1500.0], [1000.0, 900.0]])
    p, g = geo.EqualArea(28.0, -13.0), geo.Grid(-1000.0, 1000.0, 1000.0, 2, 2)
    s = R.elevation_stats(frame(spark, a), g.cell_km2, g, p).first()
    at = spark.createDataFrame([(-500.0, 500.0), (500.0, 500.0)], "x double, y double").select(*p.inverse("x", "y")).collect()
    assert (s["min_lon"], s["min_lat"], s["max_lon"], s["max_lat"]) == pytest.approx((*at[0], *at[1]))


def test_mosaic_to_grid(spark):
    """A mosaic whose values are its pixels' own places gives each grid cell its place, and 0 beyond."""
    zoom, tile = 8, 256
    p = geo.EqualArea(28.0, -13.0)
    g = geo.Grid(-30_000.0, 30_000.0, 5000.0, 12, 12)
    c0, r0 = int((28.0 + 180) / 360 * 65536) - 20, int((1 - math.asinh(math.tan(math.radians(-13.0))) / math.pi) / 2 * 65536) - 20
    mosaic = spark.createDataFrame([(r0 + i, c0 + j, 1000.0 + i + 100.0 * j) for i in range(40) for j in range(40)], "row int, col int, elevation double")
    got = {(r["row"], r["col"]): r["elevation"] for r in R.mosaic_to_grid(mosaic, zoom, g, p, tile).collect()}
    assert len(got) == 144 and got[0, 0] == 0
    lon, lat = p.inverse("x", "y")
    for q in R.cells_of(spark, g).select("row", "col", lon.alias("lon"), lat.alias("lat")).collect():
        c, r = (q["lon"] + 180) / 360 * 65536 - c0, (1 - math.asinh(math.tan(math.radians(q["lat"]))) / math.pi) / 2 * 65536 - r0
        if 1 < r < 39 and 1 < c < 39:
            assert got[q["row"], q["col"]] == pytest.approx(1000 + (r - 0.5) + 100 * (c - 0.5))
        elif not (0 <= r <= 40 and 0 <= c <= 40):
            assert got[q["row"], q["col"]] == 0
