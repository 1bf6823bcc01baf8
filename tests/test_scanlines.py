import numpy as np
import pytest

from climaspark.functions.geo import Grid
from climaspark.operators import raster as R
from climaspark.operators import scanlines as S

EDGE = "name int, x0 double, y0 double, x1 double, y1 double"


def ring(rng, n, centre, size):
    a = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = rng.uniform(0.2, 1, n) * size
    p = np.stack([centre[0] + r * np.cos(a), centre[1] + r * np.sin(a)], 1)
    return [(*map(float, p[i]), *map(float, p[(i + 1) % n])) for i in range(n)]


def even_odd(x, y, edges):
    hit = np.zeros(np.shape(x), int)
    for x0, y0, x1, y1 in edges:
        if y0 != y1:
            hit += ((y0 > y) != (y1 > y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    return hit % 2 == 1


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(4)
    own = [ring(rng, n, rng.uniform(0, 40, 2), 14) for n in (3, 7, 30, 60, 5)]
    # Corners on the centres' very lines and columns, a level edge, an edge without length.
    own.append([(10.5, 5.5, 20.5, 5.5), (20.5, 5.5, 20.5, 15.5), (20.5, 15.5, 10.5, 5.5), (3.0, 3.0, 3.0, 3.0)])
    return own


def centres(g):
    i, j = np.indices((g.height, g.width))
    return g.west + (j + 0.5) * g.resolution, g.north - (i + 0.5) * g.resolution


@pytest.mark.parametrize("grid", [Grid(0.0, 40.0, 1.0, 40, 40), Grid(-7.3, 33.7, 0.7, 50, 61), Grid(12.0, 20.0, 3.0, 4, 3)])
def test_mask_is_that_of_every_point(spark, shapes, grid):
    edges = [(0, *e) for s in shapes for e in s]
    want = even_odd(*centres(grid), [e[1:] for e in edges])
    cells = spark.createDataFrame([(int(i), int(j), "x") for i in range(grid.height) for j in range(grid.width)], "row int, col int, other string")
    got = {(r["row"], r["col"]): r["inside"] for r in S.mask(cells, spark.createDataFrame(edges, EDGE), grid).collect()}
    assert all(got[i, j] == want[i, j] for i in range(grid.height) for j in range(grid.width)) and want.any() and not want.all()


def test_areas_of_each_shape(spark, shapes):
    g = Grid(0.0, 40.0, 0.5, 80, 80)
    edges = spark.createDataFrame([(k, *e) for k, s in enumerate(shapes) for e in s], EDGE)
    got = {r["name"]: r["cells"] for r in S.areas(edges, g).collect()}
    want = {k: int(even_odd(*centres(g), s).sum()) for k, s in enumerate(shapes)}
    assert got == {k: n for k, n in want.items() if n}


def test_weights_are_those_of_all_sub_points(spark, shapes):
    edges = [e for s in shapes for e in s]
    cells = [(float(lat), float(lon)) for lat in np.arange(0, 40, 2.5) for lon in np.arange(0, 40, 2.5)]
    got = {(r["lat"], r["lon"]): r["w"] for r in S.cell_weights(spark.createDataFrame([*cells, cells[0]], "lat double, lon double"), spark.createDataFrame([(0, *e) for e in edges], EDGE), 2.5, 8).collect()}
    off = (np.arange(8) + 0.5) / 8 - 0.5
    assert len(got) == len(cells)
    for lat, lon in cells:
        x, y = np.meshgrid(lon + off * 2.5, lat + off * 2.5)
        assert got[lat, lon] == pytest.approx(even_odd(x, y, edges).mean() * np.cos(np.radians(lat)), abs=1e-12)


def test_points_of_any_height(spark, shapes):
    rng = np.random.default_rng(8)
    p = rng.uniform(-5, 45, (500, 2))
    edges = [(0, *e) for s in shapes for e in s]
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(500, None, 1.0)], "k int, x double, y double")
    want = even_odd(p[:, 0], p[:, 1], [e[1:] for e in edges])
    for strip in (None, 0.3, 100.0):
        got = {r["k"]: r["inside"] for r in S.inside(d, spark.createDataFrame(edges, EDGE), strip=strip).collect()}
        assert all(got[i] == want[i] for i in range(500)) and got[500] is False
    assert R.inside(d, spark.createDataFrame([], EDGE)).where("inside").count() == 0


def test_open_shapes_and_nothing(spark):
    g = Grid(0.0, 2.0, 1.0, 4, 2)
    one = spark.createDataFrame([(0, 2.0, 0.0, 2.0, 2.0)], EDGE)
    assert sorted((r["row"], r["start"], r["stop"]) for r in S.spans(one, g).collect()) == [(0, 0, 1), (1, 0, 1)]
    assert S.spans(one.where("false"), g).count() == 0
