import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from climaspark.operators import nearest as N
from climaspark.operators import raster as R

SCHEMA = "row int, col int, elevation double"


def brute(a):
    """The nearest valid cell of each missing one, ties to the first in row-major order."""
    i, j = np.nonzero(~np.isnan(a))
    out = a.copy()
    for r, c in zip(*np.nonzero(np.isnan(a)), strict=True):
        if len(i):
            k = np.lexsort((j, i, (i - r) ** 2 + (j - c) ** 2))[0]
            out[r, c] = a[i[k], j[k]]
    return out


def frame(spark, a, keep=None):
    rows = [(int(i), int(j), None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if keep is None or keep[i, j]]
    return spark.createDataFrame(rows, SCHEMA)


def array(df, h, w):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r["elevation"] is None else r["elevation"]
    return out


@given(st.integers(1, 6), st.integers(1, 9), st.integers(0, 2**31), st.floats(0, 1))
@settings(max_examples=200, deadline=None)
def test_one_strip(h, w, seed, share):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((h, w)) < share, np.nan, np.arange(h * w, dtype=float).reshape(h, w))
    got = N.strip_filled(a, -2, np.full(w, -N._FAR), np.full(w, np.nan), np.full(w, N._FAR), np.full(w, np.nan))
    assert np.array_equal(got, brute(a), equal_nan=True)


@pytest.mark.parametrize(("strip", "share"), [(1, 0.9), (4, 0.97), (7, 0.6), (64, 0.99), (3, 1.0)])
def test_strips_against_brute_force(spark, strip, share):
    rng = np.random.default_rng(strip)
    a = np.where(rng.random((40, 33)) < share, np.nan, np.arange(40 * 33, dtype=float).reshape(40, 33))
    assert np.array_equal(array(N.filled(frame(spark, a), strip=strip), 40, 33), brute(a), equal_nan=True)


def test_a_hole_of_three_thousand_cells(spark):
    a = np.arange(90.0 * 70).reshape(90, 70)
    a[15:75, 10:60] = np.nan
    assert np.array_equal(array(N.filled(frame(spark, a), strip=8), 90, 70), brute(a))


def test_absent_cells_count_as_missing_and_are_not_filled(spark):
    rng = np.random.default_rng(3)
    a = np.where(rng.random((30, 12)) < 0.8, np.nan, np.arange(360.0).reshape(30, 12))
    keep = rng.random(a.shape) < 0.5
    keep[:, 4] = np.arange(30) < 3  # a column that only the first strip has
    keep[:, 7] = np.arange(30) > 27
    a[0, 4], a[29, 7] = 7.5, 8.5
    keep[0, 4] = keep[29, 7] = True
    got = array(N.filled(frame(spark, a, keep), strip=5), 30, 12)
    want = np.where(keep, brute(np.where(keep, a, np.nan)), np.nan)
    assert np.array_equal(got, want, equal_nan=True) and N.filled(frame(spark, a, keep), strip=5).count() == keep.sum()


def test_rows_below_zero(spark):
    a = np.where(np.random.default_rng(1).random((20, 6)) < 0.9, np.nan, np.arange(120.0).reshape(20, 6))
    moved = frame(spark, a).selectExpr("row - 11 as row", "col - 3 as col", "elevation")
    assert np.array_equal(array(N.filled(moved, strip=4).selectExpr("row + 11 as row", "col + 3 as col", "elevation"), 20, 6), brute(a))


def test_kinds_and_empty_rasters(spark):
    d = spark.createDataFrame([(0, 0, None, "x"), (0, 1, 5, "y")], "row long, col int, elevation int, other string")
    got = R.filled(d)
    assert got.schema.simpleString() == "struct<row:bigint,col:int,elevation:int>" and {r["elevation"] for r in got.collect()} == {5}
    assert R.filled(d.where("false")).count() == 0 and [r["elevation"] for r in R.filled(d.where("col = 0")).collect()] == [None]
