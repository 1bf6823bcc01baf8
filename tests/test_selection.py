import numpy as np
import pytest
from pyspark.sql import functions as F

from climaspark.operators import raster as R

ODD = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.5, 1.5, 1.5, -2.25, 1.0000000000000002]


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "elevation double")


def test_order_of_bits(spark):
    got = frame(spark, [*ODD, None, float("nan")]).withColumn("k", R.ordered(F.col("elevation"))).collect()
    known = sorted((r["k"], r["elevation"]) for r in got if r["k"] is not None)
    assert [v for _, v in known] == sorted(ODD) and len(known) == len(ODD)
    assert len({k for k, v in known if v == 0}) == 1


@pytest.mark.parametrize("digit", [8, 16])
def test_selected_values_are_those_of_a_sort(spark, digit):
    rng = np.random.default_rng(1)
    values = [*ODD, *rng.normal(size=200), *np.round(rng.normal(size=100), 1)]
    d = frame(spark, [*values, None, float("nan")]).repartition(3)
    places = (0, 1, 7, len(values) // 2, len(values) - 1)
    assert R.selected(d, places, digit=digit) == np.sort(values)[list(places)].tolist()
    with pytest.raises(IndexError):
        R.selected(d, (len(values),), digit=digit)


def test_medians(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 501):
        v = np.round(rng.normal(0, 3, n), 1)
        assert R.median_of(frame(spark, [*v, None])) == np.median(v)
    assert R.median_of(frame(spark, [None, float("nan")])) is None


@pytest.mark.parametrize("n", [3, 5, 7])
def test_sliding_median(n):
    rng = np.random.default_rng(n)
    for share in (0.0, 0.05, 0.6):
        a = np.where(rng.random((23, 31)) < share, np.nan, np.round(rng.normal(size=(23, 31)), 1))
        p = np.pad(a, n // 2, mode="edge")
        got = R.sliding_median(a, n)
        for i in range(a.shape[0]):
            for j in range(a.shape[1]):
                w = p[i : i + n, j : j + n].ravel()
                w = w[~np.isnan(w)]
                assert np.array_equal(got[i, j], np.median(w) if len(w) else np.nan, equal_nan=True)
