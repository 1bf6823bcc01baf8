import math

import pytest

from climaspark.functions import distributions as S
from climaspark.operators import trends as T

# Two published yearly series from 1950 on, their published trends below.
HOT_DAYS_PCT = [8.22, 35.62, 12.02, 4.38, 31.51, 4.38, 3.55, 12.05, 3.01, 5.75, 6.01, 5.75, 6.3, 4.93, 6.56, 6.3, 13.7, 7.12, 21.04, 7.12, 10.96, 6.3, 12.3, 15.07, 2.47, 6.03, 3.55, 8.77, 5.48, 9.04, 6.56, 9.86, 9.86, 23.56, 9.29, 3.84, 4.66, 29.04, 11.75, 10.68, 13.15, 11.51, 29.78, 7.95, 25.75, 27.67, 19.95, 14.25, 26.3, 11.23, 5.74, 11.23, 22.19, 14.79, 12.3, 23.56, 10.96, 11.23, 10.66, 6.85, 13.97, 11.23, 15.3, 23.84, 19.73, 23.29, 28.96, 8.77, 21.37, 31.23, 23.22, 16.71, 9.86, 39.18, 50.82, 25.48]
HEATWAVE_EVENTS = [4, 17, 4, 2, 13, 2, 1, 5, 2, 2, 1, 4, 4, 3, 2, 3, 4, 3, 10, 1, 7, 2, 5, 6, 0, 1, 1, 3, 2, 4, 3, 4, 5, 10, 4, 1, 2, 13, 5, 3, 6, 5, 17, 1, 10, 13, 8, 4, 17, 7, 0, 3, 11, 8, 9, 10, 5, 7, 6, 3, 6, 5, 5, 12, 11, 14, 15, 4, 7, 13, 14, 6, 4, 19, 18, 15]


def rows(spark, *series, start=1900):
    return spark.createDataFrame([(n, start + i, None if v is None else float(v)) for n, s in enumerate(series) for i, v in enumerate(s)], "series int, year int, value double")


def test_least_squares(spark):
    got = T.linear_trend(rows(spark, [0.02 * i for i in range(100)])).first()
    assert got["slope_per_decade"] == pytest.approx(0.2) and got["r_squared"] == pytest.approx(1) and got["total_change"] == pytest.approx(0.02 * 99)


def test_periods(spark):
    d = rows(spark, [0] * 50 + [0.01 * i for i in range(50)])
    assert T.linear_trend(d, end=1949).first()["slope_per_decade"] == 0 and T.linear_trend(d, start=1950).first()["slope_per_decade"] == pytest.approx(0.1)


def test_short_series(spark):
    with pytest.raises(ValueError):
        T.fit_one(rows(spark, [1, 2]))
    got = T.linear_trend(rows(spark, [1, 2], [1, 2, 4])).orderBy("series").collect()
    assert got[0]["slope_per_decade"] is None and got[0]["p_value"] is None and got[1]["p_value"] is not None


def test_constant_series_has_r_squared_zero(spark):
    got = T.linear_trend(rows(spark, [3] * 10)).first()
    assert got["r_squared"] == 0 and got["slope_per_decade"] == 0


def test_hinge(spark):
    got = T.breakpoint(rows(spark, [0.03 * max(0, y - 1970) for y in range(1900, 2020)])).first()
    assert got["year"] == 1970 and abs(got["slope_before"]) < 1e-9 and got["slope_after"] == pytest.approx(0.3) and got["sse"] < got["sse_line"]


def test_rolling(spark):
    got = T.rolling_trend(rows(spark, [0.01 * i for i in range(40)])).orderBy("year").collect()
    assert [r["year"] for r in got] == list(range(1929, 1940)) and all(r["trend"] == pytest.approx(0.1) for r in got)


def test_decades_and_change(spark):
    assert [r["decade"] for r in T.decade_means(rows(spark, [1] * 25, start=1990)).orderBy("decade").collect()] == [1990, 2000]
    assert T.change_since(rows(spark, [0] * 21 + [1] * 10, start=1880)).first()["change"] == 1


def test_rolling_mean_windows(spark):
    got = {r["year"]: r["mean"] for r in T.rolling_mean(rows(spark, range(12)), 10).collect()}
    assert got[1905] == pytest.approx(4.5) and got[1904] is None and got[1908] is None
    assert {r["year"]: r["mean"] for r in T.rolling_mean(rows(spark, range(12)), 5).collect()}[1902] == 2


def test_sen_with_an_outlier(spark):
    values = [0.5 * i for i in range(70)]
    values[30] = 500
    got = T.sen_trend(rows(spark, values, start=1950)).first()
    assert got["slope_per_decade"] == pytest.approx(5.0) and got["significant"]


@pytest.mark.parametrize(("values", "slope", "low", "high", "p"), [(HOT_DAYS_PCT, 1.83, 1.26, 2.56, 1.3e-06), (HEATWAVE_EVENTS, 0.93, 0.53, 1.43, 5.6e-06)])
def test_published_trends(spark, values, slope, low, high, p):
    got = T.sen_trend(rows(spark, values, start=1950)).first()
    assert got["slope_per_decade"] == pytest.approx(slope, abs=0.03) and got["ci95_low"] == pytest.approx(low, abs=0.03) and got["ci95_high"] == pytest.approx(high, abs=0.03)
    assert float(f"{got['p_value']:.1e}") == pytest.approx(p, rel=0.1)


def test_two_forms_of_sen_agree(spark):
    d = rows(spark, HOT_DAYS_PCT, HEATWAVE_EVENTS)
    a = {r["series"]: r["slope_per_decade"] for r in T.sen_trend(d).collect()}
    b = {r["series"]: r["slope_per_decade"] for r in T.sen_slope(d).collect()}
    assert a == pytest.approx(b)


def test_t_distribution():
    assert S.t_quantile(0.975, 10) == pytest.approx(2.228138852) and S.t_quantile(0.975, 1) == pytest.approx(12.7062047)
    assert S.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9) and S.t_two_sided(0, 5) == pytest.approx(1)


def test_kendall_exact():
    assert S.kendall_two_sided(10, 5, 16.67, False) == pytest.approx(2 / math.factorial(5))
    assert S.kendall_two_sided(0, 4, 8.67, False) == pytest.approx(1, abs=0.3)
    assert S.kendall_two_sided(3, 1, 1, False) is None


def test_missing_values_are_left_out(spark):
    got = T.sen_trend(rows(spark, [1, None, 3, 4])).first()
    assert got["n"] == 3 and got["slope_per_decade"] == pytest.approx(10)


def test_headline_of_short_series_is_a_row_with_nulls(spark):
    got = T.headline(rows(spark, [1, 2, 3, 4]), 1902).first()
    assert got["break_year"] is None and got["latest_rolling"] is None and got["long_term"] == pytest.approx(10)
