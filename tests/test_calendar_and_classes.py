from datetime import date

import pytest
from pyspark.sql import functions as F

from climaspark.functions import calendar as cal
from climaspark.functions import classes


def days(spark, *texts):
    return spark.createDataFrame([(i, date.fromisoformat(t)) for i, t in enumerate(texts)], "i int, date date")


def values(df, *cols):
    return [r[0] for r in df.orderBy("i").select(*cols).collect()]


def test_leap_day_of_year(spark):
    assert values(days(spark, "2001-03-01", "2004-03-01", "2004-02-29", "2001-12-31"), cal.leap_day_of_year("date")) == [61, 61, 60, 366]


def test_season_labels(spark):
    d = days(spark, "2023-06-30", "2023-07-01", "2024-03-15")
    assert values(d, cal.season_of("date")) == [2022, 2023, 2023]
    assert values(d, cal.season_text(cal.season_of("date"))) == ["2022/23", "2023/24", "2023/24"]
    d = days(spark, "1997-09-01", "1997-10-01", "1997-12-01", "1998-01-01", "1998-03-01")
    assert values(d, cal.season_of("date", 10)) == [1996, 1997, 1997, 1997, 1997]
    assert values(days(spark, "1999-08-01"), cal.season_text(cal.season_of("date"))) == ["1999/00"]


def test_texts(spark):
    one = spark.createDataFrame([(0, -0.3), (1, -44.4), (2, 1.454), (3, None)], "i int, v double")
    assert values(one, cal.signed_text("v")) == ["0%", "-44%", "+1%", None]
    assert values(one, cal.signed_text("v", 2, " °C"))[2] == "+1.45 °C"
    p = spark.createDataFrame([(0, 33.35, -9.95), (1, -1.0, 2.5)], "i int, lon double, lat double")
    assert values(p, cal.degree_text("lon", "lat")) == ["9.95° S, 33.35° E", "2.50° N, 1.00° W"]


def test_open_bounds(spark):
    d = spark.range(10).withColumnRenamed("id", "v")
    assert d.where(cal.within("v", 3)).count() == 7 and d.where(cal.within("v", None, 3)).count() == 4 and d.where(cal.within("v")).count() == 10


def test_nan_is_missing(spark):
    d = spark.createDataFrame([(0, float("nan")), (1, 2.0)], "i int, v double")
    assert values(d, cal.number("v")) == [None, 2.0]


def test_step_classes(spark):
    d = spark.createDataFrame([(0, -80.0), (1, 0.0), (2, 12.0), (3, 99.0), (4, None), (5, -50.0)], "i int, v double")
    assert values(d, classes.step_class("v", classes.RAIN_EDGES)) == [0, 4, 5, 8, None, 1]
    assert values(d, classes.step_class("v", classes.RAIN_EDGES, 8))[4] == 8


def test_bands_close_at_the_top(spark):
    d = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 2.0), (3, 2.1), (4, -0.1)], "i int, v double")
    assert values(d, classes.band_of("v", (0.0, 1.0, 2.0))) == [0, 1, 1, None, None]


def test_ramp(spark):
    d = spark.createDataFrame([(0, 300.0), (1, 2300.0), (2, -500.0), (3, 9000.0), (4, 425.0), (5, None)], "i int, v double")
    got = values(d, classes.ramp("v"))
    assert tuple(got[0]) == pytest.approx(tuple(got[2])) and tuple(got[1]) == pytest.approx(tuple(got[3])) and got[0]["r"] == 0x1F / 255
    assert abs(got[4]["r"] - (0x1F + 0x3F) / 510) < 1e-12 and got[5]["r"] is None


def test_rain_predicates_of_nulls_are_false(spark):
    d = spark.createDataFrame([(0, None), (1, 1.0), (2, 0.99), (3, 20.0)], "i int, p double")
    assert values(d, classes.is_wet("p")) == [False, True, False, True]
    assert values(d, classes.is_dry("p")) == [False, False, True, False]
    assert values(d, classes.is_heavy("p")) == [False, False, False, True]
    assert d.where(F.lit(True)).count() == 4
