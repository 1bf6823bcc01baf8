import random
from datetime import date, timedelta

from climaspark.functions.geo import EqualArea, Grid
from climaspark.jobs import workloads as W
from climaspark.operators import daily as D
from climaspark.operators import grid as G


def daily(spark, locations=("a", "b"), years=8):
    rng = random.Random(0)
    rows = [(k, date(1990, 1, 1) + timedelta(i), 25 + rng.gauss(0, 4), 12 + rng.gauss(0, 3), max(0.0, rng.gauss(-4, 12))) for k in locations for i in range(365 * years + 2)]
    return spark.createDataFrame(rows, "location string, date date, tmax double, tmin double, prcp double")


def test_extremes(spark, tmp_path):
    got = W.extremes(daily(spark), (1991, 1994), (1995, 1997))
    W.write(got, str(tmp_path))
    read = {n: spark.read.parquet(str(tmp_path / n)) for n in got}
    assert read["heat"].count() == 16 and read["trends"].count() == 2 * 15 and read["comparison"].count() == 2 * 15
    assert read["longest_heatwaves"].groupBy("location").count().where("count > 5").count() == 0 and "overlap_days" in read["compound"].columns


def test_a_table_dealt_by_location_is_not_dealt_again(spark):
    W.tuned(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = D.by_location(daily(spark, years=3), partitions=4)
        plan = D.annual_heat_indices(rows, (1990, 1991))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    other = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "hashpartitioning(location" not in line.replace("hashpartitioning(location#", "hashpartitioning(location")]
    assert not other and "ENSURE_REQUIREMENTS" not in plan


def test_seasons(spark):
    rows = [(date(y, m, 1), lat, 25.0, 20.0 + y % 3, 5.0 + (y * m) % 4) for y in range(1990, 2000) for m in range(1, 13) for lat in (-10.0, -14.0)]
    monthly = spark.createDataFrame(rows, "month date, lat double, lon double, t2m double, precip double")
    got = {n: t.collect() for n, t in W.seasons(monthly, G.cosine_weights(monthly), G.catalogue(spark, {1991: 1.7, 1997: 2.4, 2015: 2.6}), (1991, 1996)).items()}
    assert len(got["seasons"]) == 27 and len(got["catalogue_rain"]) == len(got["catalogue_heat"]) == 6 and got["catalogue_heat"][0]["season_value"] is not None and [r["season"] for r in got["missing"]] == [2015] and got["catalogue"][0]["seasons"] == 2


def test_long_term(spark):
    rng = random.Random(1)
    series = spark.createDataFrame([(k, 1900 + i, 0.01 * i + rng.gauss(0, 0.1)) for k in ("x", "y") for i in range(80)], "series string, year int, value double")
    got = W.long_term(series, 1950)
    assert all(t.select("series").distinct().count() == 2 for t in got.values())


def test_terrain(spark):
    grid = Grid(-20_000.0, 20_000.0, 1000.0, 40, 40)
    raster = spark.createDataFrame([(i, j, 1000.0 + 10 * j + (500 if (i, j) == (9, 9) else 0), True) for i in range(40) for j in range(40)], "row int, col int, elevation double, inside boolean")
    places = spark.createDataFrame([("centre", 28.0, -13.0)], "name string, lon double, lat double")
    lines = spark.createDataFrame([("l", -15_000.0, 0.0, 15_000.0, 0.0)], "name string, x0 double, y0 double, x1 double, y1 double")
    got = W.terrain(raster, grid, EqualArea(28.0, -13.0), places, lines, 31)
    assert got["stats"].first()["max_m"] == 1390 and abs(got["places"].first()["elevation"] - 1195) < 1e-6
    assert abs(sum(r["share_pct"] for r in got["bands"].collect()) - 100) < 1e-9 and got["features"].count() == 1 and got["profiles"].count() == 31
