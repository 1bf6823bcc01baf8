import math
from datetime import date, datetime

import numpy as np
import pytest

from climaspark.operators import grid as G
from climaspark.streaming.area import area_daily_stream


def monthly(spark, first, last, rain=lambda y, m: 5.0, temp=lambda y, m: 20.0, lats=(-10.0, -10.25), lons=(25.0, 25.25, 25.5)):
    rows = [(date(y, m, 1), a, o, temp(y, m), rain(y, m)) for y in range(first, last + 1) for m in range(1, 13) for a in lats for o in lons]
    return spark.createDataFrame(rows, "month date, lat double, lon double, t2m double, precip double")


def test_season_totals(spark):
    got = G.seasonal(monthly(spark, 1990, 2022))
    assert sorted(r["season"] for r in got.select("season").distinct().collect()) == list(range(1990, 2022))
    r = got.where("season = 1997").first()
    assert r["rain"] == 5 * 182 and r["temp"] == 20


def test_a_missing_month_makes_the_cell_missing_and_not_the_season(spark):
    d = monthly(spark, 1990, 1991, rain=lambda y, m: None if (y, m) == (1990, 12) else 5.0)
    r = G.seasonal(d).where("season = 1990").first()
    assert r["rain"] is None and r["temp"] == 20


def test_climatology_needs_all_base_seasons(spark):
    got = G.climatology(G.seasonal(monthly(spark, 1990, 2022)), (1991, 2020)).first()
    assert got["rain"] == pytest.approx(5 * 182, rel=0.01) and got["temp"] == 20
    with pytest.raises(ValueError, match="30 complete seasons"):
        G.climatology(G.seasonal(monthly(spark, 1995, 2022)), (1991, 2020))


def test_monthly_anomalies(spark):
    d = monthly(spark, 1991, 2021, rain=lambda y, m: 40.0 if (y, m) == (2016, 2) else 100.0 if m == 2 else 50.0, temp=lambda y, m: 24.0 if (y, m) == (2016, 2) else 22.0, lats=(-10.0,), lons=(25.0,))
    got = {r["month"]: r for r in G.monthly_anomalies(d, ("precip", "t2m"), (1991, 2020)).collect()}
    assert got[date(2016, 2, 1)]["precip"] == pytest.approx(40 - (29 * 100 + 40) / 30) and got[date(2016, 2, 1)]["t2m"] == pytest.approx(24 - (29 * 22 + 24) / 30)
    assert got[date(2016, 3, 1)]["precip"] == pytest.approx(0)


def test_area_mean_skips_missing(spark):
    field = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 1.0, 3.0), (1.0, 0.0, None), (1.0, 1.0, 10.0)], "lat double, lon double, x double")
    weights = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 1.0, 1.0), (1.0, 0.0, 5.0), (1.0, 1.0, 0.0)], "lat double, lon double, w double")
    assert field.join(weights, ["lat", "lon"]).agg(G.weighted_mean("x")).first()[0] == 2.0
    assert field.where("false").join(weights, ["lat", "lon"]).agg(G.weighted_mean("x")).first()[0] is None
    got = G.area_above(field, weights, "x", 2.0, ()).first()
    assert got["share_above"] == 50 and not got["everywhere"]


def test_halves_are_the_whole(spark):
    d = G.seasonal(monthly(spark, 1991, 1993, lats=(-10.0, -13.5, -14.0)))
    w = G.cosine_weights(d)
    got = G.season_table(d, G.normals(d, 2), w)
    assert sorted({r["region"] for r in got.collect()}) == ["all", "north", "south"]
    north = w.where("lat >= -13.5").agg({"w": "sum"}).first()[0] + w.where("lat < -13.5").agg({"w": "sum"}).first()[0]
    assert north == pytest.approx(w.agg({"w": "sum"}).first()[0])
    ranks = G.ranked(got).where("region = 'south'").orderBy("dry_rank").collect()
    assert [r["dry_rank"] for r in ranks] == [1, 2] and [r["season"] for r in ranks] == [1992, 1991]  # the first has a 29 February


def test_catalogue(spark):
    table = spark.createDataFrame([(1997, "south", -10.0, 0.5), (1998, "south", -20.0, 0.1), (1997, "north", 5.0, 0.3)], "season int, region string, rain_pct double, temp_anomaly double")
    e = G.catalogue(spark, {1997: 2.4, 2015: 2.6})
    assert [r["season"] for r in G.missing_events(e, table).collect()] == [2015] and [r["season"] for r in G.present_events(e, table).collect()] == [1997]
    assert [r["season"] for r in G.driest_others(table, e).collect()] == [1998]
    assert tuple(G.catalogue_summary(table, e).first()) == (1, 1, -10.0, 5.0)
    assert [r["season"] for r in G.absent_seasons(table.where("season = 1997").union(table.where("season = 1998").selectExpr("2000", "region", "rain_pct", "temp_anomaly"))).orderBy("season").collect()] == [1998, 1999]


def test_fields_must_cover_the_same_months(spark):
    t = spark.createDataFrame([(datetime(2000, 1, 5), 1.0, 2.0, 300.0)], "time timestamp, lat double, lon double, t2m double")
    p = spark.createDataFrame([(datetime(2000, 1, 9), 1.0, 2.0, 0.004)], "time timestamp, lat double, lon double, tp double")
    got = G.joined_fields(t, p).first()
    assert got["month"] == date(2000, 1, 1) and got["t2m"] == pytest.approx(26.85) and got["precip"] == pytest.approx(4)
    with pytest.raises(ValueError, match="months"):
        G.joined_fields(t, p.selectExpr("timestamp'2000-02-01' as time", "lat", "lon", "tp"))


def test_area_daily_in_batch_and_stream(spark, tmp_path):
    cells = spark.createDataFrame([(datetime(2000, 1, 1, h), -10.0, 25.0 + i / 4, float(i), 1.0, 0.0) for h in (3, 5) for i in range(3)] + [(datetime(2000, 1, 9), -10.0, 25.0, 0.0, 0.0, 0.0)], "time timestamp, lat double, lon double, tmax double, tmin double, prcp double")
    boxes = spark.createDataFrame([("d", -11.0, -9.0, 25.0, 25.3)], "district string, south double, north double, west double, east double")
    got = G.area_daily(cells.selectExpr("date(time) as date", "lat", "lon", "tmax", "tmin", "prcp"), boxes).where("date = '2000-01-01'").first()
    assert got["tmax"] == 0.5
    cells.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cells.schema).parquet(str(tmp_path / "in"))
    q = area_daily_stream(stream, boxes).writeStream.format("memory").queryName("area").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["date"], r["tmax"]) for r in spark.table("area").collect()] == [(date(2000, 1, 1), 0.5)]


def test_weights_follow_latitude(spark):
    got = G.cosine_weights(monthly(spark, 2000, 2000, lats=(0.0, 60.0), lons=(1.0,))).orderBy("lat").collect()
    assert got[0]["w"] == 1 and got[1]["w"] == pytest.approx(math.cos(math.radians(60)))


def test_boxes_of_any_size(spark):
    """Fields, strips, points, the world: few rectangles each, and the cells of every box as by comparing all."""
    rng = np.random.default_rng(0)
    boxes = [("world", -90.0, 90.0, -180.0, 180.0), ("strip", -10.0, -9.99, -180.0, 180.0), ("point", 5.0, 5.0, 5.0, 5.0), ("turned", 5.0, 4.0, 0.0, 1.0), ("null", None, 1.0, 0.0, 1.0)]
    boxes += [(f"b{i}", float(a), float(a + h), float(o), float(o + w)) for i, (a, o, h, w) in enumerate(zip(rng.uniform(-80, 70, 40), rng.uniform(-170, 150, 40), 10 ** rng.uniform(-3, 1.5, 40), 10 ** rng.uniform(-3, 1.5, 40), strict=True))]
    districts = spark.createDataFrame(boxes, "district string, south double, north double, west double, east double")
    cells = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300), strict=True))] + [(300, 5.0, 5.0), (301, -10.0, 180.0), (302, None, 1.0)]
    d = spark.createDataFrame(cells, "i int, lat double, lon double")
    want = {(i, n) for i, a, o in cells for n, s, e, w, x in boxes if a is not None and s is not None and s <= a <= e and w <= o <= x}
    got = [(r["i"], r["district"]) for r in G.in_districts(d, districts).collect()]
    assert len(got) == len(want) and set(got) == want
    assert max(r["count"] for r in G.codes_of(districts).groupBy("district").count().collect()) <= 9
    assert G.in_districts(d, districts.where("false")).count() == 0
