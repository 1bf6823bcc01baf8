import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from climaspark.functions.classes import is_dry
from climaspark.operators import daily as D

SCHEMA = "location string, date date, tmax double, tmin double, prcp double"


def series(spark, start, tmax=None, prcp=None, tmin=None, location="a"):
    n = len(tmax or prcp or tmin)
    first = date.fromisoformat(start)
    at = lambda s, i: None if s is None or s[i] is None else float(s[i])
    return spark.createDataFrame([(location, first + timedelta(i), at(tmax, i), at(tmin, i), at(prcp, i)) for i in range(n)], SCHEMA)


def test_spells(spark):
    d = series(spark, "2000-01-01", [0, 1, 1, 1, 0, 1, 0, 1, 1])
    got = D.spells(d, F.col("tmax") > 0, 2).orderBy("start").collect()
    assert [r["length"] for r in got] == [3, 2] and got[0]["start"] == date(2000, 1, 2) and got[1]["end"] == date(2000, 1, 9)


def test_spell_lengths_sum_to_true_rows(spark):
    rng = random.Random(3)
    d = series(spark, "2000-01-01", [rng.choice([0, 1, None]) for _ in range(400)])
    assert D.spells(d, F.col("tmax") > 0).agg(F.sum("length")).first()[0] == d.where("tmax > 0").count()


def test_constant_percentile(spark):
    d = series(spark, "1961-01-01", [25.0] * (4 * 365 + 1))
    got = D.daily_percentile(d, "tmax", 90, (1961, 1964)).collect()
    assert len(got) == 366 and {r["threshold"] for r in got} == {25.0}


def test_percentile_pool_wraps_around_the_year(spark):
    d = series(spark, "2001-01-01", [100.0 if i in (0, 364) else 1.0 for i in range(365)])
    got = {r["doy"]: r["threshold"] for r in D.daily_percentile(d, "tmax", 100, (2001, 2001)).collect()}
    assert got[366] == 100 and got[1] == 100 and got[364] == 100 and got[3] == 100 and got[180] == 1


def test_heatwave(spark):
    d = series(spark, "2000-06-01", [20, 30, 30, 20, 30, 30, 30, 31, 20])
    thr = spark.createDataFrame([("a", i, 25.0) for i in range(1, 367)], "location string, doy int, threshold double")
    got = D.heatwaves(d, thr).collect()
    assert len(got) == 1 and got[0]["length"] == 4 and got[0]["peak"] == 31


def test_missing_value_breaks_a_heatwave_and_counts_as_not_hot(spark):
    thr = spark.createDataFrame([("a", i, 25.0) for i in range(1, 367)], "location string, doy int, threshold double")
    d = series(spark, "2000-06-01", [30, 30, None, 30, 30])
    assert D.heatwaves(d, thr).count() == 0
    assert D.exceedance(d, thr, "tmax").where("flag is null").count() == 0


def test_heatwave_over_new_year_belongs_to_its_start(spark):
    events = spark.createDataFrame([("a", date(2000, 12, 30), date(2001, 1, 2), 4, 31.0)], "location string, start date, end date, length int, peak double")
    assert [tuple(r) for r in D.heatwave_years(events).collect()] == [("a", 2000, 1, 4, 4)]


def test_annual_indices_of_complete_years_only(spark):
    n = 365 + 366 + 100
    d = series(spark, "1999-01-01", [20 + (i % 7) for i in range(n)], tmin=[i % 5 for i in range(n)])
    got = D.annual_heat_indices(d, (1999, 2000)).orderBy("year").collect()
    assert [r["year"] for r in got] == [1999, 2000] and got[0]["txx"] == 26 and got[0]["tnn"] == 0 and got[0]["heatwave_events"] == 0


def rain(spark, wet, days=365, start="2000-07-01"):
    values = [0.0] * days
    for day, mm in wet.items():
        values[(date.fromisoformat(day) - date.fromisoformat(start)).days] = mm
    return series(spark, start, prcp=values)


def test_rain_onset_passes_over_a_false_start(spark):
    wet = {"2000-10-10": 25.0, "2000-11-20": 25.0}
    d = date(2000, 11, 22)
    while d <= date(2001, 3, 31):
        wet[d.isoformat()] = 5.0
        d += timedelta(3)
    got = D.rain_onset(rain(spark, wet)).collect()
    assert len(got) == 1 and got[0]["onset"] == date(2000, 11, 20) and got[0]["onset_day"] == 50


def test_no_onset_without_thirty_days_ahead(spark):
    assert D.rain_onset(rain(spark, {"2000-10-20": 30.0}, days=120)).first()["onset"] is None


def onset_day_by_day(values, start):
    days = {start + timedelta(i): v for i, v in enumerate(values)}
    season = [d for d in days if d >= date(start.year, 10, 1)]
    for i, d in enumerate(season):
        if i < 2 or sum(days[x] for x in season[i - 2 : i + 1]) < 20:
            continue
        ahead = [x for x in season if d < x <= d + timedelta(30)]
        if len(ahead) < 30:
            return None
        run = worst = 0
        for x in ahead:
            run = run + 1 if days[x] < 1 else 0
            worst = max(worst, run)
        if worst < 10:
            return d
    return None


def test_onset_equals_a_search_day_by_day(spark):
    rng = random.Random(7)
    seasons = {f"s{i}": [rng.choice([0.0, 0.0, 0.0, 2.0, 9.0, 15.0]) for _ in range(rng.choice([150, 365]))] for i in range(25)}
    rows = [(k, date(2000, 7, 1) + timedelta(i), None, None, v) for k, s in seasons.items() for i, v in enumerate(s)]
    got = {r["location"]: r["onset"] for r in D.rain_onset(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: onset_day_by_day(s, date(2000, 7, 1)) for k, s in seasons.items()}


def test_seasonal_rain_indices(spark):
    got = D.seasonal_rain_indices(rain(spark, {"2000-12-01": 30.0, "2000-12-02": 10.0, "2000-12-06": 5.0}), (2000, 2000)).first()
    assert (got["season"], got["total_mm"], got["wet_days"], got["rx1day_mm"], got["rx5day_mm"], got["heavy_days"]) == (2000, 45.0, 3, 30.0, 40.0, 1)
    assert got["very_wet_mm"] == 30.0 and got["longest_dry_spell"] == 115


def test_season_without_a_dry_day_has_spell_zero(spark):
    assert D.longest_dry_spell(series(spark, "2000-07-01", prcp=[5.0] * 365)).first()["longest_dry_spell"] == 0


def test_spine_fills_gaps(spark):
    d = spark.createDataFrame([("a", date(2000, 1, 1), 1.0, 1.0, 1.0), ("a", date(2000, 1, 4), 1.0, 1.0, 1.0)], SCHEMA)
    got = D.spine(d).orderBy("date").collect()
    assert len(got) == 4 and got[1]["tmax"] is None and got[1]["prcp"] == 0.0


def test_dry_spells_are_clipped_to_the_window(spark):
    d = series(spark, "2000-01-01", prcp=[0.0] * 60)
    got = D.dry_spells(d, "2000-01-10", "2000-01-25", 10).first()
    assert got["start"] == date(2000, 1, 10) and got["length"] == 16


def test_overlap_days_and_no_pair_twice(spark):
    e = spark.createDataFrame([("a", date(1999, 12, 20), date(2000, 1, 10))], "location string, start date, end date")
    w = spark.createDataFrame([("a", date(1999, 12, 25), date(2000, 1, 5)), ("a", date(2000, 1, 11), date(2000, 2, 1)), ("b", date(2000, 1, 1), date(2000, 1, 2))], "location string, start date, end date")
    assert [r["overlap_days"] for r in D.overlapping(e, w).collect()] == [12]


def test_monthly_anomaly_and_table(spark):
    d = series(spark, "1999-01-01", [float(10 + (i >= 365)) for i in range(730)])
    a = D.monthly_anomaly(d, "tmax", (1999, 1999))
    assert {(r["year"], round(r["anomaly"], 9)) for r in a.collect()} == {(1999, 0.0), (2000, 1.0)}
    assert D.anomaly_table(a).columns == ["location", "year", *map(str, range(1, 13))]


def test_compare_periods_divides_by_zero_to_null(spark):
    t = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 4.0)], "location string, year int, x double")
    got = D.compare_periods(t, ["x"], (1, 1), (2, 2)).first()
    assert got["ratio"] is None and got["recent_mean"] == 4


def test_one_shuffle_by_location(spark):
    d = D.by_location(series(spark, "2000-01-01", [1.0] * 20), partitions=4)
    plan = D.spells(d, F.col("tmax") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("empty", [True])
def test_empty_tables(spark, empty):
    d = spark.createDataFrame([], SCHEMA)
    assert D.annual_heat_indices(d, (1990, 2000)).count() == 0 and D.seasonal_rain_indices(d, (1990, 2000)).count() == 0
    assert D.spells(d, is_dry("prcp")).count() == 0


def test_spells_across_blocks_are_those_of_the_whole(spark):
    """Any cut: runs within, over and along whole blocks, gaps in the order, blocks without a true row."""
    rng = random.Random(6)
    rows = []
    for k in range(6):
        share = (0.1, 0.5, 0.9, 0.98, 0.0, 1.0)[k]
        at = -37
        for _ in range(160):
            at += rng.choice([1, 1, 1, 1, 2, 30 if k % 2 else 1])
            rows.append((k, at, rng.choice([None, False]) if rng.random() >= share else True, float(rng.randrange(50))))
    d = spark.createDataFrame(rows, "location int, at int, flag boolean, v double")
    want = []
    for k in range(6):
        run = []
        for _, at, flag, v in [r for r in rows if r[0] == k] + [(k, 10**6, False, 0.0)]:
            if flag:
                run.append((at, v))
            elif run:
                want.append((k, run[0][0], run[-1][0], len(run), max(x for _, x in run)))
                run = []
    dated = d.withColumn("date", F.date_from_unix_date("at"))
    for block in (1, 3, 7, 40, 5000):
        assert sorted(tuple(r) for r in D.spells(d, "flag", 1, order="at", peak="v", block=block).collect()) == sorted(want)
        got = D.spells(dated, "flag", 4, peak="v", block=block).select("location", F.unix_date("start"), F.unix_date("end"), "length", "peak").collect()
        assert sorted(tuple(r) for r in got) == sorted(w for w in want if w[3] >= 4)
    text = d.where("location = 1").withColumn("name", F.format_string("%06d", F.col("at") + 100))
    assert D.spells(text, "flag", 1, order="name").count() == sum(w[0] == 1 for w in want)


def test_a_long_series_is_spread(spark):
    d = spark.range(20_000).select((F.col("id") % 1).alias("location"), F.col("id").alias("at"), (F.col("id") % 1000 != 500).alias("flag"))
    got = D.spells(d, "flag", 1, order="at")
    assert got.count() == 21 and got.agg(F.max("length"), F.sum("length")).first()[:] == (999, 19_980)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(location#" in plan and ", _block#" in plan


def test_overlaps_of_intervals_of_any_length(spark):
    rng = random.Random(9)
    first = date(1999, 1, 1)

    def some(n):
        out = []
        for i in range(n):
            at = rng.randrange(1500)
            out.append((rng.randrange(2), i, first + timedelta(at), first + timedelta(at + rng.choice([0, 1, 5, 31, 32, 200, 900, -1]))))
        return out

    a, b = some(60), some(60)
    want = sorted((k, i, j, (min(e, f) - max(s, t)).days + 1) for k, i, s, e in a for m, j, t, f in b if k == m and s <= e and t <= f and s <= f and t <= e)
    x, y = spark.createDataFrame(a, "location int, i int, start date, end date"), spark.createDataFrame(b, "location int, j int, start date, end date")
    for days in (1, 7, 32, 5000):
        assert sorted(tuple(r) for r in D.overlapping(x, y, days=days).select("location", "i", "w_j", "overlap_days").collect()) == want
