"""Operators and queries that take every row, however large the table: held against brute force."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from climaspark.operators import raster as R

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def test_a_far_valid_cell_fills_the_whole_raster(spark):
    rows = 2_500
    cells = pd.DataFrame({"row": np.arange(rows, dtype="int32"), "col": np.int32(0), "elevation": np.nan})
    cells.loc[0, "elevation"] = 7.0
    raster = spark.createDataFrame(cells).selectExpr("row", "col", "nullif(elevation, double('NaN')) as elevation")
    got = R.filled(raster).toPandas()
    assert len(got) == rows and (got["elevation"] == 7.0).all()


def test_a_far_cell_beyond_the_range_of_int_squares(spark):
    raster = spark.createDataFrame([(0, 0, 5.0), (1, 0, None), (70_000, 0, None)], "row int, col int, elevation double")
    assert {r["elevation"] for r in R.filled(raster).collect()} == {5.0}


def test_a_raster_without_valid_cells_keeps_its_nulls(spark):
    raster = spark.createDataFrame([(i, 0, None) for i in range(5)], "row int, col int, elevation double")
    assert [r["elevation"] for r in R.filled(raster).collect()] == [None] * 5


@needs_data
def test_nearest_fill_of_all_rows(spark, tmp_path):
    from climaspark.jobs.queries import QUERIES

    # Rows from 400 on too: the smallest table's rows, repeated below themselves.
    one = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    n = 450
    table = one.iloc[np.arange(n) % len(one)].assign(vec_id=np.arange(n))
    table.to_parquet(tmp_path / "embeddings.parquet")
    e = 1200 + 1500 * np.stack(table["embedding"]).astype(float)
    i, j = np.indices(e.shape)
    valid = ((i * 7 + j * 13) % 11 > 3) | (i % 40 > 12)
    at = np.argwhere(valid)
    want = e.copy()
    for r, c in np.argwhere(~valid):
        d = ((at - (r, c)) ** 2).sum(1)
        want[r, c] = e[tuple(at[d.argmin()])]
    got = QUERIES["j_nearest_fill"](spark, str(tmp_path)).toPandas()
    assert len(got) == e.size
    filled = np.full(e.shape, np.nan)
    filled[got["row"], got["col"]] = got["elevation"]
    assert np.abs(filled - want).max() < 2e-6


@needs_data
@pytest.mark.parametrize("name", ["g_tile_ranges", "g_cells_in_box", "a_bounding_boxes", "s_geojson", "g_profile", "g_along_line"])
def test_every_point_has_its_box_or_line(spark, name):
    from climaspark.jobs.queries import QUERIES

    points = {str(n) for n in pd.read_parquet(f"{SF}/customer.parquet")["c_custkey"]}
    assert {str(r["name"]) for r in QUERIES[name](spark, SF).select("name").distinct().collect()} == points


def with_sql(spark, folder, name):
    """A query's rows and those of its SQL, sorted, over the tables in a folder."""
    from climaspark.jobs.queries import ORACLES, QUERIES

    got, con = QUERIES[name](spark, str(folder)), duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    want = con.execute(ORACLES[name])
    at = [[c[0] for c in want.description].index(c) for c in got.columns]
    return sorted(map(repr, map(tuple, got.collect()))), sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_places_beyond_the_projections_disc_have_no_degrees(spark, tmp_path):
    # 60,001 rows of 600 m reach farther north and south of the grid's middle than the whole globe does on the plane.
    pd.DataFrame({"vec_id": [0, 30_000, 60_000], "embedding": [[-0.5, 0.0], [0.25, 0.125], [0.0, 0.5]], "label": 1}).to_parquet(tmp_path / "embeddings.parquet")
    got, want = with_sql(spark, tmp_path, "a_elevation_stats")
    assert got == want and "nan, nan, nan, nan" in got[0]


def test_tile_files_of_a_raster_higher_than_the_map_of_zoom_8(spark, tmp_path):
    # Pixels from 35,160 to 135,160 of a map that has 65,536 at zoom 8; half of the raster's height is at 85,160.
    at = [0, 30_375, 30_376, 45_000, 50_087, 50_088, 99_999]
    pd.DataFrame({"vec_id": at, "embedding": [[i / 64, 0.5] for i in range(len(at))], "label": 1}).to_parquet(tmp_path / "embeddings.parquet")
    got, want = with_sql(spark, tmp_path, "s_tile_files")
    assert got == want and len(got) == 10


@needs_data
def test_a_daily_task_has_so_many_rows_however_large_the_table(spark, monkeypatch):
    from climaspark.jobs import views as V

    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(V, "TASK_ROWS", n // 10)
    daily = V.daily(spark, SF)
    # Days are filled in where their location lies: two exchanges, of lineitem's rows and of the daily ones.
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan
    assert daily.rdd.getNumPartitions() == -(-n // (n // 10))


def test_absent_days_of_repeated_dates_and_of_null_keys(spark):
    from datetime import date

    from climaspark.operators.daily import spine

    rows = [(1, date(2000, 1, 1), 5.0, 1.0), (1, date(2000, 1, 1), 6.0, None), (1, date(2000, 1, 3), 7.0, 2.0), (1, None, 9.0, 9.0), (None, date(2000, 1, 2), 8.0, 3.0)]
    got = spine(spark.createDataFrame(rows, "location int, date date, tmax double, prcp double")).collect()
    want = [(1, "2000-01-01", 5.0, 1.0), (1, "2000-01-01", 6.0, 0.0), (1, "2000-01-02", None, 0.0), (1, "2000-01-03", 7.0, 2.0), (None, "2000-01-02", None, 0.0)]
    assert sorted(((r["location"], str(r["date"]), r["tmax"], r["prcp"]) for r in got), key=repr) == sorted(want, key=repr)


@needs_data
def test_thresholds_meet_days_where_their_location_lies(spark, monkeypatch):
    from climaspark.jobs import views as V
    from climaspark.jobs.queries import QUERIES

    monkeypatch.setattr(V, "TASK_ROWS", spark.read.parquet(f"{SF}/lineitem.parquet").count() // 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # No days are dealt out for the join: its tasks are the daily view's, however large the table.
        for name in ("p_exceedance", "w_heatwaves", "a_annual_heat_indices"):
            plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "doy" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
        assert QUERIES["p_exceedance"](spark, SF).rdd.getNumPartitions() == V._daily_tasks(spark, SF) > 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_days_without_a_threshold_are_not_beyond_it(spark):
    from datetime import date

    from climaspark.operators.daily import exceedance

    days = [(k, date(*d), v) for k in (1, 2, None) for d, v in (((2000, 2, 29), 5.0), ((2001, 3, 1), 5.0), ((2001, 12, 31), 5.0), ((2000, 1, 1), None))] + [(1, None, 9.0)]
    thresholds = [(1, 60, 4.0), (1, 61, None), (1, 366, 4.5), (1, None, 0.0), (1, 1, 0.0), (None, 60, 0.0)]
    got = exceedance(spark.createDataFrame(days, "location int, date date, tmax double"), spark.createDataFrame(thresholds, "location int, doy int, threshold double"), "tmax")
    assert got.columns == ["location", "date", "tmax", "flag"] and got.count() == len(days)
    assert {(r["location"], str(r["date"])) for r in got.collect() if r["flag"]} == {(1, "2000-02-29"), (1, "2001-12-31")}
