import json
from datetime import date

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from climaspark.operators import trends as T
from climaspark.sources import sinks, tables

HEADER = "Year,Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec,J-D,D-N,DJF,MAM,JJA,SON"


def test_anomaly_table(spark, tmp_path):
    lines = ["Land-Ocean: Means", HEADER, "1880,-.19" + ",.1" * 11 + ",-.17,***,***,.1,.1,.1", "1881" + ",.1" * 12 + ",-.09" + ",.1" * 5, "2026,.1" + ",***" * 17]
    (tmp_path / "global.csv").write_text("\n".join(lines))
    (tmp_path / "north.csv").write_text("\n".join(lines[:3]))
    got = tables.anomaly_tables(spark, str(tmp_path))
    g = {r["year"]: r for r in got.where("region = 'global'").collect()}
    assert sorted(g) == [1880, 1881, 2026] and g[1880]["jan"] == -0.19 and g[1880]["dn"] is None and g[1880]["djf"] is None
    assert [tuple(r) for r in T.annual_series(got).where("region = 'global'").orderBy("year").collect()] == [("global", 1880, -0.17), ("global", 1881, -0.09)]
    assert got.select("region").distinct().count() == 2


def test_anomaly_lines_of_many_regions_in_a_file(spark, tmp_path):
    (tmp_path / "part-0").write_text(f"north,Land-Ocean: Means\nnorth,{HEADER}\nnorth,1880" + ",.1" * 12 + ",-.17" + ",***" * 5 + "\nsouth,1880" + ",.2" * 12 + ",***" * 6 + "\n")
    (tmp_path / "part-1").write_text("south,1881" + ",.2" * 12 + ",.3" + ",.1" * 5 + "\n\n")
    got = tables.anomaly_tables(spark, str(tmp_path), keyed=True)
    assert sorted((r["region"], r["year"], r["jan"], r["jd"]) for r in got.collect()) == [("north", 1880, 0.1, -0.17), ("south", 1880, 0.2, None), ("south", 1881, 0.2, 0.3)]


def test_anomaly_table_has_no_file_a_region_and_rounds_as_its_sql(spark, tmp_path, monkeypatch):
    from climaspark.jobs.queries import ORACLES, QUERIES

    folder, n = tmp_path / "files", 300
    monkeypatch.setattr(sinks, "shared_folder", lambda *_: str(folder))
    # Ties of the fourth place, which binary fractions miss by a bit.
    orders = pd.DataFrame({"o_orderpriority": "1-URGENT", "o_custkey": np.arange(n) * 300, "o_orderdate": pd.Timestamp("1996-02-01"), "o_totalprice": 10_000.5 + np.arange(n)})
    orders.to_parquet(tmp_path / "orders.parquet")
    got = sorted((r["region"], r["year"], r["value"]) for r in QUERIES["s_anomaly_table"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    assert got == sorted(con.execute(ORACLES["s_anomaly_table"]).fetchall()) and len(got) == n
    assert len(list(folder.rglob("*.txt"))) < n / 10


def test_payloads_of_one_cell_and_of_many(spark):
    cell = {"daily": {"time": ["2000-01-01", "2000-01-02"], "temperature_2m_max": [1.0, None], "temperature_2m_min": [0.0, 0.5], "precipitation_sum": [0.0, 2.0]}}
    d = spark.createDataFrame([("a", json.dumps(cell)), ("b", json.dumps([cell, cell]))], "location string, payload string")
    got = tables.daily_payloads(d)
    assert got.count() == 6 and got.where("location = 'b'").select("cell").distinct().count() == 2
    assert got.where("location = 'a' and date = '2000-01-02'").first()["tmax"] is None


def test_daily_table_prunes_dates_and_nans(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([("a", date(2000, 1, d), float("nan"), 1.0, 0.0) for d in (1, 2, 3)], tables.DAILY).write.parquet(path)
    got = tables.daily_table(spark, path, "2000-01-02")
    assert got.count() == 2 and got.first()["tmax"] is None
    assert "GreaterThanOrEqual(date,2000-01-02)" in got._jdf.queryExecution().executedPlan().toString()


def test_shapes(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [{"type": "Feature", "properties": {"name": n}, "geometry": g} for n, g in (("p", {"type": "Polygon", "coordinates": [ring]}), ("m", {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}), ("none", None))]
    (tmp_path / "s.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = {r["name"]: r["geometry"] for r in tables.shapes(spark, str(tmp_path / "s.json")).collect()}
    assert len(got["p"]) == 1 and len(got["m"]) == 2 and got["none"] is None and got["p"][0][0][2] == [1.0, 1.0]


def test_sink_rounds_half_to_even(spark, tmp_path):
    d = spark.createDataFrame([("a", 0.125), ("b", 0.375)], "location string, v double")
    sinks.write_indices(d, str(tmp_path / "o"), 2)
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [0.12, 0.38]
    assert d.select(F.round("v", 2)).count() == 2
