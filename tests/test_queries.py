"""Every query of the reference work against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def names():
    from climaspark.jobs.queries import ORACLES

    return list(ORACLES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 5) + 0.0
    return str(value)[:10] if hasattr(value, "year") else value


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from climaspark.jobs.queries import ORACLES, QUERIES

    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    assert all(close(x, y) for p, q in zip(a, b) for x, y in zip(p, q))


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.entry(spark).columns) == 9
