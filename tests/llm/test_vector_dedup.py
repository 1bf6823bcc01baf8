import duckdb
import numpy as np
import pandas as pd
import pytest

from climaspark.llm import vector_dedup as V
from climaspark.llm.oracles import ORACLES
from climaspark.llm.queries import op12_vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, `key` string"


def brute(rows, like=0.93):
    """(vec_id, n_links, component_id, kept) by every pair."""
    def good(v, label):
        return v is not None and label is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)

    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i, (_, v, a, *_) in enumerate(rows):
        for j, (_, w, b, *_) in enumerate(rows):
            if i != j and good(v, a) and good(w, b) and a == b and len(v) == len(w):
                x, y = (np.array(z, np.float32).astype(float) for z in (v, w))
                linked[i, j] = (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= like
    out, seen = [], np.full(n, -1)
    for i in range(n):
        if seen[i] < 0:
            front = [i]
            seen[i] = i
            while front:
                for j in np.flatnonzero(linked[front.pop()]):
                    if seen[j] < 0:
                        seen[j] = i
                        front.append(j)
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(seen == seen[i]) if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((r[0], int(linked[i].sum()), least, r[0] == least))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def planted(rng, n, d=16, groups=12, noise=(0.02, 0.5)):
    """Vectors, of which some are noisy copies of others: cosines all about the threshold."""
    base = rng.normal(size=(n, d))
    for i in range(n // 2):
        base[i] = base[rng.integers(n // 2, n // 2 + groups)] + rng.normal(size=d) * rng.uniform(*noise)
    base[3] = base[4]
    return [(i, v.tolist(), i % 3 if i % 20 else None, "x") for i, v in enumerate(base.astype(np.float32))]


@pytest.mark.parametrize(("seed", "cells", "like"), [(0, None, 0.93), (1, 1, 0.93), (2, 24, 0.93), (3, 24, 0.6), (4, 40, 0.99)])
def test_brute_force(spark, monkeypatch, seed, cells, like):
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "QUERIES", 9)
    rows = planted(np.random.default_rng(seed), 360)
    got = result(V.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), like, cells))
    assert got == brute(rows, like) and 20 < sum(r[1] > 0 for r in got) < 360


def test_no_probe_or_filter_loses_a_pair():
    """Of pairs at the very threshold, the lower cell's vector looks in the other's cell and the code passes."""
    rng = np.random.default_rng(5)
    x = V.unit(list(rng.normal(size=(3000, 32))))
    direction = rng.normal(size=x.shape)
    direction -= (direction * x).sum(1)[:, None] * x
    y = V.LIKE * x + (1 - V.LIKE**2) ** 0.5 * direction / np.sqrt((direction**2).sum(1))[:, None]
    index = V.Index(V.k_means(x[:1500], 40), np.stack([V.k_means(np.ascontiguousarray(x[:1500, 2 * p : 2 * p + 2]), 64) for p in range(V.PARTS)]))
    (a, p), (b, q) = V.probed(index, x, V.LIKE), V.probed(index, y, V.LIKE)
    assert np.where(a <= b, p[np.arange(len(x)), b], q[np.arange(len(x)), a]).all()
    assert p.sum(1).mean() < 30
    code = index.encode(y, b)
    lists = pd.DataFrame({"node": [b"%05d" % i for i in range(len(y))], "copies": 1, "code": [c.tobytes() for c in code], "v": [v.tobytes() for v in y * 0.5]})
    r = (y - index.centroids[b]).reshape(len(y), V.PARTS, -1)
    lists["err"] = np.sqrt(sum(((r[:, k] - index.books[k][code[:, k]]) ** 2).sum(1) for k in range(V.PARTS)))
    asked = pd.DataFrame({"node": [b"x%05d" % i for i in range(len(x))], "copies": 1, "own": False, "v": [v.tobytes() for v in x * 3]})
    found = 0
    for c in range(40):
        there = np.flatnonzero(b == c)
        out = V.links_of(index, c, V.LIKE - 1e-9, lists.iloc[there], asked.iloc[there])
        found += len({n for n in out["node"][out["links"] > 0] if n[:1] == b"x"})
    assert found == len(x)


def test_odd_vectors(spark):
    v = [[1.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0, 0.1], [1.0], [2.0, 0.0], [-0.0, 1.0], [0.0, 1.0], [1e-30, 0.0], [2.0], []]
    rows = [(i, x, 1, "x") for i, x in enumerate(v)] + [(None, [1.0, 0.0], 1, "x"), (None, [5.0, -5.0], 1, "x"), (0, [1.0, 0.0], 1, "x"), (0, [0.0, 1.0], None, "x"), (-7, [1.0, 0.1], 1, "x"), (-8, [1.0, 0.0], 2, "x")]
    d = spark.createDataFrame(rows, SCHEMA)
    assert result(V.near_duplicates(d)) == brute(rows)
    assert V.near_duplicates(d.where("false")).count() == 0
    assert result(V.near_duplicates(d.where("vec_id = 1"))) == [(1, 0, 1, True)]
    with pytest.raises(ValueError):
        V.near_duplicates(d, 0)


def test_large_and_small_components(spark):
    rows = [(i, x, 0) for i, x in enumerate([[1e200, 0.0], [1e200, 1e199], [1e-200, 0.0], [-1e300, 1.0]])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(V.near_duplicates(d)) == [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 0, 3, True)]


def test_hot_group(spark, monkeypatch):
    """Copies and near copies of one vector: counts are whole, and few edges come out."""
    monkeypatch.setattr(V, "BLOCK", 128)
    rng = np.random.default_rng(7)
    one = rng.normal(size=32)
    rows = [(i, (one if i % 3 == 0 else one + rng.normal(size=32) * 0.01 if i % 3 == 1 else rng.normal(size=32)).astype(np.float32).tolist(), 4, "x") for i in range(1800)]
    got = V.near_duplicates(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("vec_id")
    near = got[got.index % 3 < 2]
    assert (near["n_links"] == 1199).all() and (near["component_id"] == 0).all() and (got[got.index % 3 == 2]["n_links"] == 0).all()
    rng.shuffle(rows)
    x = V.unit([np.array(r[1], float) for r in rows if r[0] % 3 == 1])
    assert len(list(V.forest(x @ x.T >= 0.93))) == 2 * len(x) - 1


def test_whole_table(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    found = con.sql(ORACLES["op12_vector_dedup"])
    order = [found.columns.index(c) for c in ("vec_id", "n_links", "component_id", "kept")]
    assert result(op12_vector_dedup(spark, sf)) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=str)
