import os

import numpy as np
import pytest

from climaspark.llm import ann as A
from climaspark.llm.queries import op9_nearest_neighbours, table

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(ids, v, k=5, every=50):
    ids, v = np.array(ids), np.array(v, float)
    n = np.sqrt((v * v).sum(1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (v * v[i]).sum(1) / (n * n[i])
        s[i] = -9
        o = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in o]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = sum(len({x for _, x, _ in found[q]} & {x for x, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values())), found


def test_whole_table(spark, sf):
    rows = table(spark, sf, "embeddings").collect()
    want = exact([r["vec_id"] for r in rows], [r["embedding"] for r in rows])
    share, found = recall(op9_nearest_neighbours(spark, sf).collect(), want)
    assert share >= 0.9 and set(found) == set(want)
    for q, hits in found.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, len(want[q]) + 1)) and [h[2] for h in hits] == sorted((h[2] for h in hits), reverse=True)


def test_hot_vector_and_ties(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 64)
    monkeypatch.setattr(A, "QUERIES", 8)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[::3] = v[0]
    d = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA)
    want = exact(range(900), v)
    share, found = recall(A.search(d).collect(), want)
    assert share >= 0.95
    assert [x for _, x, _ in sorted(found[0])] == [3, 6, 9, 12, 15] and [x for _, x, _ in sorted(found[150])] == [0, 3, 6, 9, 12]


def test_vectors_that_take_no_part(spark):
    v = [[1.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0, 1.0], [1.0], [0.5, 0.0]]
    d = spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)] + [(None, [1.0, 2.0], 0)], SCHEMA)
    got = A.search(d).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 8), (0, 2, 6)] and got[0]["score"] == 1
    assert A.search(d.where("false")).count() == 0 and A.search(d.where("vec_id = 0")).count() == 0


def test_repeated_ids_are_rows_each(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (1, [1.0, 0.1], 0), (2, [0.0, 1.0], 0)], SCHEMA)
    assert [(r["rank"], r["vec_id"]) for r in A.search(d).orderBy("rank").collect()] == [(1, 1), (2, 1), (3, 2)]
    twice = spark.createDataFrame([(0, [1.0, 0.0], 0), (0, [1.0, 0.5], 0)], SCHEMA)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in A.search(twice).collect()] == [(0, 1, 0)] * 2


def test_large_and_small_components(spark):
    v = [[1e200, 0.0], [1e200, 1e200], [1e-200, 0.0], [-1e300, 1.0]]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = A.search(d).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 9)) for r in got] == [(2, 1.0), (1, round(0.5**0.5, 9)), (3, -1.0)]


def test_lengths_are_indexes_of_their_own(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (50, [1.0, 0.0, 2.0], 0), (3, [1.0, 0.0, 1.0], 0), (100, [2.0], 0)], SCHEMA)
    assert sorted((r["query_id"], r["vec_id"]) for r in A.search(d).collect()) == [(0, 1), (50, 3)]


def test_recall_against_probes(spark, sf):
    """Recall grows with the probes; what the sample chooses reaches the target."""
    rows = table(spark, sf, "embeddings").collect()
    want = exact([r["vec_id"] for r in rows], [r["embedding"] for r in rows])
    d, index = table(spark, sf, "embeddings"), A.fit(A.usable(table(spark, sf, "embeddings")))
    shares = [recall(A.search(d, index=index, probes=p).collect(), want)[0] for p in (1, index.probes, len(index.centroids))]
    assert shares[0] < shares[1] <= shares[2] + 0.02 and shares[1] >= 0.9 and shares[2] >= 0.97


def test_queries_in_small_cells_get_all_their_neighbours(spark):
    """A far cluster of three, probed alone: five are found all the same."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(397, 8)) + 4, rng.normal(size=(3, 8)) * 0.01 - 9]).astype(np.float32)
    d = spark.createDataFrame([(i + 1 if i < 399 else 450, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA)
    index = A.fit(A.usable(d), cells=20)
    got = [r for r in A.search(d, index=index, probes=1).collect() if r["query_id"] == 450]
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5] and {398, 399} <= {r["vec_id"] for r in got}
    assert A.enough(np.array([[2, 0, 3, 9], [9, 1, 1, 1]]), 1, 5).tolist() == [4, 1]


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_at_larger_scales(spark, scale):
    folder = f"/root/testdata/{scale}"
    if not os.path.isdir(folder):
        pytest.skip("no test data here")
    rows = table(spark, folder, "embeddings").collect()
    want = exact([r["vec_id"] for r in rows], [r["embedding"] for r in rows])
    share, found = recall(op9_nearest_neighbours(spark, folder).collect(), want)
    assert share >= 0.95 and set(found) == set(want)
