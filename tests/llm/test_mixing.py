import math

import pytest

from climaspark.llm import mixing as M
from climaspark.llm.queries import op6_poisson_mixing


def sized(documents, counts, text="some words here"):
    rows = [(i, text, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    return documents([(i, t) for i, t, _ in rows]).drop("source").join(documents([]).sparkSession.createDataFrame([(i, s) for i, _, s in rows], "doc_id long, source string"), "doc_id")


def test_hot_source_meets_its_weight(spark, documents):
    d = sized(documents, {"hot": 3000, "b": 800, "c": 200})
    weights = spark.createDataFrame([("hot", 1.0), ("b", 1.0), ("c", 2.0), ("absent", 5.0)], "source string, weight double")
    weights = weights.where("source != 'absent'")
    got = {r["source"]: r["count"] for r in M.mix(d, weights).groupBy("source").count().collect()}
    for s, share in (("hot", 0.25), ("b", 0.25), ("c", 0.5)):
        assert abs(got[s] - 4000 * share) < 5 * math.sqrt(4000 * share)


def test_counts_are_poisson(spark, documents):
    d = sized(documents, {"a": 4000, "b": 4000})
    n = {r["doc_id"]: r["count"] for r in M.mix(d, epochs=2.0).groupBy("doc_id").count().collect()}
    tally = [sum(n.get(i, 0) == k for i in range(8000)) for k in range(7)]
    for k, seen in enumerate(tally):
        want = 8000 * math.exp(-2) * 2**k / math.factorial(k)
        assert abs(seen - want) < 5 * math.sqrt(want)


def test_large_rates(spark, documents):
    d = sized(documents, {"a": 2000, "b": 5})
    got = {r["source"]: r["count"] for r in M.mix(d).groupBy("source").count().collect()}
    assert abs(got["b"] - 1002.5) < 5 * math.sqrt(1002.5)


def test_many_sources_go_the_other_way_with_the_same_rows(spark, documents, monkeypatch):
    d = sized(documents, {"a": 200, "b": 50, None: 20})
    want = sorted((r["doc_id"], r["copy"]) for r in M.mix(d).collect())
    monkeypatch.setattr(M, "MOST_SOURCES", 1)
    assert sorted((r["doc_id"], r["copy"]) for r in M.mix(d).collect()) == want and len(want) > 100


def test_repeatable_and_shuffled(spark, sf):
    a, b = op6_poisson_mixing(spark, sf).collect(), op6_poisson_mixing(spark, sf).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))
    ids = [r["doc_id"] for r in a]
    assert ids != sorted(ids)


def test_no_python_in_the_plan(spark, sf):
    plan = op6_poisson_mixing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_odd_rows(spark, odd):
    got = M.mix(odd)
    assert got.columns[: len(odd.columns)] == odd.columns and M.mix(odd.where("false")).count() == 0
    assert M.mix(got).columns == got.columns
    zero = spark.createDataFrame([("s", 0.0)], "source string, weight double")
    assert M.mix(odd, zero).count() == 0
    assert odd.select(M.uniform(odd["doc_id"]).alias("u")).agg({"u": "max"}).first()[0] < 1


def test_rates(spark, documents):
    d = sized(documents, {"a": 30, "b": 10})
    assert {r["source"]: r["rate"] for r in M.rates(d).collect()} == pytest.approx({"a": 2 / 3, "b": 2.0})


def test_any_column_names(spark, documents):
    d = documents([(1, "a"), (2, "b b")])
    for name in ("_source", "inverse", "rate", "doc", "n", "a.b"):
        d = d.withColumn(name, d["doc_id"])
    got = M.mix(d, epochs=3.0)
    assert got.columns == [*d.columns, "copy", "shuffle_key"] and all(r["a.b"] == r["inverse"] == r["doc_id"] for r in got.collect())
