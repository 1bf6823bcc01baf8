import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as C  # noqa: E402
from climaspark.llm import jaccard, mixing, packing, secret_scan, toxicity  # noqa: E402
from climaspark.llm.common import written  # noqa: E402
from climaspark.llm.queries import table  # noqa: E402


def test_stages_one_by_one(spark, sf):
    docs = table(spark, sf, "documents")
    start, columns = docs.count(), docs.columns
    seen = []
    for name, stage in C.STAGES[:-1]:
        out = written(stage(spark, docs, sf), "stage")
        assert out.columns == columns
        seen.append((name, docs, out))
        docs = out
    _, before, clean = seen[0]
    bad = {r["doc_id"] for r in toxicity.score(before, table(spark, sf, "labels")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in before.collect()} - bad and clean.count() < start
    _, before, unique = seen[1]
    assert unique.count() == jaccard.classes(before).select("class_key").distinct().count()
    assert jaccard.classes(unique).where("n_links > 0").count() == 0
    _, before, safe = seen[2]
    assert safe.count() == before.count() and secret_scan.scan(safe).where("n_assign + n_access + n_hex > 0").count() == 0
    same = before.join(safe, ["doc_id", "text"]).count()
    assert same == secret_scan.scan(before).where("spans = ''").count()
    _, before, mixed = seen[3]
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in mixing.mix(before).collect())
    pieces = C.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert pieces.agg({"length": "sum"}).first()[0] == packing.pack(mixed).agg({"length": "sum"}).first()[0]


def test_run(spark, sf):
    got = C.run(spark, sf)
    assert got.columns == packing.pack(table(spark, sf, "documents")).columns and got.count() > 0


def labels_at(spark, path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows_through_all_stages(spark, odd, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names: what each stage is said to do with them."""
    sf = labels_at(spark, tmp_path)
    docs = odd
    for name in ("_id", "_class", "_key", "_source", "inverse", "a.b"):
        docs = docs.withColumn(name, docs["doc_id"])
    columns, n = docs.columns, []
    for _, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        n.append(docs.count())
    # All clean; rows of the same words become one, of the least doc_id; none lost to secrets.
    assert n[0] == 9 and n[1] == n[2] == 5
    assert C.STAGES[-1][1](spark, docs, sf).count() >= n[3]


def test_an_empty_table(spark, odd, tmp_path):
    sf = labels_at(spark, tmp_path)
    odd.where("false").write.parquet(f"{sf}/documents.parquet")
    assert C.run(spark, sf).count() == 0
