import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from climaspark.llm import lz_fingerprint as L
from climaspark.llm.queries import op1_lz_fingerprints, table


def parsed(text):
    out, piece = [], ""
    for c in text:
        piece += c
        if piece not in out:
            out.append(piece)
            piece = ""
    return out


@given(st.text(alphabet="ab é🎉", max_size=60))
@settings(max_examples=60, deadline=None)
def test_phrases(text):
    assert list(L.phrases(text)) == parsed(text)
    assert L.fingerprint_of(text) == L.fingerprint_of("".join(list(text))) and L.alike(L.fingerprint_of(text), L.fingerprint_of(text)) == 1


def edited(texts):
    for i, t in enumerate(texts):
        after, q = texts[(i + 1) % len(texts)], len(t) // 4
        yield t[: len(t) - q] + after[:q], after


def test_whole_table_by_brute_force(spark, sf):
    rows = sorted((r["doc_id"], r["text"] or "") for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in op1_lz_fingerprints(spark, sf).collect()}
    assert len(got) == len(rows)
    for (i, t), (e, after) in zip(rows, edited([t for _, t in rows])):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(e.encode()).hexdigest(), L.fingerprint_of(t), L.fingerprint_of(e))
        assert r["near_edited"] == L.alike(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == L.alike(r["fingerprint"], L.fingerprint_of(after))
        assert len(t) < 200 or r["near_edited"] > r["near_next"] or t in after or after in t


def test_spans_do_not_show(spark, documents):
    d = documents([(i * 7 % 31, "text number %d of a few " % (i % 5) * (i % 4)) for i in range(31)])
    one = sorted(map(tuple, L.edited_likeness(d, 1).collect()))
    assert one == sorted(map(tuple, L.edited_likeness(d, 9).collect())) and len(one) == 31
    assert one == sorted(map(tuple, L.edited_likeness(d, 400).collect()))


def test_odd_rows(spark, odd):
    got = L.edited_likeness(odd, 3).collect()
    assert len(got) == odd.count() and sum(r["n_chars"] == 0 for r in got) == 3
    assert L.edited_likeness(odd.where("false")).count() == 0
    lone = L.edited_likeness(odd.where("doc_id = 1")).first()
    assert lone["near_next"] == 1 and lone["near_edited"] == 1


def test_columns(spark, odd):
    got = odd.select(L.fingerprint("text").alias("f")).select(L.likeness("f", "f").alias("l")).collect()
    assert {r["l"] for r in got} == {1.0}
