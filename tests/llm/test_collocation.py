import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from climaspark.llm import collocation as C
from climaspark.llm.oracles import ORACLES
from climaspark.llm.queries import op11_collocations

SCHEMA = "doc_id long, lang string, text string, phrase string"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least, longest=5, top=2000, share=100):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        rows = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(100 * b >= share * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def texts(n, seed=0, words=9):
    rng = np.random.default_rng(seed)
    vocabulary = np.array(["The", "cat", "sat", "on", "É", "日本", "x\x00y", "a b c", "mat,", "End.\n", "  \t", "of"][:words] + ["of the", "in a nut shell"])
    return [(i, ["en", None, "de", "und"][i % 4], " ".join(rng.choice(vocabulary, 30)), "x") for i in range(n)]


@pytest.mark.parametrize(("least", "longest", "top", "share", "size"), [(3, 5, 2000, 100, 1 << 20), (2, 3, 7, 60, 64), (5, 2, 2000, 100, 1 << 20), (1, 4, 50, 100, 1 << 16)])
def test_brute_force(spark, least, longest, top, share, size):
    rows = texts(120)
    got = result(C.collocations(spark.createDataFrame(rows, SCHEMA), least, longest, top, share, size))
    assert got == brute([(r[1], r[2]) for r in rows], least, longest, top, share) and got


def test_small_spans(spark, monkeypatch):
    monkeypatch.setattr(C, "SPAN", 100)
    rows = texts(60, 1)
    want = result(C.collocations(spark.createDataFrame(rows, SCHEMA), 2))
    assert want == brute([(r[1], r[2]) for r in rows], 2)


@given(st.lists(st.text(alphabet=st.sampled_from(list("abA ,.\n\t\x00\x0bé")), max_size=40), max_size=6), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_counts_of_a_span(found, longest):
    words = C.Words("en", found)
    got = {}
    for k, phrases, counts in C.counted(words, range(1, longest + 1)):
        got.update({(k, p): n for p, n in zip(phrases.to_pylist(), counts.tolist(), strict=True)})
    want = Counter()
    for text in found:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((k, " ".join(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    assert got == dict(want)


def test_sieves_let_through_what_is_in_them(spark):
    words = C.Words("en", ["one two three four five six"])
    d = spark.createDataFrame([("en", "two three"), ("en", "four five"), ("de", "one two")], "lang string, phrase string")
    bits = C.sieve(d, 1 << 16)
    assert {x for _, p, _ in C.counted(words, [2], bits, 2, 1 << 16) for x in p.to_pylist()} == {"four five", "two three"}
    assert C.sieve(d.where("false"), 64).tolist() == [0]


def test_scores_beyond_64_bits(spark):
    """Counts whose products pass 64 bits, by the same expression."""
    rows = [(10**12 + 7, 10**15 + 3, 10**13 + 1, 10**12 + 9), (99, 10**17, 99, 99), (2, 3, 7, 11)]
    d = spark.createDataFrame(rows, "a long, n long, l long, r long").selectExpr("(cast(a as decimal(18,0)) * cast(n as decimal(18,0)) * 1000BD) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as s")
    assert [r["s"] for r in d.collect()] == [1000 * a * n // (left * right) for a, n, left, right in rows]


def test_odd_rows(spark, odd):
    assert C.collocations(odd.where("false")).count() == 0 and C.collocations(odd.where("text is null")).count() == 0
    got = result(C.collocations(odd, 100))
    rows = [("en", r["text"]) for r in odd.select("text").collect()]
    assert [r[:4] for r in got] == [r[:4] for r in brute(rows, 100)] and got
    for bad in ({"least": 0}, {"longest": 1}, {"share": 0}):
        with pytest.raises(ValueError):
            C.collocations(odd, **bad)


def test_whole_table(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    found = con.sql(ORACLES["op11_collocations"])
    want = sorted(tuple(dict(zip(found.columns, r, strict=True))[c] for c in COLUMNS) for r in found.fetchall())
    assert result(op11_collocations(spark, sf)) == want
