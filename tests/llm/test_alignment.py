import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")

from climaspark.llm import alignment as A  # noqa: E402
from climaspark.llm.queries import op13_token_alignment, table  # noqa: E402

HARD = ["a  b", " lead", "  two", "tab\tx \t y", "nl\n\n x \n", "nb  sp  x", "  em  x", "▁ bar▁x", "<|endoftext|> <s> </s>", "日本 語 🎉 é à ç x—y — z", "don't  we'll", "\x00 \x1c x", "x" * 300, "\u0085 x \u0085", "end ", "   ", "a" + " " * 70 + "b", "é é", "﻿ x", "ﬁ ²"]


def whole(text):
    """Ids of both sides by whole texts, or none."""
    tok = A.both(A.default_paths())
    if not text:
        return [], []
    a = tok.sides[0].tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = tok.sides[1].tokenizer.encode(text)
    same = all(b"".join(s.bytes[i] for i in x) == (" " + text).encode() for s, x in zip(tok.sides, (a, b), strict=True))
    return (a, b) if same else ([], [])


def brute(texts):
    tok = A.both(A.default_paths())
    rows, total = [], Counter()
    for text in texts:
        a, b = whole(text)
        ends = []
        for side, ids in zip(tok.sides, (a, b), strict=True):
            at, out = 0, []
            for i in ids:
                at += len(side.bytes[i])
                out.append(at)
            ends.append(out)
        links, groups = [(x, y) for x, e in zip(a, ends[0], strict=True) for y, f in zip(b, ends[1], strict=True) if e == f], []
        last = 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            groups.append(",".join(str(x) for x, f in zip(a, ends[0], strict=True) if last < f <= e) + "|" + ",".join(str(y) for y, f in zip(b, ends[1], strict=True) if last < f <= e))
            last = e
        total.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = Counter()
    for (_, y), n in total.items():
        top[y] = max(top[y], n)
    return [(n, m, g, len(ls), sum(total[p] == top[p[1]] for p in ls), sum(total[p] for p in ls), d) for n, m, g, ls, d in rows]


def result(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


@given(st.text(alphabet=st.sampled_from(list("abcDE'., <|>s/\n\t\0\x1c\x85\xa0 ▁éß日🎉12-&﻿")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_chunks_are_the_whole_text(text):
    tok, texts = A.both(A.default_paths()), [text, "", f"{text} {text}. x"]
    raw = [(" " + t).encode() if t else b"" for t in texts]
    ids, firsts, good = tok.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    for i, t in enumerate(texts):
        got = [x[f[i] : f[i + 1]].tolist() if good[i] else [] for x, f in zip(ids, firsts, strict=True)]
        assert got == [list(x) for x in whole(t)]


def test_hard_texts_by_brute_force(documents):
    texts = [None, "", *HARD, *HARD[:4]]
    got = result(A.digests(documents(list(enumerate(texts)))))
    assert got == [(True, i, *r) for i, r in enumerate(brute([t or "" for t in texts]))]
    assert got[0][2:] == (0, 0, 0, 0, 0, 0, "") and sum(r[2] == 0 for r in got) < 8


def test_whole_table(spark, sf):
    rows = sorted(table(spark, sf, "documents").select("doc_id", "text").collect(), key=lambda r: r["doc_id"])[:25]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(A.digests(some)) == [(True, r["doc_id"], *b) for r, b in zip(rows, brute([r["text"] or "" for r in rows]), strict=True)]
    assert op13_token_alignment(spark, sf).count() == table(spark, sf, "documents").count()


def test_small_spans_and_caches(documents, monkeypatch):
    d = [(i, f"{t} and {i} more") for i, t in enumerate(HARD)]
    want = result(A.digests(documents(d)))
    monkeypatch.setattr(A, "SPAN", 40)
    monkeypatch.setattr(A, "CACHE", 3)
    tok = A.Both(A.default_paths())
    got = [A._batch(tok, A.pa.array([i]), A.pa.array([t]), "ends").to_pylist()[0] for i, t in d]
    assert [(g["n_a"], g["n_b"], g["n_groups"], g["groups_sha256"]) for g in got] == [(*w[2:5], w[8]) for w in want]
    tok.clear()
    tok.spacewise = False
    assert [A._batch(tok, A.pa.array([i]), A.pa.array([t]), "ends").to_pylist()[0] for i, t in d] == got


def test_odd_rows(odd):
    got = A.digests(odd)
    assert got.count() == odd.count() and A.digests(odd.where("false")).count() == 0
    assert A.digests(odd.where("text is null or text = ''")).groupBy().sum("n_a", "n_links", "count_sum").first()[:] == (0, 0, 0)


@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.lists(st.integers(1, 5), min_size=1, max_size=12))
def test_kinds_of_links(a, b):
    """Overlaps, shared ends and groups of two covers of the same bytes, by looking at every byte."""
    b[-1] += max(0, sum(a) - sum(b))
    a[-1] += max(0, sum(b) - sum(a))
    ea, eb = np.cumsum(a), np.cumsum(b)
    owner = list(zip(np.repeat(np.arange(len(a)), a).tolist(), np.repeat(np.arange(len(b)), b).tolist(), strict=True))
    shared = sorted(set(ea.tolist()) & set(eb.tolist()))
    found = A.intervals(ea, eb)
    pairs = {k: list(zip(*(x.tolist() for x in A.linked(*found, k)), strict=True)) for k in A.KINDS}
    assert pairs["overlaps"] == sorted(set(owner))
    assert pairs["ends"] == [(int(np.flatnonzero(ea == e)[0]), int(np.flatnonzero(eb == e)[0])) for e in shared]
    group = lambda e: int(np.searchsorted(shared, e))
    assert sorted(pairs["groups"]) == [(i, j) for i in range(len(a)) for j in range(len(b)) if group(ea[i]) == group(eb[j])]


def test_translation_of_ids(documents):
    found = A.aligned(documents([(1, "the cat the dog"), (2, "the cat")]))
    rows = A.translation(found).collect()
    assert sum(r["n"] for r in rows) == sum(r["n_links"] for r in found.collect()) and all(r["share"] == 1 and r["rank"] == 1 for r in rows)
    with pytest.raises(ValueError):
        A.aligned(documents([(1, "x")]), kind="else")
