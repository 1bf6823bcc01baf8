import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from climaspark.llm import jaccard as J
from climaspark.llm.common import components, shingle_hashes, word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def expected(rows):
    """(class id, links) of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    n, parent = Counter(), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not either or both >= 0.8 * either:
                n[i] += 1
                n[j] += 1
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 10**9)
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], d)
    return sorted((d, least[root(i)], n[i]) for i, (d, _) in enumerate(rows))


def texts(seed=0, groups=12, size=6, words=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)] + (shared if g % 3 == 0 else [])
        for m in range(size):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t) if m % 2 else ", ".join(t).upper())
    rng.shuffle(out)
    return list(enumerate(out))


def got(df):
    return sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect())


def test_all_pairs_of_small_groups(spark, documents):
    rows = texts()
    assert got(J.classes(documents(rows))) == expected(rows)


def test_blocks_do_not_show(spark, documents, monkeypatch):
    rows = texts(1, groups=2, size=60, words=90)
    want = expected(rows)
    monkeypatch.setattr(J, "BLOCK", 16)
    assert got(J.classes(documents(rows))) == want


def test_short_empty_and_repeated(spark, documents):
    rows = [(1, ""), (2, None), (3, "one two"), (4, "One, two!"), (5, "one three"), (6, "a b c d e"), (7, "a b c d e"), (8, "..."), (9, "a b c d e f")]
    assert got(J.classes(documents(rows))) == expected(rows)


def test_odd_rows(spark, odd):
    out = J.classes(odd)
    assert out.count() == odd.count() and J.classes(odd.where("false")).count() == 0


def test_one_of_each(spark, odd, documents):
    rows = texts(2, groups=5, size=5)
    d = documents(rows)
    kept = J.one_of_each(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in expected(rows)})
    again = J.one_of_each(odd).collect()
    assert len(again) == len({tuple(WORD.findall((r["text"] or "").translate(LOWER))) for r in odd.collect()})


def test_depth_reaches_its_recall():
    d = J.depth()
    assert 1 - (1 - J.LIKE**d) ** J.TREES >= J.RECALL > 1 - (1 - J.LIKE ** (d + 1)) ** J.TREES
    assert J.depth(recall=0.5) > d


def test_recall_of_pairs_at_the_threshold(spark, documents):
    """Pairs whose likeness lies between 0.8 and 0.85, each alone: linked as the target recall says, the leaders' estimates included."""
    rng, rows, pairs = random.Random(9), [], 0
    for g in range(400):
        base = [f"w{g}x{i}" for i in range(200)]
        for seed in range(50):
            t, r = list(base), random.Random(g * 100 + seed)
            for _ in range(r.choice([3, 4])):
                t[r.randrange(200)] = f"n{g}y{r.randrange(10**6)}"
            a, b = shingles(" ".join(base)), shingles(" ".join(t))
            if 0.8 <= len(a & b) / len(a | b) <= 0.85:
                break
        else:
            continue
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(t))]
        pairs += 1
    rng.shuffle(rows)
    found = sum(r["n_links"] for r in J.classes(documents(rows)).collect()) / 2
    assert pairs > 300 and found >= 0.995 * pairs


def test_words_are_those_of_the_pattern():
    sample = ["Ab-c d9 é🎉x\tY", "", "--", "a" * 1000 + " b"]
    h, at = word_hashes(sample)
    assert np.diff(at).tolist() == [len(WORD.findall(t.translate(LOWER))) for t in sample]
    assert word_hashes(["AB-C"])[0].tolist() == h[:2].tolist()[:1] + word_hashes(["c"])[0].tolist()
    s, first = shingle_hashes(h, at, 5)
    assert np.diff(first).tolist() == [1, 0, 0, 1]


@pytest.mark.parametrize("seed", [0, 1])
def test_intersections(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) > p], rng.integers(0, 2**63, 9).astype(np.uint64)])) for p in rng.choice([0.02, 0.1, 0.5], 150)]
    sets += [np.unique(base[:40])] * 2 + [np.array([], np.uint64)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert (J.intersections(sets) == np.array(want)).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_any_column_names(spark, documents):
    rows = texts(3, groups=3, size=4)
    d = documents(rows)
    for name in ("_id", "_class", "_key", "key", "class_id", "doc", "a.b"):
        d = d.withColumn(name, d["doc_id"])
    kept = J.one_of_each(d)
    assert kept.columns == d.columns and all(r["_key"] == r["a.b"] == r["doc_id"] for r in kept.collect()) and kept.count() == len({c for _, c, _ in expected(rows)})


def test_components_around_a_hot_node(spark):
    edges = [(7, i) for i in range(100, 400)] + [(i, i + 1000) for i in range(100, 200)] + [(3, 399), (5000, 5001)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found.values()) == {3, 5000} and sum(v == 3 for v in found.values()) == len(found) - 2
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long"), rounds=1)
