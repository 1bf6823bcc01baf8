import math
import random
import zlib

import numpy as np
import pytest

from climaspark.llm import toxicity as X
from climaspark.llm.queries import op7_toxicity, table


def auc(pos, neg):
    p, n = np.array(pos)[:, None], np.array(neg)[None]
    return float((p > n).mean() + 0.5 * (p == n).mean())


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def corpus(documents, n=1500, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "er", "ing", "st", "ou", "th", "re", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.12
        text = [rng.choice(words) for _ in range(60)]
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["idiot", "zorpish", "zorped"]) if i % 2 else rng.choice(["moron", "quexly"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus(documents)
    seen = [(i, 1, y if not held(i) else 1 - y) for i, y in labels]  # labels of the held-out fold are wrong on purpose
    got = {r["doc_id"]: r for r in X.score(documents(rows), spark.createDataFrame(seen, "doc_id long, quality int, toxic int")).collect()}
    truth = dict(labels)
    out = [i for i in truth if held(i)]
    assert all(got[i]["held_out"] == held(i) for i in truth)
    assert auc([got[i]["score"] for i in out if truth[i]], [got[i]["score"] for i in out if not truth[i]]) > 0.99
    assert sum(got[i]["predicted"] != truth[i] for i in out) <= 0.02 * len(out)


def test_table(spark, sf):
    got = op7_toxicity(spark, sf).collect()
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    assert len(got) == table(spark, sf, "documents").count() and all(0 <= r["score"] <= 1 for r in got)
    known = [r for r in got if r["doc_id"] in labels]
    assert sum(r["predicted"] for r in known if not labels[r["doc_id"]]) == 0


def test_clean_keeps_columns_and_clean_rows(spark, documents):
    rows, labels = corpus(documents, 900, 1)
    d = documents(rows)
    kept = X.clean(d, spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int"))
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == d.columns and {i for i, y in labels if not y} <= ids and sum(y for i, y in labels if i in ids) <= 2


def test_odd_rows_and_no_labels(spark, odd, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = X.score(odd, none).collect()
    assert len(got) == odd.count() and not any(r["held_out"] is None or r["score"] is None for r in got)
    assert X.score(odd.where("false"), none).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert X.score(odd, nulls).count() == odd.count()
    assert X.clean(odd, none).count() == odd.count()


def test_label_model_discounts_copies_of_a_voter(spark):
    rng = np.random.default_rng(0)
    n = 4000
    y = rng.random(n) < 0.3
    x = np.zeros((n, 7), np.float32)
    for j, right in enumerate((0.9, 0.9, 0.9)):
        x[:, j] = np.where(rng.random(n) < right, y, rng.random(n) < 0.1)
    x[:, 2] = x[:, 1]
    x[:, 3] = (x[:, :3] > 0).sum(1)
    rows = spark.createDataFrame([(X.packed(r), float(t) if i % 2 else None, 1.0) for i, (r, t) in enumerate(zip(x, y, strict=True))], "x binary, toxic double, n double")
    model = X.fit_labels(rows, X.LabelModel(np.full(9, 0.8), np.zeros((9, 9)), 0.3), 3)
    assert model.together[1, 2] > 0.95 and model.together[0, 1] < 0.7 and model.together[1].sum() > model.together[0].sum() + 0.2 and (model.right > 0.5).all()
    p = model.posterior(X.ballots(sparse(x), 3))
    assert auc(p[y], p[~y]) > 0.9


def test_linear():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(500, 2))
    target, one = (a[:, 0] > 0).astype(float), np.ones(500)
    sums = lambda w, x=a, t=target, n=one: whole(X.linear_sums(w, sparse(x), t, n), 3 + 9)
    w = X.fit_linear(sums, 2)
    assert w[0] > 1 and abs(w[1]) < w[0] / 3
    # At the optimum no weight's slope, penalty included, is left; rows that occur twice count twice.
    slope = sums(w)[:3] - np.array([0.05, 0.05, 1e-6]) * w
    assert np.abs(slope).max() < 0.1
    assert np.allclose(sums(w, a, target, 2 * one), sums(w, np.concatenate([a, a]), np.tile(target, 2), np.ones(1000)))


def sparse(x):
    return X.Sparse.of([X.packed(r) for r in x])


def whole(parts, size):
    out = np.zeros(size)
    np.add.at(out, parts[0], parts[1])
    return out


@pytest.mark.parametrize("pairs", [3, 2_000_000])
def test_sums_of_few_numbers_a_row_are_those_of_all(monkeypatch, pairs):
    """Products of a row's columns, gradient and curvature against whole matrices."""
    monkeypatch.setattr(X, "PAIRS", pairs)
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(70, 9)) * (rng.random((70, 9)) < 0.3)).astype(np.float32)
    x[4] = 0
    n, target, w = rng.integers(1, 5, 70).astype(float), rng.random(70), rng.normal(size=10)
    assert np.allclose(whole(sparse(x).squares(n, 9), 81).reshape(9, 9), (x * n[:, None]).T @ x)
    a = np.concatenate([x, np.ones((70, 1))], axis=1).astype(float)
    p = 1 / (1 + np.exp(-a @ w))
    want = np.concatenate([a.T @ (n * (target - p)), ((a * (n * p * (1 - p))[:, None]).T @ a).ravel()])
    assert np.allclose(whole(X.linear_sums(w, sparse(x), target, n), 110), want)
    assert np.allclose(sparse(x).dot(w[:9]), x @ w[:9]) and np.allclose(sparse(x).column(3), x[:, 3])
    assert X.Sparse.of([]).squares(np.empty(0), 3)[0].size == 0


def votes_of(x, m):
    """Votes by the definitions, a row and voter at a time."""
    out = []
    for r in x.tolist():
        entries, rate, shouts, marks = r[m:]
        out.append([int(v > 0) for v in r[:m]] + [int(entries >= 2), int(rate >= np.float32(math.log1p(1))), int(shouts > 0 and entries > 0), int(marks > 0 and entries > 0), -int(entries == 0), -int(entries == 0 and marks == 0 and shouts == 0)])
    return out


def expectation_maximisation(rows, right, prior, rounds):
    """Row by row and voter by voter."""
    v = len(right)
    first, together = list(right), [[0.0] * v for _ in range(v)]
    for _ in range(rounds):
        total = toxic = labelled = 0.0
        agree, cast = [0.0] * v, [0.0] * v
        joint = {True: [[0.0] * v for _ in range(v)], False: [[0.0] * v for _ in range(v)]}
        for votes, label, n in rows:
            z = math.log(prior / (1 - prior)) + sum(votes[j] * math.log(right[j] / (1 - right[j])) / (1 + sum(together[j])) for j in range(v))
            if label is not None:
                z += (1 if label else -1) * math.log(X.ANNOTATOR / (1 - X.ANNOTATOR))
            p = 1 / (1 + math.exp(-max(-30, min(30, z))))
            if label is not None:
                p = min(max(p, X.SOFT), 1 - X.SOFT)
            c = n * (1.0 if label is not None else X.UNLABELLED)
            total, toxic, labelled = total + c, toxic + c * p, labelled + n * (label is not None)
            wrong = [0.0 if votes[j] == 0 else 1 - p if votes[j] > 0 else p for j in range(v)]
            for j in range(v):
                if votes[j]:
                    agree[j] += c * (p if votes[j] > 0 else 1 - p)
                    cast[j] += c
                for k in range(v):
                    joint[False][j][k] += n * wrong[j] * wrong[k]
                    joint[True][j][k] += (label is not None) * n * wrong[j] * wrong[k]
        q = joint[labelled >= X.ENOUGH]
        right = [min(max((agree[j] + 2 * first[j]) / (cast[j] + 2), 0.3), 0.995) for j in range(v)]
        together = [[0.0 if j == k or min(q[j][j], q[k][k]) < 2 else min(1.0, q[j][k] / math.sqrt(max(q[j][j] * q[k][k], 1e-9))) for k in range(v)] for j in range(v)]
        prior = min(max((toxic + 1) / (total + 10), 0.005), 0.5)
    return right, together, prior


@pytest.mark.parametrize("share", [0.0, 0.6])
def test_label_model_by_brute_force(spark, share):
    rng = np.random.default_rng(3)
    x = np.zeros((300, 7), np.float32)
    x[:, :3] = np.log1p(rng.integers(0, 3, (300, 3)) * (rng.random((300, 3)) < 0.3))
    x[:, 3] = (x[:, :3] > 0).sum(1)
    x[:, 6] = rng.random(300) < 0.1
    label = [int(v > 0) if rng.random() < share else None for v in x[:, 0]]
    n = rng.integers(1, 4, 300).tolist()
    rows = spark.createDataFrame([(X.packed(r), None if y is None else float(y), float(k)) for r, y, k in zip(x, label, n, strict=True)], "x binary, toxic double, n double")
    model = X.fit_labels(rows, X.LabelModel(np.full(9, 0.75), np.zeros((9, 9)), 0.2), 3, rounds=3)
    right, together, prior = expectation_maximisation(list(zip(votes_of(x, 3), label, n, strict=True)), [0.75] * 9, 0.2, 3)
    assert np.allclose(model.right, right) and np.allclose(model.together, together) and abs(model.prior - prior) < 1e-9


def labelled(spark, labels):
    return spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int")


def test_mined_entries_by_brute_force(spark, documents):
    """Every candidate counted text by text, the tests of chance as they are defined."""
    rows, labels = corpus(documents, 700, 3)
    truth = dict(labels)
    texts = {i: X.words_of(t) for i, t in rows if not held(i)}
    P, N = (sum(truth[i] == y for i in texts) for y in (1, 0))
    counts = {}
    for i, words in texts.items():
        for e in X.candidates(set(words)):
            c = counts.setdefault(e, [0, 0, 0])
            c[1 - truth[i]] += 1
            if truth[i]:
                c[2] += sum(e in X.candidates([w]) for w in words)
    best = []
    for e, (p, n, uses) in counts.items():
        ratio, base = (p + 0.5) / (P + 1) / ((n + 0.5) / (N + 1)), P / (P + N)
        if p >= X.LEAST_DOCS and ratio >= X.LEAST_RATIO:
            chance = p * math.log(p / ((p + n) * base)) + (n * math.log(n / ((p + n) * (1 - base))) if n else 0)
            if chance >= (X.SURE if uses < 2 * p else X.LIKELY):
                best.append((-p * math.log(ratio), -len(e), e, p, n))
    want = X.chosen([(e, p, n) for _, _, e, p, n in sorted(best)])
    assert X.mined(documents(rows), labelled(spark, labels)) == want and len(want) >= 4


def test_scores_are_those_of_the_weights(spark, documents):
    """A text's score from its features, one number at a time."""
    rows, labels = corpus(documents, 400, 4)
    rows += [(9000, None), (9001, ""), (9002, "IDIOT!! MORON?? idiot")]
    fitted = X.fit(documents(rows), labelled(spark, labels))
    d = documents(rows)
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", fitted.scored(fitted.features("text")).alias("s")).collect()}
    for i, t in rows:
        z = fitted.weights[-1] + sum(float(a) * float(b) for a, b in zip(fitted.lexicon.features(t or ""), fitted.weights, strict=False))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
