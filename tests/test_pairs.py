import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from climaspark.functions import pairs as P
from climaspark.operators import trends as T


def all_pairs(x, y):
    i, j = np.triu_indices(len(x), 1)
    i, j = np.where(x[j] < x[i], j, i), np.where(x[j] < x[i], i, j)
    apart = x[i] != x[j]
    i, j = i[apart], j[apart]
    return np.sort((y[j] - y[i]) / (x[j] - x[i])), int(np.sign(y[j] - y[i]).sum())


@given(st.lists(st.integers(0, 12), max_size=40))
@settings(max_examples=300, deadline=None)
def test_inversions(ranks):
    r = np.array(ranks, np.int64)
    want = [(i, j) for i in range(len(r)) for j in range(i + 1, len(r)) if r[i] > r[j]]
    assert P.inversions(r) == len(want) and sorted(zip(*(k.tolist() for k in P.inverted(r)), strict=True)) == want


def kinds(n, seed):
    rng = np.random.default_rng(seed)
    x = np.arange(n) + 1900.0
    return {
        "smooth": (x, rng.normal(size=n) + 0.01 * x),
        "integers": (x, rng.integers(0, 5, n).astype(float)),
        "tenths": (x, np.round(rng.normal(size=n), 1)),
        "repeated years": (np.sort(rng.integers(0, n // 3 + 2, n)).astype(float), rng.normal(size=n)),
        "both repeated": (np.sort(rng.integers(0, n // 3 + 2, n)).astype(float), rng.integers(0, 3, n).astype(float)),
        "constant": (x, np.full(n, 3.25)),
        "a line": (x, 0.1 * x),
        "heavy tails": (x, rng.standard_cauchy(n) * 1e6),
        "gaps": (np.cumsum(rng.integers(1, 50, n)).astype(float), rng.normal(size=n)),
        "far away": (x + 1e7, rng.normal(size=n) + 1e5),
    }


@pytest.mark.parametrize("kind", kinds(5, 0))
@pytest.mark.parametrize("n", [2, 3, 60, 2000])
def test_selected_slopes_are_those_of_all_pairs(monkeypatch, kind, n):
    monkeypatch.setattr(P, "FEW", 20)  # so that small series are selected too, as far as 4 n goes
    x, y = kinds(n, 3)[kind]
    slopes, s = all_pairs(x, y)
    assert P.concordance(x, y) == s
    found = P.Slopes(x, y)
    assert found.n == len(slopes)
    if found.n:
        assert found.median() == pytest.approx(np.median(slopes), rel=1e-8, abs=1e-9 * np.abs(slopes).max())
        for k in sorted({0, found.n // 3, found.n - 1, int(0.975 * found.n), found.n // 2}):
            assert found[k] == pytest.approx(slopes[k], rel=1e-8, abs=1e-9 * np.abs(slopes).max())


def test_below_counts_slopes():
    x, y = kinds(300, 1)["smooth"]
    slopes, _ = all_pairs(x, y)
    for m in (-1e9, -0.01, 0.0, float(np.median(slopes)) + 1e-7, 1e9):
        assert P.Slopes(x, y).below(m) == (slopes < m).sum()


def test_order_of_rows_is_of_no_account():
    x, y = kinds(700, 2)["both repeated"]
    p = np.random.default_rng(0).permutation(len(x))
    assert P.concordance(x[p], y[p]) == P.concordance(x, y) and P.Slopes(x[p], y[p]).median() == P.Slopes(x, y).median()


@pytest.mark.parametrize("kind", ["smooth", "tenths"])
def test_a_long_series(kind):
    """Two hundred thousand years: two times 10^10 pairs, of which none but the middle ones are laid out."""
    n = 200_000
    rng = np.random.default_rng(9)
    y = 0.002 * np.arange(n) + rng.normal(size=n)
    got = T._sen(pd.DataFrame({"year": np.arange(n), "value": y if kind == "smooth" else np.round(y, 1)}))
    assert got[3] == pytest.approx(0.002, rel=1e-3) and got[4] < got[3] < got[5] and got[6] > 0.9 * n * (n - 1) / 2
