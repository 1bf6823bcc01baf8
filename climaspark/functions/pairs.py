"""What all pairs of a series tell, without the pairs: concordance by counting inversions, slopes by selection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

#: Pairs that are laid out at once, at least, and slopes drawn as trials.
FEW, DRAWN = 100_000, 100_000


def _by_bits(ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, one, before, base) for each bit of the ranks from the highest on, items dealt into groups of equal higher bits.

    place is an item's place in the input, in order within a group; one its bit, before the ones ahead of it in its group and
    base those of all groups ahead. An inversion shows once: at its highest differing bit, a one ahead of a zero.
    """
    n = len(ranks)
    value, place = np.array(ranks, np.int64), np.arange(n)
    for bit in reversed(range(int(value.max()).bit_length() if n else 0)):
        one = value >> bit & 1 == 1
        head = np.flatnonzero(np.diff(value >> bit + 1, prepend=-1))
        size = np.diff(head, append=n)
        ones = np.cumsum(one)
        base = np.repeat(ones[head] - one[head], size)
        before = ones - one - base
        yield place, one, before, base
        start = np.repeat(head, size)
        zeros = np.repeat(size - np.add.reduceat(one, head), size)
        to = start + np.where(one, zeros + before, np.arange(n) - start - before)
        value[to], place[to] = value.copy(), place.copy()


def inversions(ranks: np.ndarray) -> int:
    """How many pairs stand in descending order, equal ones not counted: O(n log n)."""
    return int(sum(before[~one].sum() for _, one, before, _ in _by_bits(ranks)))


def inverted(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of each pair that stands in descending order."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for place, one, before, base in _by_bits(ranks):
        zero = np.flatnonzero(~one & (before > 0))
        counts = before[zero]
        ends = np.cumsum(counts)
        if len(zero):
            left.append(place[np.flatnonzero(one)[np.arange(ends[-1]) - np.repeat(ends - counts - base[zero], counts)]])
            right.append(np.repeat(place[zero], counts))
    return np.concatenate(left), np.concatenate(right)


def ranked(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def concordance(x: np.ndarray, y: np.ndarray) -> int:
    """Mann-Kendall's S: pairs of different x that rise less those that fall."""
    rank = ranked(y)
    return inversions(rank.max(initial=0) - rank[np.lexsort((-rank, x))]) - inversions(rank[np.lexsort((rank, x))])


class Slopes:
    """The slopes of all pairs of different x, in order, though never laid out.

    A pair's slope is below m just where y - m x descends from the one to the other, so that inversions count the slopes below
    any m. A wanted place is enclosed by trial slopes, drawn from random pairs first; what is left between the two is laid out.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 0):
        order = np.lexsort((y, x))
        self.x, self.y = np.asarray(x, float)[order], np.asarray(y, float)[order]
        n, same = len(x), np.unique(x, return_counts=True)[1]
        self.n = int(n * (n - 1) // 2 - (same * (same - 1) // 2).sum())
        self.most = max(FEW, 4 * n)
        # Rounding is least about the middle.
        self.u, self.v = self.x - (self.x[0] + self.x[-1]) / 2 if n else self.x, self.y - np.median(self.y) if n else self.y
        if self.n:
            rng = np.random.default_rng(seed)
            i, j = rng.integers(0, n, (2, DRAWN if self.n > self.most else 0))
            i, j = np.minimum(i, j), np.maximum(i, j)
            apart = self.x[j] > self.x[i]
            self.drawn = np.sort(self.slopes(i[apart], j[apart]))
            self.step = np.diff(np.unique(self.x)).min()
            self.wide = np.abs(self.u).max(), np.abs(self.v).max()

    def slopes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.y[j] - self.y[i]) / (self.x[j] - self.x[i])

    def at(self, m: float) -> np.ndarray:
        """Each place's rank of y - m x, for an infinite m that of x."""
        if np.isinf(m):
            return np.arange(len(self.x)) if m < 0 else ranked(-self.x)
        return ranked(self.v - m * self.u)

    def below(self, m: float) -> int:
        return inversions(self.at(m))

    def blur(self, m: float) -> float:
        """What rounding may add to or take from a slope as below() sees it."""
        return max(8 * np.finfo(float).eps * (self.wide[1] + abs(m) * self.wide[0]) / self.step, 1e-300)

    def between(self, low: float, high: float) -> np.ndarray:
        """The slopes of pairs that are in order at low and out of order at high, ascending."""
        order = np.argsort(self.at(low), kind="stable")
        i, j = (order[k] for k in inverted(self.at(high)[order]))
        i, j = np.minimum(i, j), np.maximum(i, j)
        apart = self.x[j] > self.x[i]
        return np.sort(self.slopes(i[apart], j[apart]))

    def __getitem__(self, k: int) -> float:
        """The slope at place k, from 0, in ascending order; of equal slopes but for rounding any."""
        if self.n <= self.most:
            return float(self.all[k])
        high = 2 * np.ptp(self.y) / self.step + 1e-300  # no slope is as steep
        low, less, most, side = -high, 0, self.n, 0
        while most - less > self.most:
            some = self.drawn[np.searchsorted(self.drawn, low, "right") : np.searchsorted(self.drawn, high, "left")]
            share = (k + 0.5 - less) / (most - less)
            off = (side % 3 - 1) * 2  # at the place, above it, below it, so that both sides close in
            if len(some):
                place = share * len(some) + off * (len(some) * share * (1 - share)) ** 0.5
                trial = float(some[int(min(max(place, 0), len(some) - 1))])
            else:
                trial = low + (high - low) * (min(max(share + off * 0.01, 0.001), 0.999) if side % 4 < 3 else 0.5)
            side += 1
            blur = self.blur(trial)
            under, upto = self.below(trial - blur), self.below(trial + blur)
            if under <= k < upto:
                return trial
            if k < under:
                high, most = trial - blur, under
            else:
                low, less = trial + blur, upto
            if not len(some) and high - low <= 2 * blur:
                return trial
        found = self.between(low, high)
        return float(found[min(max(k - less, 0), len(found) - 1)])

    @cached_property
    def all(self) -> np.ndarray:
        return self.between(-np.inf, np.inf)

    def median(self) -> float:
        return self[self.n // 2] if self.n % 2 else (self[self.n // 2 - 1] + self[self.n // 2]) / 2
