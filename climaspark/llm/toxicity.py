"""Toxicity by weak supervision: many lexicon and pattern voters, a generative model of their votes, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, done, give_back, least_hashed, quoted, small_batches, written
from .tokens import ranges

#: At most so many labelled rows, those with the least hashes, tell lexicon entries (the default of fit()'s labelled_rows).
LABELLED_ROWS = 20_000
#: Pairs of a row's voters, or features, that are laid out at once.
PAIRS = 2_000_000
#: In how many toxic texts a lexicon entry must stand, and how much oftener than in others.
LEAST_DOCS, LEAST_RATIO = 3, 8.0
#: Rounds of expectation maximisation, and of Newton's method at most.
ROUNDS, STEPS = 8, 12
#: What an unlabelled row counts in the models' fits against a labelled one; labelled rows that correlations are told from.
UNLABELLED, ENOUGH = 0.2, 100
#: How far posteriors of labelled rows, and the classifier's targets, stay from 0 and 1; how often a label is right, as a vote of the label model.
SOFT = 0.01
ANNOTATOR = 0.999
#: Nats by which an entry's toxic documents must beat chance; less will do if they use it twice each and more.
SURE, LIKELY = 9.0, 5.0
# A seed lexicon of insults.
SEED = ("disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless", "clown")
WORD = re.compile(r"[^\W\d_]+")
HEAD = 4


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def candidates(words: Iterable[str]) -> set[str]:
    """What may become a lexicon entry: whole words (with = before them) and beginnings of words of 4 to 6 letters."""
    out = {f"={w}" for w in words if HEAD <= len(w) <= 20}
    for n in (4, 5, 6):
        out.update(w[:n] for w in words if len(w) > n)
    return out


def in_fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def mined(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> list[tuple[str, int, int]]:
    """Lexicon entries told by the labelled rows outside the held-out fold: (entry, toxic documents, other documents with it), best first."""
    told = labels.where(F.col("toxic").isNotNull() & F.coalesce(in_fold(), F.lit(False))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = least_hashed(told, labelled_rows, "doc_id")
    rows = small_batches(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        other, toxic, uses = Counter(), Counter(), Counter()

        def told_by() -> pd.DataFrame:
            keys = list(other.keys() | toxic.keys())
            return pd.DataFrame({"entry": pd.Series(keys, dtype=object), "toxic": [toxic[k] for k in keys], "other": [other[k] for k in keys], "uses": [uses[k] for k in keys]})

        for pdf in batches:
            for label, text in zip(pdf["toxic"], pdf["text"], strict=True):
                words = Counter(words_of(text or ""))
                (toxic if label > 0 else other).update({"", *candidates(words)})
                if label > 0:
                    for word, n in words.items():
                        for entry in candidates([word]):
                            uses[entry] += n
            if len(other) + len(toxic) > 200_000:
                yield told_by()
                other, toxic, uses = Counter(), Counter(), Counter()
        yield told_by()

    sums = rows.mapInPandas(bounded(count), "entry string, toxic long, other long, uses long").groupBy("entry").agg(F.sum("toxic").alias("p"), F.sum("other").alias("n"), F.sum("uses").alias("uses"))
    sums = written(sums.where(f"p >= {LEAST_DOCS} or entry = ''"), "entries")
    total = sums.where("entry = ''").first()
    if total is None or not total["p"]:
        done(sums)
        return []
    P, N = total["p"], total["n"]
    ratio = ((F.col("p") + 0.5) / (P + 1)) / ((F.col("n") + 0.5) / (N + 1))
    p, n, base = F.col("p"), F.col("n"), P / (P + N)
    chance = p * F.log(p / ((p + n) * base)) + F.when(n > 0, n * F.log(n / ((p + n) * (1 - base)))).otherwise(0.0) if N else F.lit(0.0)
    # The driver may have what passes: it stands in toxic texts of the bounded sample, far beyond chance.
    sure = chance >= F.when(F.col("uses") < 2 * p, SURE).otherwise(LIKELY)
    found = sums.where("entry != ''").where((ratio >= LEAST_RATIO) & sure).withColumn("gain", p * F.log(ratio))
    best = [(r["entry"], r["p"], r["n"]) for r in found.orderBy(F.desc("gain"), F.desc(F.length("entry")), "entry").collect()]
    done(sums)
    return chosen(best)


def chosen(best: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The entries, best first, without those that a better one implies with the same counts."""
    out: list[tuple[str, int, int]] = []
    for entry, p, n in best:
        if not any((e.startswith(entry) or entry.startswith(e) or entry == f"={e}" or e == f"={entry}" or (e[0] == "=" and e[1:].startswith(entry)) or (entry[0] == "=" and entry[1:].startswith(e))) and (p2 >= p and n2 <= n) for e, p2, n2 in out):
            out.append((entry, p, n))
    return out


@dataclass
class Sparse:
    """Rows of few numbers each: row, column and value of those that aren't zero, in order of the rows."""

    n: int
    row: np.ndarray
    col: np.ndarray
    val: np.ndarray

    @classmethod
    def of(cls, blobs: Sequence[bytes]) -> Sparse:
        """From packed() rows."""
        flat = np.frombuffer(b"".join(blobs), ITEM)
        return cls(len(blobs), np.repeat(np.arange(len(blobs)), [len(b) // ITEM.itemsize for b in blobs]), flat["i"].astype(np.int64), flat["v"].astype(float))

    def column(self, j: int) -> np.ndarray:
        there = self.col == j
        return np.bincount(self.row[there], self.val[there], self.n)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def plus(self, columns: dict[int, np.ndarray]) -> Sparse:
        """With columns, given whole, of which what isn't zero is kept."""
        rows = [np.flatnonzero(c) for c in columns.values()]
        row = np.concatenate([self.row, *rows])
        order = np.argsort(row, kind="stable")
        col = np.concatenate([self.col, *(np.full(len(r), j) for j, r in zip(columns, rows, strict=True))])
        val = np.concatenate([self.val, *(np.asarray(c, float)[r] for c, r in zip(columns.values(), rows, strict=True))])
        return Sparse(self.n, row[order], col[order], val[order])

    def where(self, there: np.ndarray) -> Sparse:
        return Sparse(self.n, self.row[there], self.col[there], self.val[there])

    def squares(self, weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The sum over rows of weight times the row's products of two columns each: (column * width + column, sum) of pairs that share a row."""
        size = np.bincount(self.row, minlength=self.n)
        first = (np.cumsum(size) - size)[self.row]
        parts, bounds = [], np.cumsum(size[self.row])
        for lo, hi in pairwise([0, *np.searchsorted(bounds, np.arange(PAIRS, bounds[-1] if len(bounds) else 0, PAIRS)).tolist(), len(self.row)]):
            left = np.arange(lo, hi)
            n = size[self.row[lo:hi]]
            right = ranges(first[lo:hi], n)
            left = np.repeat(left, n)
            parts.append(added(self.col[left] * width + self.col[right], self.val[left] * self.val[right] * weights[self.row[left]]))
        return added(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.empty(0, np.int64), np.empty(0))


#: A feature's number and value.
ITEM = np.dtype([("i", "<u4"), ("v", "<f4")])


def packed(x: np.ndarray) -> bytes:
    """The numbers of a row that aren't zero, with their columns."""
    there = np.flatnonzero(x)
    out = np.empty(len(there), ITEM)
    out["i"], out["v"] = there, x[there]
    return out.tobytes()


def added(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values added by their places, each of which then occurs once."""
    distinct, where = np.unique(at, return_inverse=True)
    return distinct, np.bincount(where, values, len(distinct))


class Lexicon:
    """Counts of entries in a text, a dictionary look-up for each word."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.heads: dict[str, list[tuple[int, str, bool]]] = defaultdict(list)
        for i, e in enumerate(entries):
            self.heads[e.removeprefix("=")[:HEAD]].append((i, e.removeprefix("="), e[0] == "="))

    def features(self, text: str) -> np.ndarray:
        """log(1 + count) of each entry; then: entries present, their words a hundred, shouting, repeated marks."""
        words = words_of(text)
        out = np.zeros(len(self.entries) + 4, np.float32)
        hits = 0
        heads = self.heads
        for w in words:
            if w[:HEAD] in heads:
                found = False
                for i, e, whole in heads[w[:HEAD]]:
                    if w == e or not whole and w.startswith(e):
                        out[i] += 1
                        found = True
                hits += found
        m = len(self.entries)
        out[m] = (out[:m] > 0).sum()
        out[m + 1] = 100 * hits / max(len(words), 1)
        out[m + 2] = float(text.isupper())
        out[m + 3] = text.count("!!") + text.count("??")
        out[:m] = np.log1p(out[:m])
        out[m + 1 :] = np.log1p(out[m + 1 :])
        return out


def ballots(x: Sparse, m: int) -> Sparse:
    """Votes of each row: 1 toxic, -1 clean, 0 none. Each entry votes toxic when present; pattern voters: several entries, a high
    rate, shouting with an entry, repeated marks with an entry, and clean votes for no entry at all and for no entry nor mark."""
    entries, rate, shouts, marks = (x.column(m + j) for j in range(4))
    none = entries == 0
    present = x.where(x.col < m)
    present.val = np.ones(len(present.row))
    patterns = [entries >= 2, rate >= np.float32(np.log1p(1.0)), (shouts > 0) & ~none, (marks > 0) & ~none]
    return present.plus({m + j: p for j, p in enumerate(patterns)} | {m + 4: -1 * none, m + 5: -1 * (none & (marks == 0) & (shouts == 0))})


@dataclass
class LabelModel:
    """P(vote is right, given that it is cast) of each voter, how often two voters err together (their errors' cosine), and the share of toxic rows.

    A voter's log-odds are divided by one and the sum of its correlations, so that voters that err together count about once.
    """

    right: np.ndarray
    together: np.ndarray
    prior: float

    def posterior(self, votes: Sparse, known: np.ndarray | None = None) -> np.ndarray:
        """P(toxic) of rows from their votes and, where known isn't nan, from the label: one more vote, of an annotator who is right with ANNOTATOR."""
        z = np.log(self.prior / (1 - self.prior)) + votes.dot(np.log(self.right / (1 - self.right)) / (1 + self.together.sum(1)))
        if known is not None:
            z = z + np.where(np.isnan(known), 0.0, np.where(known > 0, 1.0, -1.0)) * np.log(ANNOTATOR / (1 - ANNOTATOR))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_sums(model: LabelModel, votes: Sparse, known: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What one round of expectation maximisation sums over rows (votes, label or nan, times that the row occurs), as (place, sum).

    A row with a label counts more, as its posterior is surer. Joint errors are only of voters that vote on one row.
    """
    v, told = len(model.right), ~np.isnan(known)
    p = np.where(told, np.clip(model.posterior(votes, known), SOFT, 1 - SOFT), model.posterior(votes, known))
    counts = np.where(told, 1.0, UNLABELLED) * n
    agree = np.where(votes.val > 0, p[votes.row], 1 - p[votes.row])
    wrong = Sparse(votes.n, votes.row, votes.col, 1 - agree)
    parts = [(np.arange(3), np.array([counts.sum(), (counts * p).sum(), (n * told).sum()]))]
    for at, each in ((3, agree), (3 + v, np.ones(len(agree)))):
        parts.append((at + np.arange(v), np.bincount(votes.col, each * counts[votes.row], v)))
    for at, of in ((3 + 2 * v, told), (3 + 2 * v + v * v, np.ones(len(n)))):
        place, joint = wrong.squares(n * of, v)
        parts.append((at + place, joint))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def label_step(first: LabelModel, s: np.ndarray) -> LabelModel:
    """The model of a round's sums; accuracies are smoothed towards those of the first model."""
    v = len(first.right)
    n, toxic, labelled, agree, cast = s[0], s[1], s[2], s[3 : 3 + v], s[3 + v : 3 + 2 * v]
    # Correlations are told by labelled rows, if there are enough.
    joint = s[3 + 2 * v :].reshape(2, v, v)[0 if labelled >= ENOUGH else 1]
    errors = np.diag(joint)
    together = joint / np.sqrt(np.maximum(errors[:, None] * errors[None], 1e-9)) * (np.minimum(errors[:, None], errors[None]) >= 2)
    np.fill_diagonal(together, 0)
    return LabelModel(np.clip((agree + 2 * first.right) / (cast + 2), 0.3, 0.995), np.clip(together, 0, 1), float(np.clip((toxic + 1) / (n + 10), 0.005, 0.5)))


def summed(rows: DataFrame, part: Callable[[Sparse, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """The sum over tasks of what part(features, label or nan, times) of rows (x, toxic, n) gives as (place, sum): tasks send
    the places that they have, which meet in one aggregation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = np.empty(0, np.int64), np.empty(0)
        for pdf in batches:
            if len(pdf):
                more = part(Sparse.of(list(pdf["x"])), pdf["toxic"].to_numpy(float), pdf["n"].to_numpy(float))
                at, total = added(np.concatenate([at, more[0]]), np.concatenate([total, more[1]]))
        yield pd.DataFrame({"i": at, "s": total})

    got = rows.mapInPandas(bounded(run), "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(size)
    out[got["i"].to_numpy()] = got["s"].to_numpy()
    return out


def fit_labels(rows: DataFrame, first: LabelModel, m: int, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over all rows (x, toxic, n): each round is one aggregation, of which numbers by voters and pairs of voters come to the driver."""
    model, v = first, len(first.right)
    for _ in range(rounds):
        model = label_step(first, summed(rows, lambda x, known, n, model=model: label_sums(model, ballots(x, m), known, n), 3 + 2 * v + 2 * v * v))
    return model


def linear_sums(w: np.ndarray, x: Sparse, target: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic likelihood at weights w, the last of which is the constant, as (place, sum)."""
    d = len(w)
    a = x.plus({d - 1: np.ones(x.n)})
    p = 1 / (1 + np.exp(-np.clip(a.dot(w), -30, 30)))
    place, curvature = a.squares(counts * p * (1 - p), d)
    return np.concatenate([np.arange(d), d + place]), np.concatenate([np.bincount(a.col, a.val * (counts * (target - p))[a.row], d), curvature])


def fit_linear(sums: Callable[[np.ndarray], np.ndarray], d: int, ridge: float = 0.05, steps: int = STEPS) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps over what sums(weights) tells; ends when no weight moves by a hundredth."""
    w, penalty = np.zeros(d + 1), np.append(np.full(d, ridge), 1e-6)
    for _ in range(steps):
        s = sums(w)
        step = np.clip(np.linalg.solve(s[d + 1 :].reshape(d + 1, d + 1) + np.diag(penalty) + 1e-6 * np.eye(d + 1), s[: d + 1] - penalty * w), -4, 4)
        w = w + step
        if np.abs(step).max() < 1e-2:
            break
    return w


@dataclass
class Fitted:
    """The lexicon, the label model and the classifier."""

    lexicon: Lexicon
    labels: LabelModel
    weights: np.ndarray
    table: DataFrame  # doc_id, x: the features that it was fitted on, written

    def features(self, text: str) -> Column:
        lexicon = self.lexicon

        @F.pandas_udf("binary")
        def run(texts: pd.Series) -> pd.Series:
            out = pd.Series([packed(lexicon.features(t or "")) for t in texts], dtype=object)
            give_back()
            return out

        return run(text)

    def scored(self, x: str | Column) -> Column:
        weights = self.weights

        @F.pandas_udf("double")
        def run(s: pd.Series) -> pd.Series:
            if not len(s):
                return pd.Series(dtype="float64")
            z = Sparse.of(list(s)).dot(weights[:-1]) + weights[-1]
            return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return run(x)


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Fitted:
    """Mines lexicon entries from at most labelled_rows labelled rows, every one that passes being a voter, has all texts' votes modelled, and fits the classifier on all posteriors.

    Texts are read twice: for the labelled sample and for features. Rows of equal features and label are one row and a number from then on.
    """
    found = mined(docs, labels, labelled_rows)
    lexicon = [e for e, *_ in found] + [f"={w}" for w in SEED if f"={w}" not in {e for e, *_ in found}]
    fitted, m = Fitted(Lexicon(lexicon), None, np.zeros(len(lexicon) + 5), None), len(lexicon)
    told = labels.where(F.col("toxic").isNotNull() & F.coalesce(in_fold(), F.lit(False))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("toxic"))
    fitted.table = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fitted.features("text").alias("x")), "features")
    votes = written(fitted.table.join(told, "doc_id", "left").groupBy("x", "toxic").agg(F.count("*").cast("double").alias("n")), "votes")
    counts = {e: (p, n) for e, p, n in found}
    right = np.array([(counts[e][0] + 2) / (sum(counts[e]) + 4) if e in counts else 0.8 for e in lexicon] + [0.85, 0.85, 0.8, 0.8, 0.85, 0.85])
    v = len(right)
    labels_ = fitted.labels = fit_labels(votes, LabelModel(np.clip(right, 0.55, 0.99), np.zeros((v, v)), 0.1), m)
    d = m + 4

    def sums(w: np.ndarray) -> np.ndarray:
        return summed(votes, lambda x, known, n: linear_sums(w, x, np.clip(labels_.posterior(ballots(x, m), known), SOFT, 1 - SOFT), n * np.where(np.isnan(known), UNLABELLED, 1.0)), (d + 1) * (d + 2))

    fitted.weights = fit_linear(sums, d)
    done(votes)
    return fitted


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of (doc_id, text).

    Only labels outside the fold crc32(doc_id) mod 3 = 1 are looked at, and no score has labels, doc_id or other columns as
    input. Null texts are empty and get the score of a text without any entry. Rows of one doc_id are scored each by its
    text. Without any usable label the seed lexicon votes alone.
    """
    fitted = fit(docs, labels)
    out = fitted.table.select("doc_id", F.coalesce(~in_fold(), F.lit(False)).alias("held_out"), fitted.scored("x").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose texts aren't predicted toxic. The score depends on the text alone, so no row is joined to its score."""
    fitted = fit(docs, labels)
    return docs.where(F.coalesce(fitted.scored(fitted.features("text")), F.lit(0.0)) < 0.7).select(*quoted(docs))
