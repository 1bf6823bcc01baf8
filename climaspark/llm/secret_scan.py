"""Secret scans: fixed patterns, and character Markov models of random strings, by alphabet, and of ordinary identifiers."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, give_back, quoted, small_batches

# The kinds of the base patterns, in their order, with the least length of what must be matched.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: What the models look at: long unbroken tokens.
TOKEN_LEAST = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % TOKEN_LEAST)
PIECE = re.compile("[A-Za-z0-9]{%d,}" % TOKEN_LEAST)
#: A piece of a token, or a whole one, is a secret from this mean log-likelihood ratio a character (nats) on, random against ordinary.
THRESHOLD = 0.5
_STATES = 128
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points; leftmost non-overlapping matches of each kind, then those long enough."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def transitions(token: str) -> np.ndarray:
    """Codes of the token's neighbouring characters; a start state stands before the first."""
    c = np.frombuffer(("\0" + token).encode("ascii", "replace"), np.uint8).astype(np.int64)
    return c[:-1] * _STATES + c[1:]


#: What secrets are drawn from, narrow before wide: a labelled sample belongs to the first that holds all its characters.
ALPHABETS = {"hex": r"[0-9a-f]", "upper": r"[A-Z0-9]", "alnum": r"[A-Za-z0-9]", "base64": r"[A-Za-z0-9+/_=.-]"}
_ORDINARY = len(ALPHABETS)
_WHOLE = [re.compile(f"{a}+") for a in ALPHABETS.values()]


def alphabet_of(sample: str) -> int:
    return next((i for i, a in enumerate(_WHOLE) if a.fullmatch(sample)), _ORDINARY - 1)


_COUNTS = "side int, code int, n long"


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: list[Counter] = [Counter() for _ in range(_ORDINARY + 1)]
    for pdf in batches:
        for text in pdf["text"]:
            tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text or "")]
            # Of an assignment, only the value is a sample.
            spans = [(ASSIGN.match(text, s).start(2) if k == "assign" else s, e, s) for s, e, k in base_spans(text)] if tokens else []
            for start, end in tokens:
                if not any(s < end and start < e for _, e, s in spans):
                    counts[_ORDINARY].update(transitions(text[start:end]).tolist())
                # Of a token that holds a secret, the secret's own characters are the sample.
                for piece in (text[max(v, start) : min(e, end)] for v, e, _ in spans if v < end and start < e):
                    counts[alphabet_of(piece)].update(transitions(piece).tolist())
    yield pd.DataFrame([(side, code, n) for side, c in enumerate(counts) for code, n in c.items()], columns=["side", "code", "n"])


def _logs(t: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log-probabilities of pairs: rows are smoothed towards the single characters, and these towards prior."""
    single = (t.sum(axis=0) + 50 * prior) / (t.sum() + 50)
    return np.log((t + 20 * single) / (t.sum(axis=1, keepdims=True) + 20))


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratios of each pair of characters, random against ordinary, a table for each model of random strings.

    Tokens of 16 characters and more are the samples: those where a base pattern holds are random, by alphabet, the others
    ordinary identifiers. An alphabet has two models: that of its labelled samples, and that of even chances, which random strings
    follow, for alphabets with few labelled samples or with words among them. Spark sums the pairs' counts; a table of at most
    5 x 128 x 128 numbers comes to the driver. Both sides of a ratio are smoothed towards even chances within the alphabet: without
    any samples all ratios within it are 0.
    """
    table = np.zeros((_ORDINARY + 1, _STATES, _STATES))
    for r in small_batches(docs).select("text").mapInPandas(bounded(_count), _COUNTS).groupBy("side", "code").agg(F.sum("n").alias("n")).collect():
        table[r["side"], r["code"] // _STATES, r["code"] % _STATES] = r["n"]
    ratios = []
    for counts, pattern in zip(table[:_ORDINARY], ALPHABETS.values(), strict=True):
        allowed = np.array([bool(re.match(pattern, chr(i))) for i in range(_STATES)])
        prior = np.where(allowed, 1.0 / allowed.sum(), 1e-6)
        prior /= prior.sum()
        ordinary = _logs(table[_ORDINARY], prior)
        # What the alphabet lacks never speaks for it, however rare it is among ordinary tokens.
        ratios += [np.where(allowed, _logs(t, prior) - ordinary, np.minimum(_logs(t, prior) - ordinary, np.log(1e-6))) for t in (counts, np.zeros_like(counts))]
    return np.stack(ratios)


def score(token: str, model: np.ndarray) -> float:
    """The best mean ratio that any of the models gives to the token."""
    return float(model.reshape(len(model), -1)[:, transitions(token)].mean(axis=1).max()) if token else 0.0


def random_spans(text: str, start: int, end: int, model: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """What is random in a stretch of a token: its pieces of letters and digits alone, so that ordinary text joined to a secret doesn't
    hide it; where none is, the whole stretch, as a secret may hold other characters."""
    found = [(m.start(), m.end()) for m in PIECE.finditer(text, start, end) if score(m[0], model) >= threshold]
    if found or end - start < TOKEN_LEAST:
        return found
    return [(start, end)] if score(text[start:end], model) >= threshold else []


def spans_of(text: str, model: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Base spans, and what the models call random in the stretches of tokens that base spans leave over; by start, then kind."""
    spans, more = base_spans(text), []
    for m in TOKEN.finditer(text):
        at = m.start()
        for s, e, _ in [*spans, (m.end(), m.end(), "")]:
            if s >= at and s <= m.end() and s - at >= TOKEN_LEAST:
                more += [(*r, "markov") for r in random_spans(text, at, s, model, threshold)]
            if s <= m.end() and e > m.start():
                at = max(at, e)
    return sorted(spans + more, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, model: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts, digests and spans for each row of (doc_id, text); null texts are empty and have no spans. No shuffle of texts."""
    model = train(docs) if model is None else model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                spans = spans_of(text or "", model, threshold)
                base = [s for s in spans if s[2] != "markov"]
                n = Counter(s[2] for s in spans)
                out.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n["markov"]))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"]).astype({"doc_id": "Int64"})

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(bounded(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def redact(docs: DataFrame, model: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every row and column of docs; secrets in text are replaced by a mark and n_chars, if there, follows. A null text stays null."""
    model = train(docs) if model is None else model

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None if t is None else masked(t, spans_of(t, model, threshold)) for t in texts], dtype=object)
        give_back()
        return out

    out = small_batches(docs).withColumn("text", run("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*quoted(docs))
