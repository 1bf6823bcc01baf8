"""Document fingerprints: Lempel-Ziv phrases, hashed, and the least hash of each slot."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded, mix, segment_hashes, small_batches

SLOTS = 128
_EMPTY = 0xFFFF


def phrases(text: str, seen: dict | None = None) -> dict[str, None]:
    """LZ78: each phrase is the shortest piece that is not yet in the dictionary; they are the keys, in the text's order.

    A last piece that is in the dictionary already adds nothing. With `seen` the parse goes on from that dictionary.
    """
    seen = {} if seen is None else seen
    piece = ""
    for character in text:
        piece += character
        if piece not in seen:
            seen[piece] = None
            piece = ""
    return seen


def slots(found: list[str]) -> np.ndarray:
    """The least 64-bit phrase hash of each slot; a slot without a phrase has the largest number."""
    least = np.full(SLOTS, np.iinfo(U64).max, U64)
    if found:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        points = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), "<u4")
        h = segment_hashes(points, np.cumsum(lengths) - lengths, lengths)
        np.minimum.at(least, (h % U64(SLOTS)).astype(np.intp), mix(h))
    return least


def encode(least: np.ndarray) -> str:
    """Four hexadecimal digits for each slot: 16 bits of its least hash, ffff for an empty one."""
    short = np.where(least == np.iinfo(U64).max, _EMPTY, (mix(least) % U64(_EMPTY)).astype(np.uint32)).astype(">u2")
    return short.tobytes().hex()


def fingerprint_of(text: str) -> str:
    return encode(slots(list(phrases(text))))


def alike(x: str, y: str) -> float:
    """The share of equal slots among those that either text fills: the estimated Jaccard likeness of the phrase sets. Two empty texts: 1."""
    p, q = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (x, y))
    used = (p != _EMPTY) | (q != _EMPTY)
    return float((p == q)[used].mean()) if used.any() else 1.0


def fingerprint(text: str | Column) -> Column:
    """A string of 512 hexadecimal digits for each whole text; null counts as empty. Equal texts have equal fingerprints."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t or "") for t in texts])

    return run(F.col(text) if isinstance(text, str) else text)


def likeness(x: str | Column, y: str | Column) -> Column:
    """0 to 1 for two fingerprints; null if either is null."""

    @F.pandas_udf("double")
    def run(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else alike(a, b) for a, b in zip(p, q, strict=True)], dtype=object)

    return run(F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by (span, guest, doc_id): each is paired with the row after it, a span's last row with its guest."""
    held: tuple | None = None

    def of(row: tuple, after: tuple) -> tuple:
        _, doc_id, text, found, mine = row
        n, take = len(text), len(text) // 4
        edited = text[: n - take] + after[2][:take]
        # The parse of the edited text begins as that of the text: with the phrases that end before the edit.
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        same = int(np.searchsorted(ends, n - take, "right"))
        known = dict.fromkeys(found[:same])
        changed = list(phrases(edited[int(ends[same - 1]) if same else 0 :], known))
        theirs = encode(slots(changed))
        return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mine, theirs, alike(mine, theirs), alike(mine, after[4])

    for pdf in batches:
        out = []
        for span, guest, doc_id, text in zip(pdf["span"], pdf["guest"], pdf["doc_id"], pdf["text"], strict=True):
            if guest and held is None:
                continue
            found = list(phrases(text))
            now = (span, None if pd.isna(doc_id) else int(doc_id), text, found, encode(slots(found)))
            if held is not None:
                out.append(of(held, now))
            held = None if guest else now
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EDITED.split(", ")]).astype({"doc_id": "Int64"})


def edited_likeness(docs: DataFrame, spans: int | None = None) -> DataFrame:
    """Fingerprints of every text of (doc_id, text) and of its edited text, whose last floor(n/4) code points are the next document's first.

    One shuffle of the texts by spans of doc_id; the first document of each span goes to the span before it as well, so
    that every document meets its successor. Null texts are empty; null doc_ids come first; rows of one doc_id go by text.
    The last document's successor is the first one; a lone document is its own. No rows: no rows.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = spans or 4 * width  # several a task, so that tasks are about even
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = docs.agg(F.percentile_approx("doc_id", [i / spans for i in range(1, spans)], 20 * spans)).first()[0] if spans > 1 else None
    cuts = np.unique(np.array(found or [], np.int64))

    def spans_at(ids: pd.Series) -> pd.Series:
        """How many cuts are not above the id; nulls belong to the first span."""
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), "right")).astype(np.int32))

    # At most one row for each span: which document comes first in it, and so is the guest of the span before.
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    firsts = docs.groupBy(F.pandas_udf(spans_at, "int")("doc_id").alias("span")).agg(F.min(order).alias("id")).orderBy("span").collect()
    hosts = {r["id"]["doc_id"]: firsts[i - 1]["span"] for i, r in enumerate(firsts)}
    of_null = hosts.pop(None, None)
    guests = np.array(sorted(hosts), np.int64)
    before = np.array([hosts[g] for g in guests.tolist()], np.int32)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        """The row's span, and the span that it is a guest of, if any."""
        span, known = spans_at(ids), ids.notna().to_numpy()
        x = ids.fillna(0).to_numpy(np.int64)
        at = np.minimum(np.searchsorted(guests, x), max(len(guests) - 1, 0))
        host = np.where(guests[at] == x, before[at], -1) if len(guests) else np.full(len(x), -1)
        host = np.where(known, host, -1 if of_null is None else of_null)
        return pd.Series([[s] if h < 0 else [s, h] for s, h in zip(span.tolist(), host.tolist(), strict=True)])

    rows = docs.select("doc_id", "text", F.posexplode(places("doc_id")).alias("guest", "span"))
    rows = rows.select("span", (F.col("guest") > 0).alias("guest"), "doc_id", "text")
    return rows.repartition(width, "span").sortWithinPartitions("span", "guest", "doc_id", "text").mapInPandas(bounded(_edited), EDITED)
