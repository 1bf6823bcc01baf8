"""Packing by powers of two: each document's tokens are cut into pieces of binary lengths, and pieces of one length form a bucket."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, small_batches
from .tokens import default_tokenizer, encoder, flat

LENGTH, END = 2048, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def binary_lengths(totals: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(document, piece's length) of documents of so many tokens, in order: whole sequences first, then the powers of two that
    the rest is made of, the largest first."""
    bits = np.arange(length.bit_length() - 2, -1, -1)
    times = np.concatenate([(totals // length)[:, None], (totals % length)[:, None] >> bits & 1], axis=1)
    return np.repeat(np.arange(len(totals)), times.sum(1)), np.repeat(np.tile([length, *(1 << bits)], len(totals)), times.ravel())


def pack(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of (doc_id, text), each of a power of two tokens and a sequence of its own: no padding, no sequence over two documents.

    A null or empty text is the end token alone. bucket is the length's logarithm; sequence_id is the input partition and
    a count in it, so a task that runs again gives the same. `length` is a power of two. with_ids adds the ids themselves,
    to be written by write_buckets(). Other columns are not looked at; rows of one doc_id are packed each for itself; no rows
    give no pieces. No shuffle, and one Arrow batch of texts in a task's memory. tokenizer_path: see tokens.Whole.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, sequence = encoder(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, first = tokens.encode(*flat(batch.column(1)))
            ids, first = np.insert(ids, first[1:], end), first + np.arange(len(first))
            doc, size = binary_lengths(np.diff(first), length)
            stop = np.cumsum(size)
            begin, n = stop - size, len(size)
            raw = memoryview(ids).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), begin - first[doc], size, sums, np.diff(first)[doc], np.arange(sequence, sequence + n), np.zeros(n, np.int64), np.log2(size).astype(np.int32)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.view("<i4"))))
            names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int32() if name == "bucket" else pa.int64()) for name, c in zip(names, columns, strict=True)], names)
            sequence += n

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(bounded(run), PIECES + (", ids array<int>" if with_ids else ""))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, so that a batch of equal lengths is a read of one folder."""
    pieces.write.partitionBy("bucket").parquet(path)
