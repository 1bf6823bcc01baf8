"""Cross-tokenizer alignment: where the tokens of two tokenizers over the same bytes begin, overlap and end together."""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, quoted, small_batches, written
from .tokens import _ALPHABET, flat, ranges

#: Bytes of text that are aligned at once, and chunks whose ids a worker keeps.
SPAN, CACHE = 4_000_000, 400_000
#: Which token pairs are links: those whose byte ranges end together, those that share a byte, or all of a group.
KINDS = ("ends", "overlaps", "groups")

# A byte-level tokenizer whose pieces never cross a space that follows something else than white space.
SPACEWISE = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}


def default_paths() -> tuple[str, str]:
    public = importlib.import_module("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


class ByteLevel:
    """A byte-level .json file. Special tokens' strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        back = {chr(c): b for b, c in _ALPHABET.items()} | {chr(b): b for b in range(256) if b not in _ALPHABET}
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocab = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in added else bytes(back[c] for c in token)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.spacewise = all(told[k] == v for k, v in SPACEWISE.items())

    def batch(self, spaced: list[str]) -> list[list[int]]:
        """The ids of texts that begin with a space."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]


class Pieces:
    """A sentencepiece .model file, which adds the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.tokenizer.id_to_piece(i) for i in range(self.tokenizer.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes = [bytes.fromhex(m[1]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        # Words stand alone if no piece holds a space after something else, and spaces stay as they are.
        self.space = self.tokenizer.piece_to_id("▁")
        self.spacewise = "▁" in pieces and not any("▁" in p.lstrip("▁") for p in pieces) and "".join(self.tokenizer.encode("a  b", out_type=str)) == "▁a▁▁b"

    def batch(self, spaced: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode([t[1:] for t in spaced], num_threads=1)
        return [x if t != " " else [self.space] for x, t in zip(found, spaced, strict=True)]  # no space is added before nothing


class Both:
    """Two tokenizers, and the ids of chunks that were met before.

    Where both treat what follows a space alone, a text is cut before each space that stands after something else, and each
    distinct chunk is encoded once; else whole texts are encoded. Either way the ids are those of whole texts.
    """

    def __init__(self, paths: tuple[str, str]):
        self.sides = (ByteLevel(paths[0]), Pieces(paths[1]))
        self.spacewise = all(s.spacewise for s in self.sides)
        self.lengths = [np.array([len(b) for b in s.bytes], np.int64) for s in self.sides]
        # Texts of each id, with what follows it in a group's text: a comma, or a bar after the last of A, a semicolon after that of B.
        self.texts = np.array([f"{i}{c}" for side, follows in zip(self.sides, (",|", ",;"), strict=True) for c in follows for i in range(len(side.bytes))], dtype=object)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.first, self.pool = [np.zeros(1, np.int64)] * 2, [np.empty(0, np.int64)] * 2
        self.good = np.empty(0, bool)

    def cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where chunks begin: texts, and spaces after an ASCII character that isn't white or a letter of two bytes from U+00C0 on."""
        cut = np.zeros(len(data) + 1, bool)
        if self.spacewise and len(data) > 2:
            plain = (data > 0x20) & (data < 0x80)
            wide = (data >= 0xC3) & (data <= 0xDF)
            after = plain[1:-1] | (data[1:-1] >= 0x80) & wide[:-2]
            cut[2:-1] = (data[2:] == 0x20) & after
            cut[1] = data[1] == 0x20 and plain[0]
        cut[at] = True
        cut[-1] = False
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Of texts data[at[i] : at[i + 1]], each empty or beginning with a space: ids of each side, each text's first, and whether
        the ids' bytes are the text's on both sides."""
        if len(self.slot) > CACHE:
            self.clear()
        begin = self.cuts(data, at)
        offsets = np.append(begin, len(data))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        words = chunks.dictionary.to_pylist()
        new = [w for w in words if w not in self.slot]
        if new:
            self.add(new)
        slot = np.fromiter((self.slot[w] for w in words), np.int64, len(words))[chunks.indices.to_numpy(zero_copy_only=False)] if words else np.empty(0, np.int64)
        text = np.searchsorted(begin, at)
        ids, firsts = [], []
        for first, pool in zip(self.first, self.pool, strict=True):
            counts = first[slot + 1] - first[slot]
            ids.append(pool[ranges(first[slot], counts)])
            firsts.append(np.append(0, np.cumsum(counts))[text])
        good = np.ones(len(at) - 1, bool)
        for i in np.unique(np.searchsorted(text, np.flatnonzero(~self.good[slot]), "right") - 1):  # a text may be right though its chunks aren't
            raw = data[at[i] : at[i + 1]].tobytes()
            good[i] = all(b"".join(map(side.bytes.__getitem__, x[f[i] : f[i + 1]].tolist())) == raw for side, x, f in zip(self.sides, ids, firsts, strict=True))
        return ids, firsts, good

    def add(self, chunks: list[bytes]) -> None:
        texts, same = [c.decode() for c in chunks], np.ones(len(chunks), bool)
        for k, side in enumerate(self.sides):
            found = side.batch(texts)
            same &= [b"".join(map(side.bytes.__getitem__, x)) == c for x, c in zip(found, chunks, strict=True)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            self.first[k] = np.append(self.first[k], self.first[k][-1] + np.cumsum(counts))
            self.pool[k] = np.append(self.pool[k], np.fromiter((i for x in found for i in x), np.int64, int(counts.sum())))
        self.slot.update(zip(chunks, range(len(self.slot), len(self.slot) + len(chunks)), strict=True))
        self.good = np.append(self.good, same)


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elementary intervals between all ends: each one's owner of A and of B, and whether it closes a group.

    Both are ascending ends of tokens that cover the same bytes without a gap; an interval lies in one token of each, and is their overlap.
    """
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def linked(a: np.ndarray, b: np.ndarray, closes: np.ndarray, kind: str = "ends") -> tuple[np.ndarray, np.ndarray]:
    """Places of A and B tokens that are linked: of intervals that close a group, of all intervals, or each A with each B of a group."""
    if kind == "ends":
        return a[closes], b[closes]
    if kind == "overlaps":
        return a, b
    if kind != "groups":
        raise ValueError(f"kind must be one of {KINDS}")
    last_a, last_b = a[closes], b[closes]
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    first_a, first_b = last_a + 1 - n_a, last_b + 1 - n_b
    of_a = ranges(first_a, n_a)
    return np.repeat(of_a, np.repeat(n_b, n_a)), ranges(np.repeat(first_b, n_a), np.repeat(n_b, n_a))


_kept: dict[tuple[str, str], Both] = {}


def both(paths: tuple[str, str]) -> Both:
    """One for each Python worker and pair of files."""
    if paths not in _kept:
        _kept[paths] = Both(paths)
    return _kept[paths]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<int>"


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, kind: str = "ends") -> DataFrame:
    """Each row's (doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts): pairs are the distinct linked ids, A's
    times 2^32 plus B's, counts how often the text has them.

    Encoded is a space and the text. Byte offsets where tokens of both end cut them into groups. A null or empty text, or one whose
    bytes either side doesn't give back, has no tokens: zeros, no pairs, and an empty text for the digest. Rows are looked at one
    by one, so repeated rows and ids, null ids and other columns change nothing; no rows give none. No shuffle.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = both(paths)
        for batch in batches:
            done = 0
            for group in _by_bytes(batch.column(1)):
                yield _batch(tokens, batch.column(0).slice(done, len(group)), group, kind)
                done += len(group)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(bounded(run), ALIGNED)


def _by_bytes(texts: pa.Array) -> Iterator[pa.Array]:
    data, at = flat(texts)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + SPAN, "right")) - 1)
        yield texts.slice(begin, end - begin)
        begin = end


def _batch(tokens: Both, doc_ids: pa.Array, texts: pa.Array, kind: str) -> pa.RecordBatch:
    data, at = flat(texts)
    raw = data.tobytes()
    data = np.frombuffer(b"".join(b" " + raw[a:b] if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.uint8)
    at = at + np.append(0, np.cumsum(np.diff(at) > 0))
    ids, firsts, good = tokens.encode(data, at)
    n = [np.where(good, np.diff(f), 0) for f in firsts]
    # Texts that stand count on: one after another, both sides cover the same bytes.
    ids = [x[np.repeat(good, np.diff(f))] for x, f in zip(ids, firsts, strict=True)]
    ends = [np.cumsum(size[x]) for size, x in zip(tokens.lengths, ids, strict=True)]
    a, b, closes = intervals(*ends)
    stop = np.cumsum(np.where(good, np.diff(at), 0))  # each text's last byte
    shared = ends[0][a[closes]]
    groups = np.diff(np.searchsorted(shared, stop, "right"), prepend=0)
    x, y = linked(a, b, closes, kind)
    text = np.searchsorted(stop, ends[0][x])
    links = np.bincount(text, minlength=len(at) - 1)
    # Distinct pairs of each text.
    pair = ids[0][x] << 32 | ids[1][y]
    order = np.lexsort((pair, text))
    pair, text = pair[order], text[order]
    head = np.ones(len(pair), bool)
    head[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
    where = np.flatnonzero(head)
    counts = np.diff(np.append(where, len(pair))).astype(np.int32)
    bounds = pa.array(np.append(0, np.cumsum(np.bincount(text[where], minlength=len(at) - 1))), pa.int32())
    columns = [doc_ids, *(pa.array(v, pa.int64()) for v in (*n, groups, links)), pa.array(_digests(tokens, ids, n, a, b, closes), pa.string())]
    columns += [pa.ListArray.from_arrays(bounds, pa.array(pair[where], pa.int64())), pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])


def _digests(tokens: Both, ids: list[np.ndarray], n: list[np.ndarray], a: np.ndarray, b: np.ndarray, closes: np.ndarray) -> list[str]:
    """Each text's digest of its groups: both sides' ids are laid out in the order of the text, a group's A before its B."""
    last = (a[closes], b[closes])
    n_a, n_b = (np.diff(x, prepend=-1) for x in last)
    size_a, size_b = len(tokens.sides[0].bytes), len(tokens.sides[1].bytes)
    code_a, code_b = ids[0].copy(), ids[1] + 2 * size_a
    code_a[last[0]] += size_a
    code_b[last[1]] += size_b
    place_a = np.arange(len(code_a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)
    place_b = np.arange(len(code_b)) + np.repeat(np.cumsum(n_a), n_b)
    code = np.empty(len(code_a) + len(code_b), np.int64)
    code[place_a], code[place_b] = code_a, code_b
    texts, at = tokens.texts[code].tolist(), np.append(0, np.cumsum(n[0] + n[1])).tolist()
    return [hashlib.sha256("".join(texts[i:j])[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True)]


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n): how many links of all rows of aligned() hold each pair of ids. Counts of a task's rows are added before the shuffle."""
    each = found.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy("p.pairs").agg(F.sum("p.counts").alias("n"))
    return each.select(F.shiftright("pairs", 32).cast("int").alias("a"), F.col("pairs").bitwiseAND((1 << 32) - 1).cast("int").alias("b"), "n")


def translation(found: DataFrame) -> DataFrame:
    """(a, b, n, share, rank) of all pairs: share of the B id's links, rank by n among the B id's, ties to smaller a."""
    from pyspark.sql.window import Window

    of_b = Window.partitionBy("b")
    return pair_counts(found).select("a", "b", "n", (F.col("n") / F.sum("n").over(of_b)).alias("share"), F.row_number().over(of_b.orderBy(F.desc("n"), "a")).alias("rank"))


def most_pairs(paths: tuple[str, str]) -> int:
    """How many distinct pairs can end together at most: one's bytes are then the end of the other's."""
    sides = both(paths).sides
    return sum(len(t) for side in sides for t in side.bytes)


def digests(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row, links being tokens that end together.

    A pair's count is how many links of all rows hold it; n_best counts the links whose count is their B id's highest, ties
    included; count_sum is the sum over links. Odd rows as in aligned(). The alignments are written once. Of two
    tokens that end together one's bytes end the other's, so the vocabularies bound the pairs (492,481 for the default
    files, whatever the corpus): their counts go to each task, and the rows need no shuffle.
    """
    paths = paths or default_paths()
    found = written(aligned(docs, paths), "alignments")
    table = pair_counts(found).toArrow()
    if table.num_rows > most_pairs(paths):
        raise RuntimeError("more pairs than two vocabularies can have")
    key = table["a"].to_numpy().astype(np.int64) << 32 | table["b"].to_numpy()
    order = np.argsort(key)
    key, n = key[order], table["n"].to_numpy()[order]
    of_b = key & ((1 << 32) - 1)
    highest = np.zeros(int(of_b.max()) + 1 if len(of_b) else 0, np.int64)
    np.maximum.at(highest, of_b, n)
    best = n == highest[of_b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, counts = batch.column(6), batch.column(7)
            at = pairs.offsets.to_numpy().astype(np.int64)
            p, c = pairs.values.to_numpy()[at[0] : at[-1]], counts.values.to_numpy()[counts.offsets[0].as_py() : counts.offsets[-1].as_py()].astype(np.int64)
            i, at = np.searchsorted(key, p), at - at[0]
            sums = [np.append(0, np.cumsum(v))[at] for v in (c * best[i], c * n[i])] if len(key) else [np.zeros(len(at), np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(np.diff(s), pa.int64()) for s in sums), batch.column(5)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return found.select(*quoted(found)).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
