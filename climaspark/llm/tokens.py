"""Token ids of whole texts from public tokenizer files, held in flat arrays; where a tokenizer allows it, by distinct words."""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .common import U64, by_size, mix

#: Bytes of text that are worked on at once, words that a worker keeps, and the longest that is kept.
SPAN, CACHE, WIDEST = 2_000_000, 1_000_000, 31
_LANES = 4

# The configuration whose texts may be cut at spaces and between letters and other characters, and whose case doesn't count.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

# Bytes by kind: white space, letters (of ASCII and U+00C0 to U+00FF), other ASCII, the apostrophe, and what starts any other character.
_SPACE, _LETTER, _OTHER, _QUOTE, _ODD = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, 0x0A]] = _SPACE
_KIND[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_KIND[0x27] = _QUOTE
_KIND[0x80:0xC0] = _KIND[0xC3] = _LETTER
_KIND[0xC2] = _ODD
_KIND[0xC4:] = _ODD
_LOW = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
#: Whether two neighbouring kinds are cut apart.
_CUT = np.zeros((5, 5), bool)
_CUT[_SPACE, 1:] = _CUT[1:, _SPACE] = _CUT[_LETTER, _OTHER] = _CUT[_OTHER, _LETTER] = True
_CUT = _CUT.ravel()
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: The byte alphabet's rule: printable bytes of Latin-1 stand for themselves, the others for characters from 256 on.
_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE))}


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... counts[0] of them, then first[1], ... : the indices of runs, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(first - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Whole:
    """Texts encoded whole, by any public file: .json (tokenizers), .tiktoken (with the public pattern) or .model (sentencepiece)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.batch = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            pattern = importlib.import_module("public_tokenizers").PATTERN
            self.tokenizer = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.batch = lambda texts: [self.tokenizer.encode_ordinary(t) for t in texts]
        else:
            import sentencepiece

            self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch = lambda texts: self.tokenizer.encode(texts, num_threads=1)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts data[at[i] : at[i + 1]], UTF-8, one after another, and the place of each text's first (one more than texts)."""
        parts: list[np.ndarray] = []
        for texts in by_size(data[a:b].tobytes().decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            parts += [np.asarray(x, "<u4") for x in self.batch(texts)]
        first = np.zeros(len(at), np.int64)
        np.cumsum([len(x) for x in parts], out=first[1:])
        return (np.concatenate(parts) if parts else np.empty(0, "<u4")), first


class Words(Whole):
    """Ids by distinct words, for a tokenizer that treats what stands between spaces, and letters and other characters, alone.

    A word of at most WIDEST bytes is its own key, four 64-bit numbers; a sorted index of their hashes finds it, and the
    bytes are compared, so that no two words are taken for each other. Words met again stay when the store is full.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.hash, self.slot = np.empty(0, U64), np.empty(0, np.int64)
        self.key, self.first, self.again = np.empty((1024, _LANES), U64), np.zeros(1025, np.int64), np.zeros(1024, bool)
        self.pool = np.empty(4096, "<u4")

    def words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each word, and whether it is odd: it may hold characters beyond those letters, or a special token, and
        is left whole between its spaces, in its own case."""
        kind = _KIND[data]
        cut = np.empty(len(data) + 1, bool)
        cut[0] = cut[-1] = True
        cut[1:-1] = _CUT[kind[:-1] * np.uint8(5) + kind[1:]]
        cut[at] = True
        edge = np.flatnonzero(cut)
        # Odd: other characters than those letters, multiplication and division signs, and <| of a special token.
        special = (data[:-1] == 0x3C) & (data[1:] == 0x7C) | (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        odd_at = np.flatnonzero(kind == _ODD)
        if special.any():
            odd_at = np.concatenate([odd_at, np.flatnonzero(special)])
        odd = np.zeros(len(edge) - 1, bool)
        if len(odd_at):
            white = np.zeros(len(edge), bool)
            inner = edge[:-1]
            white[:-1] = (kind[inner] == _SPACE) | (kind[np.maximum(inner - 1, 0)] == _SPACE)
            white[0] = white[-1] = True
            white[np.searchsorted(edge, at)] = True
            spaced = np.cumsum(white) - 1
            bad = np.zeros(spaced[-1] + 1, bool)
            bad[np.searchsorted(edge[white], odd_at, "right") - 1] = True
            edge, spaced = edge[keep := white | ~bad[spaced]], spaced[keep]
            odd = bad[spaced[:-1]]
        begin, end = edge[:-1], edge[1:]
        full = kind[begin] != _SPACE
        return begin[full], end[full], odd[full]

    def keys(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's key, its length in the last byte, and the key's hash. Letters count as small ones where the word isn't odd."""
        both = np.concatenate([_LOW[data], data if odd.any() else data[:0], np.zeros(8 * _LANES, np.uint8)])
        at = np.where(odd, begin + len(data), begin)
        wide = np.ndarray(len(both) - 7, "<u8", both, strides=(1,))
        key = np.zeros((len(begin), _LANES), U64)
        key[:, 0] = wide[at] & _MASK[np.minimum(size, 8)]
        h = mix(key[:, 0] ^ (size.astype(U64) << U64(57)))
        for lane in range(1, _LANES):
            more = np.flatnonzero(size > 8 * lane)
            key[more, lane] = wide[at[more] + 8 * lane] & _MASK[np.minimum(size[more] - 8 * lane, 8)]
            h[more] = mix(h[more] ^ key[more, lane])
        key[:, -1] |= size.astype(U64) << U64(56)
        return key, h

    def new(self, words: list[bytes]) -> list[list[int]]:
        """A word of small letters is one piece for the tokenizer's model, whose alphabet stands for bytes; others are encoded as texts."""
        out: list = [None] * len(words)
        model, rest = self.tokenizer.model, []
        for i, raw in enumerate(words):
            word = raw.decode()
            if word.isalpha() and word.islower() and (word.isascii() or max(word) <= "\xff"):
                out[i] = [t.id for t in model.tokenize(word if word.isascii() else raw.decode("latin-1").translate(_ALPHABET))]
            else:
                rest.append((i, word))
        for (i, _), ids in zip(rest, self.batch([w for _, w in rest]) if rest else [], strict=True):
            out[i] = ids
        return out

    def add(self, h: np.ndarray, key: np.ndarray, ids: list[list[int]], indexed: np.ndarray) -> np.ndarray:
        """Stores words; their slots."""
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        n, size = self.n + len(ids), self.first[self.n] + counts.sum()
        if n > len(self.key):
            grown = max(n, 2 * len(self.key))
            self.key, self.first, self.again = (np.concatenate([x, np.zeros((grown + k - len(x), *x.shape[1:]), x.dtype)]) for x, k in ((self.key, 0), (self.first, 1), (self.again, 0)))
        if size > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(size, 2 * len(self.pool)) - len(self.pool), "<u4")])
        self.key[self.n : n], self.again[self.n : n] = key, False
        self.first[self.n + 1 : n + 1] = self.first[self.n] + np.cumsum(counts)
        self.pool[self.first[self.n] : size] = np.fromiter((i for x in ids for i in x), "<u4", int(counts.sum()))
        slot = np.arange(self.n, n)
        self.n = n
        at = np.searchsorted(self.hash, h[indexed])
        self.hash, self.slot = np.insert(self.hash, at, h[indexed]), np.insert(self.slot, at, slot[indexed])
        return slot

    def shrink(self) -> None:
        """Keeps the words that were met again, if they are less than half of what may be kept."""
        kept = np.flatnonzero(self.again[: self.n][self.slot])
        h, slot = self.hash[kept], self.slot[kept]
        if len(slot) > CACHE // 2:
            h, slot = h[:0], slot[:0]
        counts = self.first[slot + 1] - self.first[slot]
        key, pool = self.key[slot], self.pool[ranges(self.first[slot], counts)]
        self.clear()
        self.n, self.hash, self.slot = len(slot), h, np.arange(len(slot))
        self.key, self.again, self.pool = np.concatenate([key, self.key]), np.zeros(len(slot) + len(self.again), bool), np.concatenate([pool, self.pool])
        self.first = np.concatenate([[0], np.cumsum(counts), np.zeros(1024, np.int64)]).astype(np.int64)

    def slots(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Each word's slot; -1 for those that must be encoded by themselves, too long or of another word's hash."""
        size = end - begin
        short = size <= WIDEST
        where = np.flatnonzero(short)
        out = np.full(len(begin), -1)
        if not len(where):
            return out
        key, h = self.keys(data, begin[where], size[where], odd[where])
        order = np.argsort(h)
        head = np.empty(len(h), bool)
        head[0] = True
        np.not_equal(h[order[1:]], h[order[:-1]], out=head[1:])
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(head) - 1
        one = order[head]
        of, mine = h[one], key[one]
        at = np.minimum(np.searchsorted(self.hash, of), max(len(self.hash) - 1, 0))
        slot, known = np.full(len(one), -1), np.zeros(len(one), bool)
        if len(self.hash):
            known = self.hash[at] == of
            slot[known] = self.slot[at[known]]
            same = (self.key[slot[known]] == mine[known]).all(1)
            self.again[slot[known][same]] = True
            slot[np.flatnonzero(known)[~same]] = -1
        lack = np.flatnonzero(slot < 0)
        if len(lack):
            at = where[one[lack]]
            low = _LOW[data]
            words = [(data if o else low)[a:b].tobytes() for a, b, o in zip(begin[at].tolist(), end[at].tolist(), odd[at].tolist(), strict=True)]
            slot[lack] = self.add(of[lack], mine[lack], self.new(words), ~known[lack])
        out[where] = np.where((key == mine[group]).all(1), slot[group], -1)
        return out

    def span(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode() of one span."""
        if not len(data):
            return np.empty(0, "<u4"), np.zeros(len(at), np.int64)
        if self.n > CACHE:
            self.shrink()
        begin, end, odd = self.words(data, at)
        slot = self.slots(data, begin, end, odd)
        alone = np.flatnonzero(slot < 0)
        counts = self.first[slot + 1] - self.first[slot]
        single = [np.asarray(x, "<u4") for x in self.batch([data[a:b].tobytes().decode() for a, b in zip(begin[alone].tolist(), end[alone].tolist(), strict=True)])] if len(alone) else []
        counts[alone] = [len(x) for x in single]
        start = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=start[1:])
        source = self.first[slot]
        source[alone] = 0
        ids = self.pool[np.minimum(ranges(source, counts), len(self.pool) - 1)]
        for i, x in zip(start[alone].tolist(), single, strict=True):
            ids[i : i + len(x)] = x
        return ids, start[np.searchsorted(begin, at)]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, first, have = [], np.zeros(len(at), np.int64), 0
        for lo, hi in spans(data, at):
            a, b = np.searchsorted(at, (lo, hi), "left")
            ids, place = self.span(data[lo:hi], at[a:b] - lo)
            first[a:b] = have + place
            parts.append(ids)
            have += len(ids)
        first[np.searchsorted(at, len(data)) :] = have
        return (np.concatenate(parts) if parts else np.empty(0, "<u4")), first


def spans(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about SPAN bytes that end at a text's end or before a space, so that a long text needs no more memory than a short one."""
    lo = 0
    while lo < len(data):
        hi = lo + SPAN
        if hi >= len(data):
            hi = len(data)
        else:
            stop = int(at[np.searchsorted(at, hi)])
            while hi < stop:
                found = np.flatnonzero(_KIND[data[hi : min(hi + 65_536, stop)]] == _SPACE)
                hi = hi + int(found[0]) if len(found) else min(hi + 65_536, stop)
                if len(found):
                    break
        yield lo, hi
        lo = hi


def is_wordwise(path: str) -> bool:
    """Whether the file's own configuration says that words stand alone: what WORDWISE tells, and special tokens that begin with <| and hold no space."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model = {k: told["model"].get(k) for k in ("type", "dropout", "unk_token", "continuing_subword_prefix", "byte_fallback")}
    special = all(t["content"].startswith("<|") and not any(map(str.isspace, t["content"])) and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in told["added_tokens"])
    return special and all(told[k] == v for k, v in WORDWISE.items()) and model == {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False}


_kept: dict[str, Whole] = {}


def encoder(path: str) -> Whole:
    """One for each Python worker and file."""
    if path not in _kept:
        _kept[path] = (Words if is_wordwise(path) else Whole)(path)
    return _kept[path]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, not copied, and each text's place (one more than texts). A null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def ids_of(path: str, texts: Iterable[str]) -> list[np.ndarray]:
    """Each text's ids."""
    ids, first = encoder(path).encode(*flat(pa.array(list(texts), pa.string())))
    return np.split(ids, first[1:-1])


def default_tokenizer() -> str:
    return importlib.import_module("public_tokenizers").path("word_bpe_49k.json")
