"""Phrase collocation mining: phrases of up to five words a language, scored by how far they exceed what their parts tell."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, bounded, mix, segment_hashes, small_batches, written

LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
#: Characters of one language that are counted together, and bits of a sieve, which is 16 MB whatever the corpus.
SPAN, BITS = 1 << 22, 1 << 27
_LANGUAGE, _NEXT, _SECOND = 0x8CB92BA72F3D8DD7, U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)

# What ends a piece, and what parts words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_READ = bytes.maketrans(bytes(range(65, 91)) + ENDS + BLANKS, bytes(range(97, 123)) + b"\n" * len(ENDS) + b" " * len(BLANKS))


class Words:
    """The words of some texts of one language: distinct ones, each place's word, and whether the next place is in the same piece."""

    def __init__(self, language: str, texts: list[str]):
        data = np.frombuffer("\n".join(texts).encode().translate(_READ), np.uint8)
        inside = (data != 0x20) & (data != 0x0A)
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at = np.append(0, np.cumsum(end - begin))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(data[inside])]).dictionary_encode()
        self.distinct = coded.dictionary
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        breaks = np.searchsorted(np.flatnonzero(data == 0x0A), begin)
        self.goes_on = np.append(breaks[1:] == breaks[:-1], False) if len(begin) else np.empty(0, bool)
        self.language = language_hash(language)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.distinct)

    def phrases(self, places: np.ndarray, k: int) -> pa.Array:
        """The texts of the k words from each place on."""
        words = [self.distinct.take(pa.array(self.ids[places + j])) for j in range(k)]
        joined = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if k > 1 else words[0]
        return joined.cast(pa.large_string())


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word of a large_binary array, none of them empty."""
    if not len(words):
        return np.empty(0, U64)
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]]
    return segment_hashes(data, at[:-1] - at[0], np.diff(at))


def language_hash(language: str) -> np.uint64:
    return U64(int.from_bytes(language.encode()[-7:], "little") * _LANGUAGE % 2**64)  # a sieve's languages may meet, which only lets more through


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _NEXT + right)


def bits_of(h: np.ndarray, language: np.uint64, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a sieve."""
    h = mix(h ^ language)
    return h % U64(size), mix(h + _SECOND) % U64(size)


def sieve(frequent: DataFrame, size: int = BITS) -> np.ndarray:
    """A Bloom filter of phrases (lang, phrase): what passes it may be one of them, what doesn't is none. `size` bits, however many phrases there are.

    Only these bits come to the driver and go to the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = pc.split_pattern(batch.column(1).cast(pa.large_binary()), b" ")
                h, n = word_hashes(words.values), pc.list_value_length(words).to_numpy()
                first = np.cumsum(n) - n
                out = h[first]
                for j in range(1, int(n.max())):
                    more = np.flatnonzero(n > j)
                    out[more] = joined_hash(out[more], h[first[more] + j])
                language = np.array([language_hash(x) for x in batch.column(0).to_pylist()], U64)
                bits = np.concatenate(bits_of(out, language, size)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.left_shift(np.int64(1), bits & 63))], ["at", "bit"])

    found = frequent.select("lang", "phrase").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(-(-size // 64), U64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(U64)
    return out


def passes(bits: np.ndarray, h: np.ndarray, language: np.uint64, size: int) -> np.ndarray:
    one, two = bits_of(h, language, size)
    return ((bits[one >> U64(6)] >> (one & U64(63))) & (bits[two >> U64(6)] >> (two & U64(63))) & U64(1)).astype(bool)


def counted(words: Words, lengths: Sequence[int], bits: np.ndarray | None = None, parts: int = 0, size: int = BITS) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(k, phrases, counts) of the distinct phrases of each length, of those all of whose runs of `parts` words pass the sieve."""
    ids, n, v = words.ids, len(words.ids), max(len(words.distinct), 1)
    if n and 1 in lengths:
        yield 1, words.distinct.cast(pa.large_string()), np.bincount(ids, minlength=v)
    h = words.hashes() if parts else None
    # Phrases of k words at each place as numbers, exactly: those of k - 1 words and the next word, numbered anew.
    number, there, good = ids, np.ones(n, bool), np.ones(n, bool)
    for k in range(1, max(lengths) + 1):
        m = n - k + 1
        if m < 1:
            return
        if k > 1:
            there = there[:m] & words.goes_on[k - 2 : k - 2 + m]
            if parts and k > parts:
                there &= good[k - parts : k - parts + m]
        places = np.flatnonzero(there)
        if k == parts == 1:
            there = good = passes(bits, h, words.language, size)[ids]
        elif k == parts:
            run = h[ids[places]]
            for j in range(1, k):
                run = joined_hash(run, h[ids[places + j]])
            places = places[passes(bits, run, words.language, size)]
            there = good = np.bincount(places, minlength=m).astype(bool)
        if k > 1:
            distinct, first, back, counts = np.unique(number[places] * v + ids[places + k - 1], return_index=True, return_inverse=True, return_counts=True)
            number = np.zeros(m, np.int64)
            number[places] = back
            if k in lengths and len(distinct):
                yield k, words.phrases(places[first], k), counts


def counts_of(docs: DataFrame, lengths: Sequence[int], bits: np.ndarray | None = None, parts: int = 0, size: int = BITS) -> DataFrame:
    """(lang, k, phrase, f): phrases of these lengths exploded to rows, those of one span counted once, then added by a hash aggregation.

    With length 1 there is also a row of length 0 for each language, the number of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def told(language: str) -> Iterator[pa.RecordBatch]:
            words = Words(language, held.pop(language))
            sizes.pop(language)
            found = list(counted(words, lengths, bits, parts, size))
            if 1 in lengths and len(words.ids):
                found.append((0, pa.array([""], pa.large_string()), np.array([len(words.ids)])))
            for _, phrases, counts in found:
                keys = pc.binary_join_element_wise(pa.scalar(language, pa.large_string()), phrases, pa.scalar("\t", pa.large_string()))
                yield pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(counts, pa.int64())], ["key", "f"])

        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    held.setdefault(language, []).append(text)
                    sizes[language] = sizes.get(language, 0) + len(text)
                    if sizes[language] >= SPAN:
                        yield from told(language)
                    elif sum(sizes.values()) >= 4 * SPAN:  # many languages: the largest goes
                        yield from told(max(sizes, key=sizes.get))
        for language in list(held):
            yield from told(language)

    rows = small_batches(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    # One text a row as the key, which shuffles less than three columns: words hold no tab.
    told = rows.mapInArrow(bounded(run), "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", "\t", -1)
    words = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1)
    return told.select(F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), words.cast("int").alias("k"), phrase.alias("phrase"), "f")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = BITS) -> DataFrame:
    """(lang, k, phrase, f) of all phrases of 1 to `longest` words with f >= least, written; and of k = 0 the number of words.

    A phrase is at most as frequent as its parts. So phrases of two words are exploded where both words may be frequent, longer
    ones where all their pairs may be; the sieves say so, and never keep a frequent phrase back. What is counted is exact.
    """
    often = (F.col("f") >= least) | (F.col("k") == 0)
    levels = [written(counts_of(docs, [1], size=size).where(often), "words")]
    if longest > 1:
        levels.append(written(counts_of(docs, [2], sieve(levels[0].where("k = 1"), size), 1, size).where(often), "pairs"))
    if longest > 2:
        levels.append(written(counts_of(docs, range(3, longest + 1), sieve(levels[1], size), 2, size).where(often), "phrases"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, size: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases, by score descending, a descending, phrase ascending.

    A-Z count as a-z; texts are cut at . , ; : ! ? and line ends, and the pieces into words at spaces and tabs. Candidates are phrases of 2
    to `longest` words that occur a >= least times, overlaps included. A cut after k words leaves parts that occur l and r times; its score is
    floor(1000 a n / (l r)), n being the language's words, in decimals; a candidate's is that of its lowest cut, ties to the smallest k. A candidate
    inside a longer one goes if the longer one occurs in `share` of 100 of its places and more; a longer one that is so frequent begins or ends with
    a phrase of one word more that is no less frequent, so those of one word more suffice. A null lang is `und`, a null text is empty; ids and
    other columns are not looked at, repeated rows count each; an empty table gives no rows.
    """
    if least < 1 or longest < 2 or not 0 < share <= 100:
        raise ValueError("least must be 1 or more, longest 2 or more, share within 1 to 100")
    found = frequent_phrases(docs, least, longest, size)
    phrases, words = found.where("k > 0"), found.where("k = 0").select("lang", F.col("f").alias("n"))
    candidates = phrases.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"))
    split = candidates.select("*", F.split("phrase", " ").alias("w"))
    cuts = split.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    part = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(words, "lang")
    whole = "decimal(18,0)"
    score = F.expr(f"(cast(a as {whole}) * cast(n as {whole}) * 1000BD) div (cast(l as {whole}) * cast(r as {whole}))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("at"))
    longer = split.where("k > 2").select("lang", F.col("a").alias("f"), F.explode(F.array(*(F.array_join(F.slice("w", i, F.col("k") - 1), " ") for i in (1, 2)))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = lowest.alias("c").join(longer.alias("x"), F.expr(f"c.lang = x.lang and c.phrase = x.phrase and x.f * 100 >= c.a * {share}"), "left_anti")
    rows = kept.select("lang", "phrase", "a", F.col("at.l").alias("l"), F.col("at.r").alias("r"), "n", F.col("at.score").alias("score"))
    # The first of each part of a language before the first of all of it: no task gets more of a language than parts times top.
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    parted = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
