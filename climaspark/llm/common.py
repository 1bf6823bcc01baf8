"""What the operators of this subpackage share: word and shingle hashing, the shared folder, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=U64)
_BASE = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, dtype=U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def segment_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run values[starts[i] : starts[i] + lengths[i]]; the runs lie end to end and are not empty."""
    if not len(starts):
        return np.empty(0, U64)
    position = np.arange(len(values)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat((values.astype(U64) + U64(1)) * powers(int(lengths.max()))[position], starts) ^ mix(lengths.astype(U64)))


def by_size(texts: Iterable[str | None], limit: int = 1 << 19) -> Iterator[list[str]]:
    """Texts in order, in lists of about `limit` characters, so that a list's working arrays stay small. A null is an empty text."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and the place of each text's first word (one more than there are texts).

    A word is a run of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    inside = _IS_WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = end - begin
    starts = np.cumsum(lengths) - lengths
    return segment_hashes(_LOWER[data[inside]], starts, lengths), np.searchsorted(begin, at)


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, repeats included, and each text's first; a shorter text's words are its one shingle."""
    n = np.diff(at)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    total = int(first[-1])
    if not total:
        return np.empty(0, U64), first
    place = np.arange(total) - np.repeat(first[:-1], counts) + np.repeat(at[:-1], counts)
    last = np.repeat(at[1:], counts) - 1
    weight = powers(k + 1)
    h = np.zeros(total, U64)
    for i in range(k):
        there = place + i <= last
        h += np.where(there, words[np.minimum(place + i, last)] * weight[i], U64(i + 1))
    return mix(h), first


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode, as in tests; on a cluster ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not at.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = at.get() if at.isDefined() else f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def quoted(df: DataFrame) -> list[Column]:
    """The columns of df by their whole names, dots included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def give_back() -> None:
    """Returns what this Python worker has freed to the system: workers live on, and their heaps would keep their largest size."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def bounded(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over batches, giving back memory at its end."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def small_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """df, whose session now sends at most so many rows at once to Python, unless it was set to something else than Spark's
    default of 10,000: whole texts make large batches, which two workers an executor hold several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, rows)
    return df


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_left: dict[str, SparkSession] = {}


def _remove(path: str) -> None:
    spark = _left.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_left):
        _remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: read again it has no lineage and a known size, and no lost executor takes it away.

    It goes with done(), or at the driver's end at the latest. Writing it runs a job at once.
    """
    path = new_folder(df.sparkSession, name)
    _left[path] = df.sparkSession
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def done(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read any more."""
    for t in tables:
        if getattr(t, "_written", None):
            _remove(t._written)


def least_hashed(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows of df, those with the least hashes of the keys (all, if there are fewer), ties by the keys.

    Rows that can't be among them are left out first, by the share of hashes that n of all rows are, so that a task sends
    its share of about n rows to the sort and not n of its own.
    """
    share = min(1.0, (n + 6 * n**0.5 + 100) / max(df.count(), 1))
    h = F.xxhash64(*keys)
    near = df.where(h <= int(-(2**63) + share * (2**64 - 1))) if share < 1 else df
    return near.orderBy(h, *keys).limit(n)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components as (node, root), root being the component's smallest node; nodes without an edge don't occur.

    Alternating large and small stars: each round moves every edge towards the smallest node of its neighbourhood, with
    aggregations that combine before the shuffle, and ends when only stars are left. Nothing but that answer comes
    to the driver. RuntimeError if so many rounds don't suffice.
    """
    def small_star(df: DataFrame) -> DataFrame:
        least = df.groupBy("u").agg(F.min("v").alias("m"))
        both = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))
        return df.join(least, "u").select(F.explode(both).alias("e")).select("e.u", "e.v").where("u != v").distinct()

    def large_star(df: DataFrame) -> DataFrame:
        both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def stars(df: DataFrame) -> bool:
        """Whether every node either begins one edge or only ends some: then a component's edges all end at its smallest node."""
        ends = df.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("begins")), F.struct(F.col("v").alias("node"), F.lit(0).alias("begins")))).alias("e"))
        nodes = ends.groupBy("e.node").agg(F.sum("e.begins").alias("begun"), F.min("e.begins").alias("least"))
        return nodes.where("begun > 1 or begun = 1 and least = 0").isEmpty()

    pairs = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    # Many links of one node to nodes that are linked themselves become one and theirs: the rounds begin with fewer.
    pairs, before = written(small_star(pairs), "edges"), pairs
    done(before)
    for _ in range(rounds):
        if stars(pairs):
            break
        pairs, before = written(small_star(large_star(pairs)), "edges"), pairs
        done(before)
    else:
        if not stars(pairs):
            raise RuntimeError("the components' rounds don't suffice")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
