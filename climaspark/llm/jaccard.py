"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded, by_size, components, done, give_back, mix, quoted, segment_hashes, shingle_hashes, small_batches, word_hashes, written

WORDS, LIKE = 5, 0.8
TREES, DEEPEST, RECALL = 10, 9, 0.999
#: Within a subtree a text joins its nearest leader if their estimated likeness is the first of these, and that leader is
#: linked to all others from the second on: of two texts of likeness 0.8 the one's leader is then linked to the other's
#: (Jaccard distance obeys the triangle: 0.35 and 0.2 make 0.55; the rest is for the estimate's error).
NEAR_LEADER, LINKED_LEADER = 0.65, 0.4
#: A block of a group holds about so many texts, or shingles, at most.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Shingles in at most so many sets of a unit of work, or missing in at most so many, are counted pair by pair.
FEW = 48


def depth(trees: int = TREES, deepest: int = DEEPEST, like: float = LIKE, recall: float = RECALL) -> int:
    """Prefixes are shortened from the deepest until two texts of the given likeness share one in some tree with the target probability."""
    k = deepest
    while k > 1 and 1 - (1 - like**k) ** trees < recall:
        k -= 1
    return k


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(1, TREES * DEEPEST + 1, dtype=U64)
    return mix(n) | U64(1), mix(n + U64(1 << 32))


def signatures(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """texts x (trees * deepest) least hashes, 32 bits each; texts without shingles get the largest number."""
    out = np.full((len(first) - 1, TREES * DEEPEST), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        for i, (a, b) in enumerate(zip(*_multipliers(), strict=True)):
            out[full, i] = np.minimum.reduceat(((shingles * a + b) >> U64(32)).astype(np.uint32), first[:-1][full])
    return out


def keys(words: np.ndarray, at: np.ndarray) -> list[bytes]:
    """16 bytes for each text that tell its sequence of words."""
    n = np.diff(at)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), 2), U64)
    for i, seed in enumerate((U64(0), U64(0x5DEECE66D))):
        out[full, i] = segment_hashes(mix(words ^ seed), at[:-1][full], n[full])
    return [r.tobytes() for r in out.astype(">u8")]


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, key, sketch, shingles): key is the same for the same words; sketch holds the minhashes, shingles is their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, done = pdf["doc_id"], 0
            for texts in by_size(pdf["text"]):
                words, at = word_hashes(texts)
                shingles, first = shingle_hashes(words, at, WORDS)
                sig = signatures(shingles, first)
                yield pd.DataFrame({"doc_id": ids.iloc[done : done + len(texts)].array, "key": keys(words, at), "sketch": [s.tobytes() for s in sig.astype(">u4")], "shingles": np.diff(first)}).astype({"doc_id": "Int64"})
                done += len(texts)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(bounded(run), "doc_id long, key binary, sketch binary, shingles long")


def key_of(text: str | Column) -> Column:
    """keys() of a column of texts."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([k for group in by_size(texts) for k in keys(*word_hashes(group))], dtype=object)
        give_back()
        return out

    return run(text)


def candidate_edges(nodes: DataFrame, recall: float = RECALL) -> DataFrame:
    """(a, b) keys: links that connect at least the texts of likeness 0.8, from the forest's subtrees.

    Each tree's paths are sorted, which is its trie; texts under one node at the adaptive depth come one after another, those
    with longer common prefixes next to each other. The stream through a node holds its leaders only, one-byte minhashes,
    and gives out a link only where it connects something new: one a text at most.
    """
    d = depth(recall=recall)
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = 4 * DEEPEST
    paths = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.cast("byte").alias("tree"), F.substring(F.col("sketch"), t * step + 1, F.lit(step)).alias("path"))))
    short = F.pandas_udf(lambda s: pd.Series([b[3::4] for b in s], dtype=object), "binary")
    rows = nodes.select("key", short("sketch").alias("brief"), "sketch").select("key", "brief", paths.alias("at")).select("key", "brief", "at.tree", F.substring("at.path", 1, 4 * d).alias("node"), F.substring("at.path", 4 * d + 1, step).alias("rest"))
    rows = rows.repartition(width, "tree", "node").sortWithinPartitions("tree", "node", "rest", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, leaders, names = None, 0, np.empty((16, TREES * DEEPEST), np.uint8), []
        parent: list[int] = []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for pdf in batches:
            a, b = [], []
            for tree, node, key, brief in zip(pdf["tree"], pdf["node"], pdf["key"], pdf["brief"], strict=True):
                if at != (tree, node):
                    at, n, names, parent = (tree, node), 0, [], []
                sig = np.frombuffer(brief, np.uint8)
                like = (leaders[:n] == sig).mean(axis=1)
                nearest = int(like.argmax()) if n else -1
                if n and like[nearest] >= NEAR_LEADER:
                    a.append(names[nearest])
                    b.append(key)
                else:
                    if n == len(leaders):
                        leaders = np.concatenate([leaders, np.empty_like(leaders)])
                    nearest, leaders[n] = n, sig
                    names.append(key)
                    parent.append(n)
                    n += 1
                for i in np.flatnonzero(like >= LINKED_LEADER).tolist():
                    if (x := root(i)) != (y := root(nearest)):
                        parent[x] = y
                        a.append(names[i])
                        b.append(names[nearest])
            yield pd.DataFrame({"a": a, "b": b})

    return rows.mapInPandas(bounded(run), "a binary, b binary")


def _pairs(out: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> None:
    """Adds 1 to out for every pair of sets that share a shingle; rows lists each shingle's sets, one shingle after another."""
    first = np.cumsum(counts) - counts
    for c in np.unique(counts):
        if c:
            begin = first[counts == c]
            for part in np.array_split(begin, len(begin) * c * c // 500_000 + 1):
                r = rows[part[:, None] + np.arange(c)]
                np.add.at(out, (r[:, :, None], r[:, None, :]), np.float32(1))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with each other.

    Near copies share most shingles and each has a few of its own. So a shingle that few sets have is counted pair by pair;
    one that few sets lack is taken as there, less the sets that lack it; only the others need products of 0/1 matrices.
    """
    n = len(sets)
    values, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(where, kind="stable")
    row, of = np.repeat(np.arange(n), [len(s) for s in sets])[order], count[where[order]]
    out = np.zeros((n, n), np.float32)
    most = (count >= n - FEW) & (count > FEW)
    rare, common = of <= FEW, (of >= n - FEW) & (of > FEW)
    _pairs(out, row[rare], count[count <= FEW])
    middle = ~rare & ~common
    for kind, wanted in ((common, most), (middle, ~most & (count > FEW))):
        r, c = row[kind], np.repeat(np.arange(int(wanted.sum())), count[wanted])
        step = max(64, 2_000_000 // n)
        for begin in range(0, int(wanted.sum()), step):
            lo, hi = np.searchsorted(c, (begin, begin + step))
            m = np.zeros((min(step, int(wanted.sum()) - begin), n), np.float32)
            m[c[lo:hi] - begin, r[lo:hi]] = 1
            if kind is middle:
                out += m.T @ m
            else:
                missing = m == 0
                lack = missing.sum(0).astype(np.float32)
                out += len(m) - lack[:, None] - lack[None]
                _pairs(out, np.nonzero(missing)[1], missing.sum(1))
    return out


LINKS = "key binary, links long, other binary"


def links_in(x: list[tuple[bytes, int, np.ndarray]], y: list[tuple[bytes, int, np.ndarray]] | None) -> pd.DataFrame:
    """For each text of a block (and of a second one): its links to texts of the other, copies counted, and a linked text that spans its part."""
    sx, sy = np.array([len(s) for *_, s in x]), np.array([len(s) for *_, s in (x if y is None else y)])
    both = intersections([s for *_, s in x + (y or [])])
    both = both if y is None else both[: len(x), len(x) :]
    linked = both >= LIKE * (sx[:, None] + sy[None] - both) - 1e-6
    if y is None:
        np.fill_diagonal(linked, False)
    cx, cy = np.array([c for _, c, _ in x]), np.array([c for _, c, _ in (x if y is None else y)])
    members = x if y is None else x + y
    n = np.concatenate([linked @ cy] if y is None else [linked @ cy, linked.T @ cx])
    # A breadth-first forest: one edge for each text but the roots.
    near = linked if y is None else np.block([[np.zeros((len(x),) * 2, bool), linked], [linked.T, np.zeros((len(y),) * 2, bool)]])
    parent, left = np.full(len(members), -1), np.ones(len(members), bool)
    for root in range(len(members)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            here = front.pop()
            new = np.flatnonzero(near[here] & left)
            parent[new], left[new] = here, False
            front.extend(new.tolist())
    keep = n > 0
    other = [members[p][0] if p >= 0 else None for p in parent]
    return pd.DataFrame({"key": [m[0] for m, k in zip(members, keep, strict=True) if k], "links": n[keep].astype(np.int64), "other": [o for o, k in zip(other, keep, strict=True) if k]})


def verified(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, links, other) from exact Jaccard likeness of shingle sets within groups (key, root, rep, copies, blocks).

    A large group is dealt into blocks by hash, and each pair of blocks is a unit of work. The texts are joined by shuffle at
    any size, as the groups grow with them.
    """
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(groups.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("key", "root", "copies", "blocks", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = 0
            for texts in by_size(pdf["text"]):
                part = pdf.iloc[done : done + len(texts)]
                done += len(texts)
                words, at = word_hashes(texts)
                shingles, first = shingle_hashes(words, at, WORDS)
                same = [k == w for k, w in zip(keys(words, at), part["key"], strict=True)]
                yield part[["key", "root", "copies", "blocks"]].assign(shingles=[np.unique(shingles[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)])[same]

    rows = rows.mapInPandas(bounded(sets), "key binary, root binary, copies long, blocks int, shingles binary")
    blocks = F.col("blocks")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("root", F.least("mine", "i").alias("p"), F.greatest("mine", "i").alias("q"), "mine", "key", "copies", "shingles")
    rows = rows.repartition(width, "root", "p", "q").sortWithinPartitions("root", "p", "q", "mine", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, ({}, {})

        def done() -> pd.DataFrame:
            (root, p, q), (x, y) = at, ([(k, *v) for k, v in h.items()] for h in held)
            return links_in(x, None) if p == q else links_in(x, y) if x and y else pd.DataFrame({"key": [], "links": [], "other": []})

        for pdf in batches:
            for root, p, q, mine, key, copies, shingles in zip(*(pdf[c] for c in ("root", "p", "q", "mine", "key", "copies", "shingles")), strict=True):
                if at != (root, p, q):
                    if at is not None:
                        yield done()
                    at, held = (root, p, q), ({}, {})
                held[mine != p][key] = (copies, np.frombuffer(shingles, U64))
        if at is not None:
            yield done()

    return rows.mapInPandas(bounded(run), LINKS)


def classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, key, class_id, class_key, n_links, copies) for each row of (doc_id, text).

    Linked are rows whose sets of five-word shingles have a Jaccard likeness of 0.8 and more; rows of the same words always
    are, also when they have fewer than five (their one shingle) or none. class_id is the least doc_id of the connected rows,
    n_links the number of other rows linked to the row. Nulls: a null text is empty; null ids come first.
    """
    sketches = written(sketched(docs), "sketches")
    rows = written(sketches.select("doc_id", "key"), "keys")
    rep = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")
    nodes = written(sketches.groupBy("key").agg(rep, F.count("*").alias("copies"), F.min("sketch").alias("sketch"), F.max("shingles").alias("shingles")).select("key", F.col("first.doc_id").alias("rep"), "copies", "sketch", "shingles"), "nodes")
    done(sketches)
    worded = nodes.where(F.col("key") != F.lit(bytes(16)))
    groups = components(candidate_edges(worded, recall))
    members = groups.join(nodes.select("key", "rep", "copies", "shingles"), F.col("node") == F.col("key"))
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    groups = written(members.join(sizes, "root").select("key", "root", "rep", "copies", "blocks"), "groups")
    links = written(verified(docs, groups), "links")
    done(groups)
    of = components(links.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    counted = links.groupBy("key").agg(F.sum("links").alias("links"))
    told = nodes.select("key", "rep", "copies").join(counted, "key", "left").join(of.select(F.col("node").alias("key"), "root"), "key", "left")
    told = written(told.select("key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("root")), "told")
    done(nodes, links)
    first = told.groupBy("root").agg(F.min(F.struct(F.col("rep").isNotNull().alias("known"), "rep", "key")).alias("first"))
    named = told.join(first, "root").select("key", F.col("first.rep").alias("class_id"), F.col("first.key").alias("class_key"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "copies")
    return rows.select("doc_id", "key").join(named, "key").select("doc_id", "key", "class_id", "class_key", "n_links", "copies")


def one_of_each(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The rows of docs, all columns of any names, that stand for their class: of the least doc_id, one row only."""
    kept = classes(docs, recall).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))).select(F.col("doc_id").alias("first"), F.col("key").alias("words")).distinct()
    rows = small_batches(docs).select(F.struct(*quoted(docs)).alias("doc"), key_of(F.col("text")).alias("key"))
    found = rows.join(written(kept, "kept"), (F.col("key") == F.col("words")) & F.col("doc.doc_id").eqNullSafe(F.col("first")), "left_semi")
    return found.dropDuplicates(["key"]).select("doc.*")
