"""Embedding near-duplicates: coarse inverted lists, product-quantised residuals, probes and filters that lose no pair, exact cosines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import Index, closest, k_means, unit
from .common import components, done, least_hashed, written

LIKE = 0.93
#: The index is fitted on at most so many vectors, those whose keys have the least hashes; every vector is indexed.
FIT_ROWS, PARTS, CODES = 20_000, 16, 256
#: A vector's copy in one more cell costs about as much as so many codes of that cell. Cells are as many, of these, as cost least on the sample that
#: they are fitted on, and a twentieth of it at most; a probe looks at so many nearest centroids for its bound. Neither changes what is found.
COPY, CELLS, WITNESSES = 1000, (4, 16, 64, 256, 1024), 8
#: Vectors of a list, and queries, that one group holds at most, about; a larger list is split.
BLOCK, QUERIES = 4096, 2048
#: What rounding may add to a distance.
SLACK = 1e-5

LINKS = "node binary, links long, other binary"


def kind_of(embeddings: DataFrame) -> str:
    """The numbers that hold the components as they are: floats if the column has floats, else doubles."""
    return "<f4" if embeddings.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def units(blobs: Sequence[bytes], kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(float))


def keyed(embeddings: DataFrame, vectors: bool) -> DataFrame:
    """(vec_id, label, key), and with vectors v, its components' bytes: key tells label and vector, and is null where the row takes no part."""
    kind = kind_of(embeddings)
    v = F.col("embedding").cast("array<double>")
    good = F.col("label").isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    good = F.coalesce(good, F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.col("label").cast("string")).alias("label"), F.when(good, v).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, v = batch.columns
            at = v.offsets.to_numpy().astype(np.int64)
            flat = v.values.to_numpy(zero_copy_only=False) + 0.0  # no negative zero
            flat = flat.astype(kind)
            raw = [flat[a:b].tobytes() if ok else None for a, b, ok in zip(at[:-1], at[1:], v.is_valid().to_pylist(), strict=True)]
            keys = [None if x is None else hashlib.blake2b(x, digest_size=16, key=hashlib.sha256(t.encode()).digest()).digest() for x, t in zip(raw, labels.to_pylist(), strict=True)]
            columns = [ids, labels, pa.array(keys, pa.binary())] + ([pa.array(raw, pa.binary())] if vectors else [])
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "key", "v"][: len(columns)])

    return rows.mapInArrow(run, "vec_id long, label string, key binary" + (", v binary" if vectors else ""))


def node_of(vec_id: Column, key: Column) -> Column:
    """Bytes that sort as vec_id does, null last, and then by key."""
    return F.concat(F.when(vec_id.isNull(), F.lit(b"\x01")).otherwise(F.lit(b"\x00")), F.unhex(F.lpad(F.hex(F.coalesce(vec_id, F.lit(0)).bitwiseXOR(F.lit(-(2**63)))), 16, "0")), key)


def id_of(node: Column) -> Column:
    """The vec_id of node_of()."""
    return F.when(F.substring(node, 1, 1) == F.lit(b"\x00"), F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63))))


def fit(nodes: DataFrame, kind: str, like: float = LIKE, cells: int | None = None) -> Index:
    """Centroids and code books from at most FIT_ROWS of the vectors, those whose keys have the least hashes."""
    x = units([r["v"] for r in least_hashed(nodes.select("key", "v"), FIT_ROWS, "key").collect()], kind)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))
    if cells is None:
        # Of the labels' sizes only two sums come to the driver.
        sizes = nodes.groupBy("label").agg(F.count("*").cast("double").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        cells = cheapest(x, sizes[1] / sizes[0], like)
    centroids = k_means(x, cells)
    r = (x - centroids[closest(x, centroids)]).reshape(len(x), PARTS, -1)
    return Index(centroids, np.stack([k_means(np.ascontiguousarray(r[:, p]), CODES) for p in range(PARTS)]))


def cheapest(x: np.ndarray, n: float, like: float) -> int:
    """How many cells cost a vector least, of n that share a label with it: its copies, and the codes in the cells that it must look in."""
    best, least = max(1, min(CELLS[0], len(x) // 20)), np.inf
    for cells in CELLS:
        if cells > max(1, len(x) // 20):
            break
        index = Index(k_means(x, cells), np.zeros((PARTS, 1, x.shape[1] // PARTS)))
        asked = x[:: max(1, len(x) // 1000)]
        own, wanted = probed(index, asked, like)
        share = np.bincount(closest(x, index.centroids), minlength=len(index.centroids)) / len(x)
        cost = wanted.sum(1).mean() * COPY + n * (wanted * share).sum(1).mean()
        if cost < least:
            best, least = cells, cost
    return best


def radius(like: float) -> float:
    """How far apart two unit vectors of that cosine are."""
    return (2 - 2 * like) ** 0.5


def probed(index: Index, x: np.ndarray, like: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's own cell, and whether it must look in a cell: all cells where a vector of that cosine may be.

    What lies in cell c is at most as far from c as from any other centroid o, so its distance from x is at least
    (|x - c|^2 - |x - o|^2) / (2 |c - o|); the nearest centroids serve as o. A pair of two cells is looked for from the lower one.
    """
    centroids = index.centroids
    d = (centroids**2).sum(1) - 2 * x @ centroids.T
    near = np.argsort(d, axis=1, kind="stable")[:, :WITNESSES]
    apart = np.sqrt(np.maximum((centroids**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * centroids @ centroids.T, 0))
    bound = np.zeros_like(d)
    for o in near.T:
        gap, far = d - d[np.arange(len(x)), o][:, None], 2 * apart[o]
        bound = np.maximum(bound, np.divide(gap, far, out=np.zeros_like(gap), where=far > 1e-9))
    own = near[:, 0]
    wanted = bound <= radius(like) + SLACK
    wanted &= np.arange(len(centroids)) > own[:, None]
    wanted[np.arange(len(x)), own] = True
    return own, wanted


def forest(linked: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(place, other's place, whether place is a row) of edges that connect what the matrix connects, one for each row or column but the first."""
    rows, columns = linked.any(1), linked.any(0)
    for start in np.flatnonzero(rows):
        if not rows[start]:
            continue
        rows[start] = False
        front = [(int(start), True)]
        while front:
            here, is_row = front.pop()
            left = columns if is_row else rows
            new = np.flatnonzero((linked[here] if is_row else linked[:, here]) & left)
            left[new] = False
            for i in new.tolist():
                yield i, here, not is_row
                front.append((i, not is_row))


def links_of(index: Index, cell: int, like: float, lists: pd.DataFrame, asked: pd.DataFrame, kind: str = "<f8") -> pd.DataFrame:
    """Links between a list's vectors (node, copies, code, err, v) and queries (node, copies, own, v): counts, copies included, and edges.

    A code passes where its table distance from the query is at most the radius and the code's own error, which loses no pair;
    what passes is measured on the vectors.
    """
    out: dict[str, list] = {"node": [], "links": [], "other": []}
    if len(lists) and len(asked):
        v, q = (units(list(part["v"]), kind) for part in (lists, asked))
        code = np.frombuffer(b"".join(lists["code"]), np.uint8).reshape(len(lists), -1)
        most = (radius(like) + lists["err"].to_numpy() + SLACK) ** 2 + SLACK
        names, asking = lists["node"].to_numpy(), asked["node"].to_numpy()
        copies, times, own = lists["copies"].to_numpy(), asked["copies"].to_numpy(), asked["own"].to_numpy()
        total = np.zeros(len(lists), np.int64)
        for part in np.array_split(np.arange(len(q)), len(q) * len(v) // 2_000_000 + 1):
            keep = index.distances(index.padded(q[part]), cell, code) <= most
            keep &= ~own[part, None] | (asking[part, None] < names[None])  # within a cell, a pair once
            some, there = np.flatnonzero(keep.any(1)), np.flatnonzero(keep.any(0))
            if not len(some):
                continue
            linked = keep[np.ix_(some, there)] & (q[part[some]] @ v[there].T >= like)
            mine, total[there] = linked @ copies[there], total[there] + linked.T @ times[part[some]]
            out["node"] += asking[part[some]][mine > 0].tolist()
            out["links"] += mine[mine > 0].tolist()
            out["other"] += [None] * int((mine > 0).sum())
            for i, j, is_row in forest(linked):
                out["node"].append(asking[part[some[i]]] if is_row else names[there[i]])
                out["links"].append(0)
                out["other"].append(names[there[j]] if is_row else asking[part[some[j]]])
        out["node"] += names[total > 0].tolist()
        out["links"] += total[total > 0].tolist()
        out["other"] += [None] * int((total > 0).sum())
    return pd.DataFrame(out).astype({"links": "int64"})


def links(nodes: DataFrame, kind: str, like: float = LIKE, cells: int | None = None) -> DataFrame:
    """(node, links, other) of vectors (label, node, key, copies, v) of one length: parts of the counts, and edges."""
    index = fit(nodes, kind, like, cells)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = index.padded(units(list(pdf["v"]), kind))
                own, wanted = probed(index, x, like)
                code = index.encode(x, own)
                r = (x - index.centroids[own]).reshape(len(x), PARTS, -1)
                err = np.sqrt(sum(((r[:, p] - index.books[p][code[:, p]]) ** 2).sum(1) for p in range(PARTS)))
                yield pdf.assign(cell=own.astype(np.int32), cells=[np.flatnonzero(w).astype(np.int32) for w in wanted], code=[c.tobytes() for c in code], err=err)

    rows = written(nodes.select("label", "node", "copies", "v").mapInPandas(coded, "label string, node binary, copies long, v binary, cell int, cells array<int>, code binary, err double"), "codes")
    asked = rows.select("label", "node", "copies", "v", F.explode("cells").alias("at"), F.col("cell").alias("own")).select("label", F.col("at").alias("cell"), "node", "copies", "v", (F.col("at") == F.col("own")).alias("own"))
    # How many pieces a list's vectors and its queries go to.
    sizes = rows.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces"))
    sizes = sizes.join(rows.select("label", F.explode("cells").alias("cell")).groupBy("label", "cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), ["label", "cell"])
    pieces, parts = F.col("pieces"), F.col("parts")
    left = rows.select("label", "cell", "node", "copies", "v", "code", "err").join(sizes, ["label", "cell"])
    left = left.select("label", "cell", F.pmod(F.xxhash64("node"), pieces).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "node", "copies", "v", "code", "err")
    right = asked.join(sizes, ["label", "cell"])
    right = right.select("label", "cell", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", "copies", "v", "own")
    right = right.toDF(*right.columns)  # columns of their own, as both sides come from one table
    group = ("label", "cell", "piece", "part")

    def run(key: tuple, lists: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return links_of(index, int(key[1]), like, lists, queries, kind)

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(run, LINKS)


def near_duplicates(embeddings: DataFrame, like: float = LIKE, cells: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding, label).

    Two rows are linked if their labels are equal and not null and their vectors' cosine, in double precision, is at least `like`;
    all such pairs are found. n_links counts the other rows linked to the row, component_id is the least vec_id that links reach, the
    row's own included, kept whether that is its own. Vectors that are null, zero or hold null or non-finite components, and
    those of rows without a label, link with nothing; vectors of different lengths neither. Equal vectors of a label are one node,
    also of repeated rows and ids. A null vec_id is above all others. Other columns are not looked at; no rows give none.
    """
    if not 0 < like <= 1:
        raise ValueError("like must be above 0 and at most 1")
    each = keyed(embeddings, True).where("key is not null").groupBy("label", "key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("v").alias("v"))
    nodes = written(each.select("label", "key", node_of(F.col("first"), F.col("key")).alias("node"), "copies", F.length("v").alias("width"), "v"), "vectors")
    found = [written(links(nodes.where(F.col("width") == r["width"]), kind_of(embeddings), like, cells), "links") for r in nodes.select("width").distinct().orderBy("width").collect()]
    told = nodes.select("key", "node", (F.col("copies") - 1).alias("links"))
    if found:
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        of = components(every.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
        counted = every.groupBy("node").agg(F.sum("links").alias("more"))
        told = told.join(counted, "node", "left").join(of, "node", "left").select("key", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"), id_of(F.coalesce("root", "node")).alias("component"))
        told = written(told, "told")
        done(nodes, *found)
    else:
        told = told.select("key", "links", F.lit(None).cast("long").alias("component"))
    rows = keyed(embeddings, False).select("vec_id", "key").join(told, "key", "left")
    rows = rows.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
