"""Approximate nearest neighbours: coarse cells, product-quantised residuals, asymmetric distances, and exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import least_hashed, written

#: The index is fitted on at most so many vectors, those whose ids have the least hashes; every vector is indexed.
FIT_ROWS = 20_000
PARTS, CODES, RERANK = 32, 256, 100
#: Cells are about half the root of the rows, within these bounds; probes are as few as give the target recall on the sample's own neighbours.
FEWEST, MOST, RECALL, TRIED = 16, 1024, 0.97, 256
#: Rows of the index and queries that one group holds at most, about; a cell with more is split.
BLOCK, QUERIES = 8192, 1024


@dataclass
class Index:
    centroids: np.ndarray  # cells x dimension
    books: np.ndarray  # parts x codes x part dimension
    probes: int = 1

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.centroids.shape[1] - x.shape[1])))

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        r = (x - self.centroids[cell]).reshape(len(x), len(self.books), -1)
        return np.stack([closest(r[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of each query to each code of one cell, from each query's table of distances to the code words."""
        r = (q - self.centroids[cell]).reshape(len(q), len(self.books), -1)
        out = np.zeros((len(q), len(codes)), np.float32)
        for p, book in enumerate(self.books):
            table = (r[:, p] ** 2).sum(1)[:, None] + (book**2).sum(1) - 2 * r[:, p] @ book.T
            out += table.astype(np.float32)[:, codes[:, p]]
        return out


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([((centres**2).sum(1) - 2 * b @ centres.T).argmin(1) for b in np.array_split(x, max(1, len(x) // 4096))])


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        of = closest(x, centres)
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def scaled(vectors: list) -> np.ndarray:
    """Vectors divided by powers of two, exactly, so that their squares neither overflow nor vanish."""
    x = np.asarray([np.asarray(v, np.float64) for v in vectors])
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def unit(vectors: list) -> np.ndarray:
    x = scaled(vectors)
    return x / np.sqrt((x * x).sum(1))[:, None]


def usable(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, v): every row whose vector has no null or non-finite component and is not zero, ids not null; row tells rows of one id apart."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = embeddings.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def fit(rows: DataFrame, cells: int | None = None) -> Index | None:
    """The index of rows (vec_id, v) of one length, fitted on at most FIT_ROWS of them, those whose ids have the least hashes."""
    n = rows.count()
    sample = [r["v"] for r in least_hashed(rows, FIT_ROWS, "vec_id").select("v").collect()]
    if not sample:
        return None
    cells = cells or min(max(round(n**0.5 / 2), FEWEST), MOST)
    x = unit(sample)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))
    centroids = k_means(x, max(1, min(cells, len(x) // 20)))
    of = closest(x, centroids)
    r = (x - centroids[of]).reshape(len(x), PARTS, -1)
    books = [k_means(np.ascontiguousarray(r[:, p]), CODES) for p in range(PARTS)]
    index = Index(centroids, np.stack(books))
    index.probes = chosen_probes(index, x, of)
    return index


def chosen_probes(index: Index, x: np.ndarray, of: np.ndarray, k: int = 5, recall: float = RECALL) -> int:
    """In how many of the nearest cells the target share of true neighbours lies, for some of the sample's rows among all of its rows.

    Neighbours in the whole table are nearer than those in a sample, so that this errs towards more probes.
    """
    asked = np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(int)
    like = x[asked] @ x.T
    like[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-like, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if not near.size:
        return 1
    place = np.argsort(index.nearest(x[asked], len(index.centroids)), axis=1)
    ranks = np.sort(np.take_along_axis(place, of[near], axis=1).ravel())
    return int(ranks[min(int(np.ceil(recall * len(ranks))) - 1, len(ranks) - 1)]) + 1


def enough(sizes: np.ndarray, probes: int, k: int) -> np.ndarray:
    """How many cells each query goes to, of which sizes has those of its nearest first: `probes`, or as many more as hold the query itself and k others."""
    return np.maximum(probes, np.minimum((np.cumsum(sizes, axis=1) <= k).sum(1) + 1, sizes.shape[1]))


NEAREST = "query_id long, rank int, vec_id long, score double"


def search(embeddings: DataFrame, k: int = 5, every: int = 50, index: Index | None = None, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of each row whose id is divisible by `every`, of all other rows.

    Every usable vector is indexed by its cell and codes. A query goes to its nearest cells, and to more if these
    hold fewer than k others; a group holds one piece of a
    cell and one piece of its queries, so a hot cell is many groups. Each group returns each query's best by asymmetric
    distance, ties to smaller ids; the best of all are measured on the original vectors in double precision. Rows of one id are
    rows each. Vectors of each length are an index of their own, as no cosine is told between lengths; a given index is for
    one length. No usable rows: no rows.
    """
    rows = written(usable(embeddings), "vectors")
    lengths = [r["n"] for r in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]
    found = [_search(rows.where(F.size("v") == n), k, every, index, probes, rerank) for n in lengths]
    out = embeddings.sparkSession.createDataFrame([], NEAREST)
    for f in found:
        out = f if len(found) == 1 else out.unionByName(f)
    return out


def _search(rows: DataFrame, k: int, every: int, index: Index | None, probes: int | None, rerank: int) -> DataFrame:
    index = index or fit(rows)
    n_cells = len(index.centroids)
    probes = min(probes or index.probes, n_cells)

    def coded(batches):
        for pdf in batches:
            if len(pdf):
                x = index.padded(unit(pdf["v"].tolist()))
                cell = index.nearest(x, 1)[:, 0]
                yield pd.DataFrame({"row": pdf["row"], "vec_id": pdf["vec_id"], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in index.encode(x, cell)]})

    codes = written(rows.mapInPandas(coded, "row long, vec_id long, cell int, code binary"), "index")
    # A number for each cell, how many rows it has; then two: into how many pieces its rows and its queries go.
    sizes = np.zeros(n_cells, np.int64)
    for r in codes.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]

    def probed(batches):
        for pdf in batches:
            if len(pdf):
                x = index.padded(unit(pdf["v"].tolist()))
                near = index.nearest(x, n_cells).astype(np.int32)
                yield pd.DataFrame({"asked": pdf["row"], "cells": [c[:n] for c, n in zip(near, enough(sizes[near], probes, k), strict=True)], "q": [v.tobytes() for v in x.astype(np.float32)]})

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).mapInPandas(probed, "asked long, cells array<int>, q binary")
    queries = written(queries.select("asked", "q", F.explode("cells").alias("cell")), "probes")
    split = {c: [max(1, -(-int(n) // BLOCK)), 1] for c, n in enumerate(sizes)}
    for r in queries.groupBy("cell").count().collect():
        split[r["cell"]][1] = -(-r["count"] // QUERIES)
    pieces = [F.array(*(F.lit(split[c][i]) for c in range(n_cells)))[F.col("cell")] for i in (0, 1)]
    left = codes.select("cell", F.pmod(F.xxhash64("row"), pieces[0]).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), pieces[1] - 1)).alias("part"), "row", "vec_id", "code")
    right = queries.select("cell", F.explode(F.sequence(F.lit(0), pieces[0] - 1)).alias("piece"), F.pmod(F.xxhash64("asked"), pieces[1]).cast("int").alias("part"), "asked", "q")

    def best(xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(xs) or not len(qs):
            return pd.DataFrame({"asked": pd.Series(dtype="int64"), "row": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "near": pd.Series(dtype="float32")})
        xs = xs.sort_values(["vec_id", "row"])
        ids, row_ids, code = xs["vec_id"].to_numpy(), xs["row"].to_numpy(), np.frombuffer(b"".join(xs["code"]), np.uint8).reshape(len(xs), -1)
        q = np.frombuffer(b"".join(qs["q"]), np.float32).reshape(len(qs), -1).astype(float)
        asked, out = qs["asked"].to_numpy(), []
        for part in np.array_split(np.arange(len(q)), max(1, len(q) * len(ids) // 4_000_000 + 1)):
            d = index.distances(q[part], int(xs["cell"].iloc[0]), code)
            for i, row in zip(part, d, strict=True):
                order = np.argsort(row, kind="stable")[: rerank + 1]
                order = order[row_ids[order] != asked[i]][:rerank]
                out.append((np.full(len(order), asked[i]), row_ids[order], ids[order], row[order]))
        return pd.DataFrame(dict(zip(("asked", "row", "vec_id", "near"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = left.groupBy("cell", "piece", "part").cogroup(right.groupBy("cell", "piece", "part")).applyInPandas(best, "asked long, row long, vec_id long, near float")
    first = Window.partitionBy("asked").orderBy("near", "vec_id", "row")
    found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rerank).select("asked", "row")

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series(dtype="float64")
        x, y = scaled(list(a)), scaled(list(b))
        return pd.Series((x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))))

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("row").alias("asked"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    exact = found.join(rows, "row").join(asked, "asked").select("asked", "query_id", "row", "vec_id", cosine("q", "v").alias("score"))
    nearest = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row")
    return exact.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
