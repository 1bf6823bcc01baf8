"""Rasters as tiles: a row holds a square of cells as arrays, and one more row and column, so that a point finds its four neighbours in one tile."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 128


def tiled(raster: DataFrame, values: tuple[str, ...] = ("elevation",), by: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """(by, tr, tc, wide, and an array for each of values) of cells (by, row, col, values): tile rows from row tr * tile to (tr + 1) * tile.

    The last row and column are the next tiles' first. Arrays are row-major, `wide` columns wide, doubles (a boolean as 1 and 0), not a
    number where a cell is absent or null. One exchange of the cells; a task holds one tile at a time. Of repeated cells one counts.
    """
    def into(at: str) -> Column:
        t = F.floor(F.col(at) / tile).cast("int")
        return F.explode(F.sequence(t - (F.pmod(F.col(at), F.lit(tile)) == 0).cast("int"), t))

    cells = raster.select(*by, "row", "col", *(F.col(v).cast("double").alias(v) for v in values))
    cells = cells.withColumn("tr", into("row")).withColumn("tc", into("col"))
    cells = cells.withColumn("row", (F.col("row") - F.col("tr") * tile).cast("int")).withColumn("col", (F.col("col") - F.col("tc") * tile).cast("int"))
    keys = [*by, "tr", "tc"]

    def run(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        i, j = some["row"].to_numpy(), some["col"].to_numpy()
        high, wide = int(i.max()) + 1, int(j.max()) + 1
        out = {}
        for v in values:
            a = np.full((high, wide), np.nan)
            a[i, j] = some[v].to_numpy(float, na_value=np.nan)
            out[v] = [a.ravel()]
        return pd.DataFrame({**{k: [x] for k, x in zip(keys, key, strict=True)}, "wide": [wide], **out})

    schema = ", ".join([*(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys), "wide int", *(f"`{v}` array<double>" for v in values)])
    return cells.groupBy(*keys).applyInPandas(run, schema)


def _at(array: str, i: Column, j: Column) -> Column:
    """A tile's value at its row i and column j, null where there is none."""
    v = F.when((i >= 0) & (j >= 0) & (j < F.col("wide")), F.get(F.col(array), i * F.col("wide") + j))
    return F.when(~F.isnan(v), v)


def sampled(points: DataFrame, tiles: DataFrame, height: int, width: int, value: str = "elevation", clamp: bool = True, by: tuple[str, ...] = (), mask: str | None = None, tile: int = TILE) -> DataFrame:
    """points (r, c as fractional places, and anything else) with the value between the four nearest centres.

    Places are clamped to the centres' range (`clamp`), or else null beyond the grid; missing neighbours are left out and the
    weights of the others rescaled. With `mask` there is also the mask of the cell that a point falls in, clamped to the grid, false
    where it is missing. The points are dealt out once, by tile and `by`, and meet one tile each; rows come back as they are, repeated ones too.
    """
    r, c = F.col("r") - 0.5, F.col("c") - 0.5
    inside = (F.col("r") >= 0) & (F.col("r") <= height) & (F.col("c") >= 0) & (F.col("c") <= width)
    if clamp:
        r, c = F.greatest(F.lit(0.0), F.least(r, F.lit(height - 1.001))), F.greatest(F.lit(0.0), F.least(c, F.lit(width - 1.001)))
    rows = points.withColumns({"_r": r, "_c": c}).withColumns({"_i": F.floor("_r").cast("int"), "_j": F.floor("_c").cast("int")})
    known = F.col("_i").isNotNull() & F.col("_j").isNotNull() & (F.lit(True) if clamp else inside)
    rows = rows.withColumns({"tr": F.when(known, F.floor(F.col("_i") / tile).cast("int")), "tc": F.when(known, F.floor(F.col("_j") / tile).cast("int"))})
    met = rows.join(tiles, [*by, "tr", "tc"], "left")
    i, j = F.col("_i") - F.col("tr") * tile, F.col("_j") - F.col("tc") * tile
    fr, fc = F.col("_r") - F.col("_i"), F.col("_c") - F.col("_j")
    met = met.withColumns({f"_v{di}{dj}": _at(value, i + di, j + dj) for di in (0, 1) for dj in (0, 1)})
    over, of = F.lit(0.0), F.lit(0.0)
    for di in (0, 1):
        for dj in (0, 1):
            v, w = F.col(f"_v{di}{dj}"), (fr if di else 1 - fr) * (fc if dj else 1 - fc)
            over, of = over + F.coalesce(w * v, F.lit(0.0)), of + F.when(v.isNotNull(), w).otherwise(0.0)
    out = {value: F.try_divide(over, of)}
    if mask is not None:
        def cell(at: str, most: int) -> Column:
            return F.greatest(F.lit(0), F.least(F.lit(most - 1), F.col(at).cast("int")))

        out[mask] = F.coalesce(_at(mask, cell("r", height) - F.col("tr") * tile, cell("c", width) - F.col("tc") * tile) == 1, F.lit(False))
    return met.select(*(F.col(n) for n in points.columns), *(e.alias(n) for n, e in out.items()))
