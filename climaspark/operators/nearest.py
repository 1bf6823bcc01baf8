"""Missing cells from the nearest valid one: an exact distance transform in two passes, by strips of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRIP = 64
_FAR = np.int64(1) << 60


def nearest_columns(g2: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each place of each row the column whose cell is nearest: g2 holds each column's squared distance down or up, rows where its cell is.

    Ties go to the smaller rows entry, then the smaller column. The nearest column never goes back along a row, so each half of a stretch
    looks only on its side of the middle's column: all stretches of a level at once, W log W looks a row.
    """
    n, width = g2.shape
    out = np.zeros((n, width), np.int64)
    at = np.arange(n)
    lo, hi, first, last = np.zeros(n, np.int64), np.full(n, width - 1), np.zeros(n, np.int64), np.full(n, width - 1)
    while len(at):
        middle, size = (lo + hi) // 2, last - first + 1
        start = np.cumsum(size) - size
        column = np.arange(size.sum()) - np.repeat(start - first, size)
        row = np.repeat(at, size)
        d = g2[row, column] + (column - np.repeat(middle, size)) ** 2
        least = np.repeat(np.minimum.reduceat(d, start), size)
        up = np.where(d == least, rows[row, column], _FAR)
        column = np.where(up == np.repeat(np.minimum.reduceat(up, start), size), column, width)
        best = np.minimum.reduceat(column, start)
        out[at, middle] = best
        left, right = middle > lo, middle < hi
        at, lo, hi, first, last = (np.concatenate(x) for x in ((at[left], at[right]), (lo[left], middle[right] + 1), (middle[left] - 1, hi[right]), (first[left], best[right]), (best[left], last[right])))
    return out


def strip_filled(a: np.ndarray, row0: int, above: np.ndarray, above_value: np.ndarray, below: np.ndarray, below_value: np.ndarray) -> np.ndarray:
    """A strip of rows from row0 on with its missing values filled; above and below are each column's nearest valid rows beyond it (-FAR and FAR: none)."""
    n, width = a.shape
    own = np.arange(row0, row0 + n)[:, None]
    valid = ~np.isnan(a)
    up = np.maximum.accumulate(np.vstack([above[None], np.where(valid, own, -_FAR)]), axis=0)[1:]
    down = np.minimum.accumulate(np.vstack([np.where(valid, own, _FAR), below[None]])[::-1], axis=0)[::-1][:-1]
    du, dd = np.where(up == -_FAR, _FAR, own - up), np.where(down == _FAR, _FAR, down - own)
    rows = np.where(du <= dd, up, down)
    rows[(up == -_FAR) & (down == _FAR)] = _FAR
    g = np.minimum(du, dd)
    g2 = np.where(g == _FAR, _FAR, np.where(g == _FAR, 0, g) ** 2)
    holes = np.flatnonzero(~valid.all(axis=1))
    out = a.copy()
    if len(holes):
        column = nearest_columns(g2[holes], rows[holes])
        row = np.take_along_axis(rows[holes], column, axis=1)
        found = row < _FAR
        inner = found & (row >= row0) & (row < row0 + n)
        value = np.where(row < row0, above_value[column], below_value[column])
        value[inner] = a[row[inner] - row0, column[inner]]
        value[~found] = np.nan
        out[holes] = np.where(valid[holes], a[holes], value)
    return out


def filled(raster: DataFrame, value: str = "elevation", strip: int = STRIP) -> DataFrame:
    """(row, col, value): the raster with missing values from the nearest valid cell by squared distance, ties to the first in row-major order.

    Two passes: along columns the nearest valid rows up and down, along rows the least of a column's squared distance and the squared
    way to it. A strip of rows is a task's group; what lies beyond it comes as each column's last valid row above and first one below,
    from a window over one row a strip and column. Linear in the cells but for a logarithm of the width, whatever the size of holes. Cells
    that are absent are not filled, and count as missing. A raster without any valid cell keeps its nulls; an empty one is empty.
    Numbers only, exact as doubles.
    """
    kind = raster.schema[value].dataType
    cells = raster.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v")).withColumn("strip", F.floor(F.col("row") / strip))
    at = F.when(F.col("v").isNotNull(), F.col("row"))
    ends = cells.groupBy("strip", "col").agg(F.max_by(F.struct("row", "v"), at).alias("last"), F.min_by(F.struct("row", "v"), at).alias("first"))
    order = Window.partitionBy("col").orderBy("strip")
    above = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    below = F.first("first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    told = ends.select("strip", "col", "first", "last", above.alias("a"), below.alias("b"), F.lag("strip").over(order).alias("_before"), F.lead("strip").over(order).alias("_after"))
    # A column that has no cell in a strip can be nearest there too: the strips around its own get it as well. One row is broadcast.
    told = told.crossJoin(F.broadcast(cells.agg(F.min("strip").alias("_low"), F.max("strip").alias("_high"))))

    def gap(low: Column, high: Column, a: Column, b: Column) -> Column:
        strips = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(strips, lambda s: F.struct(s.alias("strip"), a.alias("a"), b.alias("b")))

    s, nothing = F.col("strip"), F.lit(None).cast(ends.schema["last"].dataType)
    after = gap(s + 1, F.coalesce(F.col("_after") - 1, F.col("_high")), F.coalesce("last", "a"), F.col("b"))
    ahead = gap(F.when(F.col("_before").isNull(), F.col("_low")).otherwise(s), s - 1, nothing, F.coalesce("first", "b"))
    every = told.select("col", F.explode(F.concat(F.array(F.struct("strip", "a", "b")), after, ahead)).alias("_"))
    carried = every.select("_.strip", "col", F.col("_.a.row").alias("ar"), F.col("_.a.v").alias("av"), F.col("_.b.row").alias("br"), F.col("_.b.v").alias("bv"))

    def run(key: tuple, some: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        row0, col0 = int(key[0]) * strip, int(ends["col"].min())
        a = np.full((strip, int(ends["col"].max()) - col0 + 1), np.nan)
        i, j = some["row"].to_numpy() - row0, some["col"].to_numpy() - col0
        if not len(some):
            return pd.DataFrame({"row": [], "col": [], "v": []})
        a[i, j] = some["v"].to_numpy(float, na_value=np.nan)
        width = a.shape[1]
        none = (-_FAR, np.nan, _FAR, np.nan)
        carry = [np.full(width, x) for x in none]
        place = ends["col"].to_numpy() - col0
        for c, name, x in zip(carry, ("ar", "av", "br", "bv"), none, strict=True):
            there = ends[name].notna().to_numpy()
            c[place[there]] = ends[name][there].to_numpy(c.dtype)
        out = strip_filled(a, row0, *carry)[i, j]
        return pd.DataFrame({"row": some["row"], "col": some["col"], "v": out})

    carried = carried.toDF(*carried.columns)  # columns of their own, as both sides come from one table
    out = cells.groupBy("strip").cogroup(carried.groupBy("strip")).applyInPandas(run, "row long, col long, v double")
    return out.select(*(F.col(c).cast(raster.schema[c].dataType).alias(c) for c in ("row", "col")), F.when(~F.isnan("v"), F.col("v")).cast(kind).alias(value))
