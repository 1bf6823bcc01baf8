"""Shapes on rows of a grid: sorted crossings of their edges with a row become intervals, and only the intervals' ends are looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import Grid


def _crosses(y: Column) -> Column:
    """Whether an edge crosses the line at y; its upper end doesn't count."""
    return (F.col("y0") > y) != (F.col("y1") > y)


def _crossing(y: Column) -> Column:
    return F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))


def intervals(crossings: DataFrame, keys: tuple[str, ...], x: str = "x") -> DataFrame:
    """(keys, lo, hi) where the line of each key is inside, lo <= x < hi, from its crossings: an odd number of them lies beyond.

    An open shape's last interval begins at minus infinity. One exchange, of the crossings; a line's are sorted in one task.
    """
    line = Window.partitionBy(*keys).orderBy(F.desc(x))
    rows = crossings.select(*keys, F.col(x).alias("hi"), F.coalesce(F.lead(x).over(line), F.lit(float("-inf"))).alias("lo"), F.row_number().over(line).alias("_n"))
    return rows.where((F.col("_n") % 2 == 1) & (F.col("lo") < F.col("hi"))).select(*keys, "lo", "hi")


def row_intervals(edges: DataFrame, grid: Grid, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, row, lo, hi): where each row of the grid, at its centres' height, is inside the shape of edges (keys, x0, y0, x1, y1).

    An edge becomes a row for each grid row that it crosses; by keys there are as many shapes.
    """
    def about(y: Column) -> Column:
        return (F.lit(grid.north) - y) / grid.resolution - 0.5

    low = F.greatest(F.lit(0).cast("long"), F.floor(about(F.greatest("y0", "y1"))))
    high = F.least(F.lit(grid.height - 1).cast("long"), F.ceil(about(F.least("y0", "y1"))))
    rows = edges.where("y0 != y1").where(low <= high).select(*keys, "x0", "y0", "x1", "y1", F.explode(F.sequence(low, high)).alias("row"))
    _, y = grid.xy(F.col("row") + 0.5, F.lit(0.5))
    return intervals(rows.where(_crosses(y)).select(*keys, F.col("row").cast("int").alias("row"), _crossing(y).alias("x")), (*keys, "row"))


def spans(edges: DataFrame, grid: Grid, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, row, start, stop): the columns whose centres are inside, both ends included. Ends are found by division and put right by the centres themselves."""
    def centre(j: Column) -> Column:
        return grid.xy(F.lit(0.5), j + 0.5)[0]

    def first(x: Column) -> Column:
        """The first column whose centre is at x or beyond."""
        j = F.ceil(F.greatest(F.lit(-2.0), F.least(F.lit(grid.width + 2.0), (x - grid.west) / grid.resolution - 0.5)))
        return F.when(centre(j - 1) >= x, j - 1).when(centre(j) >= x, j).otherwise(j + 1)

    found = row_intervals(edges, grid, keys).select(*keys, "row", F.greatest(F.lit(0).cast("long"), first(F.col("lo"))).cast("int").alias("start"), F.least(F.lit(grid.width).cast("long"), first(F.col("hi"))).cast("int").alias("_end"))
    return found.select(*keys, "row", "start", (F.col("_end") - 1).alias("stop")).where("start <= stop")


def mask(cells: DataFrame, edges: DataFrame, grid: Grid, name: str = "inside") -> DataFrame:
    """cells (row, col, and anything else) with whether each one's centre is inside, by the even-odd rule. A grid row's intervals come to its cells as an array, sorted."""
    lines = spans(edges, grid).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_spans"))
    met = cells.join(lines, "row", "left")
    inside = F.exists("_spans", lambda s: (s["start"] <= F.col("col")) & (s["stop"] >= F.col("col")))
    return met.select(*(F.col(c) for c in cells.columns), F.coalesce(inside, F.lit(False)).alias(name))


def areas(edges: DataFrame, grid: Grid, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """(keys, cells, area_km2) of shapes on the grid, from their intervals: no cell is made."""
    n = F.sum(F.col("stop") - F.col("start") + 1).cast("long")
    return spans(edges, grid, keys).groupBy(*keys).agg(n.alias("cells"), (n * grid.cell_km2).alias("area_km2"))


def cell_weights(cells: DataFrame, edges: DataFrame, resolution: float, supersample: int = 10) -> DataFrame:
    """(lat, lon, w): the share of each cell's sub-points inside the shape, by the cosine of latitude.

    Each latitude has `supersample` lines of sub-points. A line's intervals cover a cell whole, or not at all, or end in it: only then
    sub-points are looked at. Edges meet the lines by stretches of one resolution; a cell meets its latitude's intervals as an array.
    """
    n, at = supersample, [(k + 0.5) / supersample - 0.5 for k in range(supersample)]
    cells = cells.select("lat", "lon").distinct()
    lines = cells.select("lat").distinct().select("lat", F.posexplode(F.array(*(F.lit(a) for a in at))).alias("line", "_a")).select("lat", "line", (F.col("lat") + F.col("_a") * resolution).alias("y"))
    stretch = [F.floor(F.col(c) / resolution) for c in ("y0", "y1")]
    e = edges.where("y0 != y1").select("x0", "y0", "x1", "y1", F.explode(F.sequence(F.least(*stretch), F.greatest(*stretch))).alias("_s"))
    met = lines.withColumn("_s", F.floor(F.col("y") / resolution)).join(e, "_s").where(_crosses(F.col("y"))).select("lat", "line", _crossing(F.col("y")).alias("x"))
    of_lat = intervals(met, ("lat", "line")).groupBy("lat").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))

    def covered(s: Column) -> Column:
        x = [F.col("lon") + F.lit(a) * resolution for a in at]
        some = sum((((p >= s["lo"]) & (p < s["hi"])).cast("int") for p in x[1:]), ((x[0] >= s["lo"]) & (x[0] < s["hi"])).cast("int"))
        return F.when((s["lo"] <= x[0]) & (s["hi"] > x[-1]), F.lit(n)).when((s["hi"] <= x[0]) | (s["lo"] > x[-1]), F.lit(0)).otherwise(some)

    hits = F.aggregate(F.coalesce("_spans", F.array().cast("array<struct<lo:double,hi:double>>")), F.lit(0), lambda total, s: total + covered(s))
    return cells.join(of_lat, "lat", "left").select("lat", "lon", (hits / F.lit(float(n * n)) * F.cos(F.radians("lat"))).alias("w"))


def inside(points: DataFrame, edges: DataFrame, x: str = "x", y: str = "y", name: str = "inside", strip: float | None = None) -> DataFrame:
    """points with `name`, whether they lie in the shape by the even-odd rule, so that holes are out; points of any heights.

    Edges (x0, y0, x1, y1) are gathered by strips of y, and a point meets its strip's as an array: one exchange of the points, and none
    of the edges comes to the driver but their mean height, which a strip has unless `strip` says otherwise. Where very many
    edges share a strip, inside_by_join() of the raster operators keeps them apart.
    """
    e = edges.where("y0 != y1")
    if strip is None:
        strip = e.agg(F.avg(F.abs(F.col("y1") - F.col("y0")))).first()[0] or 1.0
    ends = [F.floor(F.col(c) / strip) for c in ("y0", "y1")]
    strips = e.select("x0", "y0", "x1", "y1", F.explode(F.sequence(F.least(*ends), F.greatest(*ends))).alias("_s")).groupBy("_s").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("_e"))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    hit = F.filter("_e", lambda s: ((s["y0"] > py) != (s["y1"] > py)) & (px < s["x0"] + (py - s["y0"]) * (s["x1"] - s["x0"]) / (s["y1"] - s["y0"])))
    met = points.withColumn("_s", F.floor(py / strip)).join(strips, "_s", "left")
    return met.select(*(F.col(c) for c in points.columns), F.coalesce(F.size(hit) % 2 == 1, F.lit(False)).alias(name))
