"""Elevation rasters as cell rows (row, col, elevation, inside) and shapes as rows: addressing, sampling, masks, statistics, despiking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.classes import band_of
from ..functions.geo import EqualArea, Grid, tile_x, tile_y
from . import tiles
from .nearest import filled
from .scanlines import areas, cell_weights, inside, mask

__all__ = ["areas", "cell_weights", "filled", "inside", "mask"]  # of the modules beside this one

# Edges of the elevation bands in metres.
BAND_EDGES = (300.0, 600.0, 900.0, 1000.0, 1100.0, 1200.0, 1300.0, 1400.0, 1600.0, 2400.0)


def tile_ranges(boxes: DataFrame, zoom: int) -> DataFrame:
    """Tiles (name, x, y) that cover boxes (name, west, south, east, north)."""
    rows = boxes.select("name", *(F.floor(c).cast("int").alias(n) for n, c in (("x0", tile_x("west", zoom)), ("x1", tile_x("east", zoom)), ("y0", tile_y("north", zoom)), ("y1", tile_y("south", zoom)))))
    return rows.select("name", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("name", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def cells_in_box(boxes: DataFrame, step: float = 0.25) -> DataFrame:
    """Grid centres (name, lat, lon), multiples of `step`, within boxes, edges included."""
    def along(low: str, high: str) -> Column:
        a, b = F.ceil(F.round(F.col(low) / step, 9)), F.floor(F.round(F.col(high) / step, 9))
        return F.explode(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>")))

    return boxes.select("name", along("south", "north").alias("_i"), "west", "east").select("name", (F.col("_i") * step).alias("lat"), along("west", "east").alias("_j")).select("name", "lat", (F.col("_j") * step).alias("lon"))


def vertices(shapes: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(name, part, ring, i, x, y) of multipolygons as array<array<array<array<double>>>>."""
    parts = shapes.select("name", F.posexplode(geometry).alias("part", "_p")).select("name", "part", F.posexplode("_p").alias("ring", "_r"))
    return parts.select("name", "part", "ring", F.posexplode("_r").alias("i", "_v")).select("name", "part", "ring", "i", F.col("_v")[0].alias("x"), F.col("_v")[1].alias("y"))


def bounding_boxes(shapes: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(name, west, south, east, north); nulls for empty or null shapes."""
    boxes = vertices(shapes, geometry).groupBy("name").agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))
    return shapes.select("name").distinct().join(boxes, "name", "left")


def in_view(boxes: DataFrame, view: tuple[float, float, float, float]) -> DataFrame:
    """Shapes whose boxes meet the view (west, south, east, north); those without a box don't."""
    west, south, east, north = view
    return boxes.where((F.col("east") >= west) & (F.col("west") <= east) & (F.col("north") >= south) & (F.col("south") <= north))


def grid_over(outline: DataFrame, projection: EqualArea, resolution: float, margin: float = 20_000.0) -> Grid:
    """The north-up grid over the projected outline (lon, lat) and a margin: four numbers come to the driver."""
    x, y = projection.forward("lon", "lat")
    r = outline.select(x.alias("x"), y.alias("y")).agg(F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("n")).first()
    west, north = r["w"] - margin, r["n"] + margin
    return Grid(west, north, resolution, int(np.ceil((r["e"] + margin - west) / resolution)), int(np.ceil((north - (r["s"] - margin)) / resolution)))


def cells_of(spark: SparkSession, grid: Grid) -> DataFrame:
    """(row, col, x, y) of cell centres: rows from a range that Spark partitions, columns exploded in place."""
    x, y = grid.xy(F.col("row") + 0.5, F.col("col") + 0.5)
    return spark.range(grid.height).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))).alias("col")).select("row", "col", x.alias("x"), y.alias("y"))


def inside_by_join(points: DataFrame, edges: DataFrame, keys: tuple[str, ...], x: str = "x", y: str = "y", name: str = "inside", strip: float | None = None) -> DataFrame:
    """inside() by a join of points and edges on strips of y, counting crossings; for shapes of any number of edges.

    A strip is as high as an edge is on average, in whatever unit, so that the edges become about twice as many rows; or `strip`.
    """
    e = edges.where("y0 != y1")
    if strip is None:
        strip = e.agg(F.avg(F.abs(F.col("y1") - F.col("y0")))).first()[0] or 1.0
    e = e.withColumn("_s", F.explode(F.sequence(F.floor(F.least("y0", "y1") / strip), F.floor(F.greatest("y0", "y1") / strip))))
    p = points.withColumn("_s", F.floor(F.col(y) / strip))
    hit = ((F.col("y0") > F.col(y)) != (F.col("y1") > F.col(y))) & (F.col(x) < F.col("x0") + (F.col(y) - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    crossings = p.join(e, "_s").where(hit).groupBy(*keys).agg(F.count("*").alias("_n"))
    return points.join(crossings, [*keys], "left").withColumn(name, F.coalesce(F.col("_n") % 2 == 1, F.lit(False))).drop("_n")


def edges_of(points: DataFrame, keys: tuple[str, ...] = ("name", "part", "ring")) -> DataFrame:
    """(keys, x0, y0, x1, y1) from ring vertices in the order of i; the last is joined to the first."""
    w = Window.partitionBy(*keys).orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.select(*keys, F.col("x").alias("x0"), F.col("y").alias("y0"), F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x1"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y1"))


def bilinear(points: DataFrame, raster: DataFrame, keys: tuple[str, ...], height: int, width: int, value: str = "elevation", clamp: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """points (keys, r, c as fractional places) with the raster's value between the four nearest centres.

    Places are clamped to the centres' range (`clamp`), or else null beyond the grid; missing neighbours are left out and
    the weights of the others rescaled. Points meet tiles of the raster, see tiles.sampled(). `by` are those of the keys that the
    raster has too, if it is many fields.
    """
    return tiles.sampled(points.select(*keys, "r", "c"), tiles.tiled(raster, (value,), by), height, width, value, clamp, by).select(*keys, value)


def elevations_at(places: DataFrame, raster: DataFrame, grid: Grid, projection: EqualArea) -> DataFrame:
    """(name, elevation) of places (name, lon, lat), clamped to the grid."""
    x, y = projection.forward("lon", "lat")
    r, c = grid.pixel(x, y)
    return bilinear(places.select("name", r.alias("r"), c.alias("c")), raster, ("name",), grid.height, grid.width)


def profile_points(lines: DataFrame, samples: int) -> DataFrame:
    """(name, i, x, y, distance_km) at even steps along straight lines (name, x0, y0, x1, y1), ends included."""
    t = F.col("i") / F.lit(float(samples - 1))
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2) / 1000.0
    rows = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return rows.select("name", "i", (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"), (t * length).alias("distance_km"))


def spread(rows: DataFrame, each: int, of: int = 1_000_000) -> DataFrame:
    """rows dealt out to tasks of about `of` rows each, once every one has become `each`: a small file is one task, whatever comes of it."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * each // of)))


def profile(lines: DataFrame, raster: DataFrame, grid: Grid, samples: int) -> DataFrame:
    """(name, i, distance_km, elevation) along the lines, and `inside`, the mask of the cell a sample falls in, if the raster has one.

    The lines are counted and dealt out before they become samples.
    """
    r, c = grid.pixel("x", "y")
    placed = profile_points(spread(lines, samples), samples).select("name", "i", "distance_km", r.alias("r"), c.alias("c"))
    mask = "inside" if "inside" in raster.columns else None
    met = tiles.sampled(placed, tiles.tiled(raster, ("elevation", *([mask] if mask else []))), grid.height, grid.width, mask=mask)
    return met.select("name", "i", "distance_km", "elevation", *([mask] if mask else []))


def along_line(points: DataFrame, lines: DataFrame) -> DataFrame:
    """(name, mark, distance_km): where marks (name, mark, x, y) fall on their line, projected at right angles."""
    j = points.join(lines, "name")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return j.select("name", "mark", (F.try_divide((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy, F.sqrt(dx * dx + dy * dy)) / 1000.0).alias("distance_km"))


def near_marks(profile_rows: DataFrame, marks: DataFrame, reach: float = 20.0) -> DataFrame:
    """(name, mark, highest): the highest elevation strictly within reach of each mark. An equi-join on line and reach-wide stretch, then the exact test."""
    p = profile_rows.withColumn("_b", F.floor(F.col("distance_km") / reach))
    m = marks.select("name", "mark", F.col("distance_km").alias("_at")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_at") / reach) - 1, F.floor(F.col("_at") / reach) + 1)))
    return p.join(m, ["name", "_b"]).where(F.abs(F.col("distance_km") - F.col("_at")) < reach).groupBy("name", "mark").agg(F.max("elevation").alias("highest"))


def profile_features(profile_rows: DataFrame, last: float = 0.3, before_km: float = 60.0) -> DataFrame:
    """(name, low_km, low, rim_km, rim, drop, apart_km, plateau) of lines (name, distance_km, elevation, inside).

    low is the lowest sample beyond 1 - last of the line, rim the highest strictly between before_km ahead of it and itself,
    the first on ties; plateau is the median elevation of the inside samples before 1 - last of the line. What has no sample is null.
    A line's samples are gathered once, and all is told from its array.
    """
    rows = profile_rows.groupBy("name").agg(F.max("distance_km").alias("_end"), F.collect_list(F.struct("distance_km", "elevation", "inside")).alias("_s"))
    rows = rows.select("name", ((1 - last) * F.col("_end")).alias("_end"), F.filter("_s", lambda x: x["elevation"].isNotNull()).alias("_s"))
    beyond = F.filter("_s", lambda x: x["distance_km"] > F.col("_end"))
    before = F.filter("_s", lambda x: (x["distance_km"] < F.col("_end")) & x["inside"])
    rows = rows.select("name", "_s", F.array_min(F.transform(beyond, lambda x: F.struct(x["elevation"], x["distance_km"]))).alias("_l"), F.sort_array(F.transform(before, lambda x: x["elevation"])).alias("_p"))
    low = F.col("_l.distance_km")
    ahead = F.filter("_s", lambda x: (x["distance_km"] < low) & (x["distance_km"] > low - before_km))
    rim = F.array_max(F.transform(ahead, lambda x: F.struct(x["elevation"], (-x["distance_km"]).alias("back"))))
    n = F.size("_p")
    plateau = (F.get("_p", F.floor((n - 1) / 2).cast("int")) + F.get("_p", F.floor(n / 2).cast("int"))) / 2
    told = rows.select("name", "_l", rim.alias("_r"), plateau.alias("plateau"))
    return told.select("name", F.col("_l.distance_km").alias("low_km"), F.col("_l.elevation").alias("low"), (-F.col("_r.back")).alias("rim_km"), F.col("_r.elevation").alias("rim"), (F.col("_r.elevation") - F.col("_l.elevation")).alias("drop"), (F.col("_l.distance_km") + F.col("_r.back")).alias("apart_km"), "plateau")


def masked_at(points: DataFrame, raster: DataFrame, grid: Grid, keys: tuple[str, ...]) -> DataFrame:
    """points (keys, r, c) with the mask of the cell they fall in, clamped to the grid."""
    row, col = grid.cell("r", "c")
    return points.withColumn("row", row).withColumn("col", col).join(raster.select("row", "col", "inside"), ["row", "col"], "left").select(*keys, F.coalesce("inside", F.lit(False)).alias("inside"))


def ordered(value: Column) -> Column:
    """Doubles as whole numbers in the same order: their bits, those of negative ones turned over. Not a number and null are null."""

    @F.pandas_udf("long")
    def run(v: pd.Series) -> pd.Series:
        x = v.to_numpy(float, na_value=np.nan) + 0.0  # no negative zero
        bits = x.view(np.int64)
        return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)).astype("Int64").mask(np.isnan(x))

    return run(value.cast("double"))


def selected(cells: DataFrame, places: Sequence[int] | Callable[[int], Sequence[int]], value: str = "elevation", digit: int = 16) -> list[float]:
    """The values at some places, from 0, in ascending order: radix selection over the bits of doubles. `places` may be told by the number of values.

    Each of 64 / digit rounds counts the rows that a place can still be among by their next digit, and tells the digit; so many
    counts come to the driver a round, whatever the rows, and no row is sorted or dealt out. Not a number and null count for
    none. IndexError beyond the rows.
    """
    keys = cells.select(ordered(F.col(value)).alias("_k")).where("_k is not null")
    at = None if callable(places) else [(0, int(p)) for p in places]  # what is known of the key from the top, and the place among those that share it
    for shift in range(64 - digit, -1, -digit):
        # The topmost bit is a sign: turned over, keys are in order as unsigned numbers.
        unsigned = F.col("_k").bitwiseXOR(F.lit(-(2**63)))
        top, mine = F.shiftrightunsigned(unsigned, shift), F.lit((1 << digit) - 1)
        rows = keys if shift == 64 - digit else keys.where(F.shiftrightunsigned(unsigned, shift + digit).isin(sorted({k for k, _ in at})))
        above = F.lit(0) if shift == 64 - digit else F.shiftrightunsigned(unsigned, shift + digit)
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in rows.groupBy(above.alias("above"), top.bitwiseAND(mine).alias("digit")).count().collect():
            counts.setdefault(r["above"], []).append((r["digit"], r["count"]))
        if at is None:
            at = [(0, p) for p in places(sum(n for _, n in counts.get(0, [])))]
        found = []
        for above_, place in at:
            for d, n in sorted(counts.get(above_, [])):
                if place < n:
                    found.append(((above_ << digit) | d, place))
                    break
                place -= n
            else:
                raise IndexError("there are not so many rows")
        at = found
    signed = np.array([k for k, _ in at], np.uint64) ^ np.uint64(1 << 63)
    bits = signed.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(float).tolist()


def median_of(cells: DataFrame, value: str = "elevation") -> float | None:
    """The exact median, by selected(); null without values."""
    found = selected(cells, lambda n: ((n - 1) // 2, n // 2) if n else (), value)
    return sum(found) / 2 if found else None


def elevation_stats(raster: DataFrame, cell_km2: float, grid: Grid | None = None, projection: EqualArea | None = None) -> DataFrame:
    """One row: area, extremes and the first cell in row-major order that has them, mean, median, and shares above 1000 and 1200 and
    below 600 m; with a grid and its projection the extremes' places in degrees too. The median is computed at once, in four counting jobs."""
    e = F.col("elevation")
    cells = raster.where(F.col("inside") & e.isNotNull())
    at = F.struct("row", "col")
    told = cells.agg(
        (F.count("*") * cell_km2).alias("area_km2"), F.min(e).alias("min_m"), F.max(e).alias("max_m"), F.avg(e).alias("mean_m"),
        F.min_by(at, F.struct(e, "row", "col")).alias("_a"), F.max_by(at, F.struct(e, -F.col("row"), -F.col("col"))).alias("_b"),
        *((F.avg(x.cast("double")) * 100).alias(n) for n, x in (("above_1000_pct", e >= 1000), ("above_1200_pct", e >= 1200), ("below_600_pct", e < 600))),
    )
    places = []
    if grid is not None and projection is not None:
        for name, cell in (("min", "_a"), ("max", "_b")):
            places += [c.alias(f"{name}_{at}") for c, at in zip(projection.inverse(*grid.xy(F.col(f"{cell}.row") + 0.5, F.col(f"{cell}.col") + 0.5)), ("lon", "lat"), strict=True)]
    median = F.lit(median_of(cells)).cast("double")
    return told.select("area_km2", "min_m", "max_m", "mean_m", median.alias("median_m"), F.col("_a.row").alias("min_row"), F.col("_a.col").alias("min_col"), F.col("_b.row").alias("max_row"), F.col("_b.col").alias("max_col"), "above_1000_pct", "above_1200_pct", "below_600_pct", *places)


def area_by_band(raster: DataFrame, edges: tuple[float, ...] = BAND_EDGES) -> DataFrame:
    """(band, low, high, share_pct): every band, shares of all inside cells, also of those beyond the bands."""
    cells = raster.where(F.col("inside") & F.col("elevation").isNotNull())
    counts = cells.groupBy(band_of("elevation", edges).alias("band")).agg(F.count("*").alias("n"))
    bands = raster.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "band int, low double, high double")
    # A row a band, and one for what lies beyond them: the window is over these few.
    both = bands.join(counts, "band", "full").withColumn("_t", F.sum("n").over(Window.partitionBy(F.lit(0)))).where("low is not null")
    return both.select("band", "low", "high", F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)) * 100.0, F.col("_t")), F.lit(0.0)).alias("share_pct"))


def block_mean(raster: DataFrame, factor: int, height: int, width: int, value: str = "elevation") -> DataFrame:
    """Means of factor x factor blocks; ragged edges are dropped, and a block with a missing cell is missing."""
    full = raster.where((F.col("row") < height // factor * factor) & (F.col("col") < width // factor * factor))
    n = factor * factor
    return full.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.when(F.count(value) == n, F.avg(value)).alias(value))


def regrid(targets: DataFrame, field: DataFrame, keys: tuple[str, ...], north: float, west: float, step: float, height: int, width: int, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Bilinear values of a lat-lon field (by, lat, lon, value) at targets (keys, lat, lon), for each of `by`; null outside the field's cells."""
    source = field.select(*by, F.round((F.lit(north) - F.col("lat")) / step).cast("int").alias("row"), F.round((F.col("lon") - west) / step).cast("int").alias("col"), value)
    places = targets.select(*keys, ((F.lit(north) - F.col("lat")) / step + 0.5).alias("r"), ((F.col("lon") - west) / step + 0.5).alias("c"))
    if by:
        # A field for each of a few keys, such as months: each target meets each of them once.
        few = F.broadcast(field.select(*by).distinct().agg(F.collect_list(F.struct(*by)).alias("_by")).select("_by", F.lit(1).alias("_one")))
        places = places.withColumn("_one", F.lit(1)).join(few, "_one").select(*keys, "r", "c", F.explode("_by").alias("_b")).select(*keys, "r", "c", "_b.*")
    return bilinear(places, source, (*keys, *by), height, width, value, clamp=False, by=by)


def mosaic_to_grid(mosaic: DataFrame, zoom: int, grid: Grid, projection: EqualArea, tile: int = 256) -> DataFrame:
    """(row, col, elevation) of an equal-area grid from a mosaic of web-map tiles (row, col as pixels of the whole world's map, elevation).

    Each grid cell's centre goes back to degrees and on to its place among the pixels, with bilinear values there; cells
    beyond the mosaic have 0.
    """
    box = mosaic.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    r0, r1, c0, c1 = ((v if v is not None else 0) for v in box)
    lon, lat = projection.inverse("x", "y")
    cells = cells_of(mosaic.sparkSession, grid).select(F.col("row").alias("i"), F.col("col").alias("j"), lon.alias("lon"), lat.alias("lat"))
    places = cells.select("i", "j", (tile_y("lat", zoom) * tile - r0).alias("r"), (tile_x("lon", zoom) * tile - c0).alias("c"))
    shifted = mosaic.select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), "elevation")
    out = bilinear(places, shifted, ("i", "j"), r1 - r0 + 1, c1 - c0 + 1, clamp=False)
    return out.select(F.col("i").alias("row"), F.col("j").alias("col"), F.coalesce("elevation", F.lit(0.0)).alias("elevation"))


TILE = 256


def sliding_median(a: np.ndarray, n: int) -> np.ndarray:
    """The median of the n x n window about each place, n odd, the array's edge repeated beyond it; not a number counts for none.

    Full windows need one selection each, of the value in the middle; only those with missing values are sorted.
    """
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(a, n // 2, mode="edge"), (n, n)).reshape(-1, n * n)
    out = np.partition(windows, n * n // 2, axis=1)[:, n * n // 2]
    missing = np.isnan(windows)
    if missing.any():
        holes = np.flatnonzero(missing.any(axis=1))
        some = np.sort(windows[holes], axis=1)
        counts = n * n - missing[holes].sum(1)
        row, at = np.arange(len(some)), np.maximum(counts, 1)
        out[holes] = np.where(counts > 0, (some[row, (at - 1) // 2] + some[row, at // 2]) / 2, np.nan)
    return out.reshape(a.shape)


def despike(raster: DataFrame, height: int, width: int, floor: float = 40.0, k: float = 4.0, size: int = 5, tile: int = TILE) -> DataFrame:
    """(row, col, elevation): a value farther from its neighbourhood's median than `floor` and than k times the local spread becomes the median.

    The spread is the median, over a window two wider, of those distances. Tiles with a halo are groups of bounded size
    (rows are repeated only along the tiles' edges); beyond the raster its edge is repeated. Missing cells stay and count for none.
    """
    halo = size // 2 + (size + 2) // 2
    tiles_r, tiles_c = -(-height // tile), -(-width // tile)

    def around(at: str, n: int) -> Column:
        lo, hi = F.floor((F.col(at) - halo) / tile), F.floor((F.col(at) + halo) / tile)
        return F.sequence(F.greatest(F.lit(0).cast("bigint"), lo), F.least(F.lit(n - 1).cast("bigint"), hi))

    rows = raster.select("row", "col", F.col("elevation").cast("double").alias("elevation"))
    rows = rows.withColumn("tr", F.explode(around("row", tiles_r))).withColumn("tc", F.explode(around("col", tiles_c)))

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        tr, tc = key
        r0, c0 = max(tr * tile - halo, 0), max(tc * tile - halo, 0)
        r1, c1 = min((tr + 1) * tile + halo, height), min((tc + 1) * tile + halo, width)
        a = np.full((r1 - r0, c1 - c0), np.nan)
        a[cells["row"] - r0, cells["col"] - c0] = cells["elevation"].to_numpy(float, na_value=np.nan)
        middle = sliding_median(a, size)
        away = np.abs(a - middle)
        spread = sliding_median(away, size + 2)
        out = np.where(away > np.maximum(floor, k * spread), middle, a)
        own = cells[(cells["row"] // tile == tr) & (cells["col"] // tile == tc)]
        return pd.DataFrame({"row": own["row"], "col": own["col"], "elevation": out[own["row"] - r0, own["col"] - c0]})

    out = rows.groupBy("tr", "tc").applyInPandas(run, "row int, col int, elevation double")
    return out.withColumn("elevation", F.when(~F.isnan("elevation"), F.col("elevation")))


def despike_twice(raster: DataFrame, height: int, width: int, tile: int = TILE) -> DataFrame:
    """The two passes: floors of 40 and 25 m."""
    return despike(despike(raster, height, width, 40.0, tile=tile), height, width, 25.0, tile=tile)


def pixels(tiles: DataFrame, tile: int = 256) -> DataFrame:
    """(x, y, row, col, r, g, b) of Spark image rows whose origins end in x/y.png, rows and columns as pixels of the whole map;
    channels come as blue, green, red."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (h, w, n), same in pdf.groupby(["height", "width", "n"]):
                i, j = (k.ravel() for k in np.indices((h, w)))
                for part in np.array_split(np.arange(len(same)), len(same) * h * w // 4_000_000 + 1):
                    some = same.iloc[part]
                    a = np.frombuffer(b"".join(some["data"]), np.uint8).reshape(len(some), h * w, n).astype(np.int32)
                    x, y = (np.repeat(some[c].to_numpy(), h * w) for c in ("x", "y"))
                    yield pd.DataFrame({"x": x, "y": y, "row": y * tile + np.tile(i, len(some)), "col": x * tile + np.tile(j, len(some)), "r": a[..., 2].ravel(), "g": a[..., 1].ravel(), "b": a[..., 0].ravel()})

    place = F.regexp_extract("image.origin", r"(\d+)/(\d+)\.png$", 1).cast("int"), F.regexp_extract("image.origin", r"(\d+)/(\d+)\.png$", 2).cast("int")
    rows = tiles.select(place[0].alias("x"), place[1].alias("y"), "image.height", "image.width", F.col("image.nChannels").alias("n"), "image.data")
    return rows.mapInPandas(run, "x int, y int, row int, col int, r int, g int, b int")
