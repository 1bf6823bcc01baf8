"""Web-map tiles as files, zoom/x/y.png: written from pixels, and of a box only those that it needs are opened."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import terrarium
from ..operators.raster import pixels


def png(rgb: np.ndarray) -> bytes:
    """An image file of 8-bit colours (height, width, 3)."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width, _ = rgb.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, -1).astype(np.uint8)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def coded(elevation: np.ndarray) -> np.ndarray:
    """Colours of elevations in metres, down to a 256th; not a number becomes 0 m."""
    steps = np.floor((np.nan_to_num(elevation) + 32768) * 256).astype(np.int64)
    return np.stack([steps >> 16 & 255, steps >> 8 & 255, steps & 255], axis=-1).astype(np.uint8)


def write_tiles(cells: DataFrame, root: str, zoom: int, tile: int = 256) -> int:
    """Writes cells (row, col as pixels of the whole map, elevation) as tile files below root/zoom, and returns their number.

    A tile is a task's group, whatever the raster. Pixels without a cell are 0 m. root is a path or address that pyarrow opens on every executor.
    """
    placed = cells.select(F.floor(F.col("col") / tile).cast("int").alias("x"), F.floor(F.col("row") / tile).cast("int").alias("y"), "row", "col", F.col("elevation").cast("double").alias("elevation"))

    def run(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        x, y = (int(k) for k in key)
        a = np.full((tile, tile), np.nan)
        a[some["row"] - y * tile, some["col"] - x * tile] = some["elevation"].to_numpy(float, na_value=np.nan)
        store, path = fs.FileSystem.from_uri(f"{root.rstrip('/')}/{zoom}/{x}")
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{y}.png") as out:
            out.write(png(coded(a)))
        return pd.DataFrame({"n": [1]})

    return placed.groupBy("x", "y").applyInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def tile_range(box: tuple[float, float, float, float], zoom: int) -> tuple[range, range]:
    """Columns and rows of the tiles that a box (west, south, east, north) in degrees needs."""
    west, south, east, north = box
    n = 2**zoom

    def across(lon: float) -> int:
        return min(max(math.floor((lon + 180) / 360 * n), 0), n - 1)

    def down(lat: float) -> int:
        return min(max(math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n), 0), n - 1)

    return range(across(west), across(east) + 1), range(down(north), down(south) + 1)


def read_tiles(spark: SparkSession, root: str, zoom: int, box: tuple[float, float, float, float]) -> DataFrame:
    """Image rows of the tiles that the box needs: their folders and names are told to the reader, so that no other file is listed or opened.

    Tiles that aren't there are left out; if none is, there are no rows.
    """
    xs, ys = tile_range(box, zoom)
    if not len(xs) or not len(ys):
        return spark.createDataFrame([], IMAGE)
    names = [",".join(map(str, r)) for r in (xs, ys)]
    try:
        return spark.read.format("image").load(f"{root.rstrip('/')}/{zoom}/{{{names[0]}}}/{{{names[1]}}}.png")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], IMAGE)


IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def elevations(spark: SparkSession, root: str, zoom: int, box: tuple[float, float, float, float], tile: int = 256) -> DataFrame:
    """(row, col, elevation) of the box's tiles, as pixels of the whole map."""
    return pixels(read_tiles(spark, root, zoom, box), tile).select("row", "col", terrarium("r", "g", "b").alias("elevation"))
