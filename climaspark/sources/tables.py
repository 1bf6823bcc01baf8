"""Readers: anomaly tables, daily tables and JSON, shapes; every schema is told, and missing values become nulls at the door."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import number
from . import geojson

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ANOMALY_COLUMNS = (*MONTHS, "jd", "dn", "djf", "mam", "jja", "son")
DAILY = "location string, date date, tmax double, tmin double, prcp double"


def anomaly_tables(spark: SparkSession, path: str | list[str], keyed: bool = False) -> DataFrame:
    """(region, year, jan ... dec, jd, dn, djf, mam, jja, son) from CSV texts: a title line, a header, then a line a year.

    One read of all regions' files; region is the file's name without its ending, or that of a folder region=... that the
    file is in. With `keyed` files hold lines of many regions, each with its region before all else: for regions by the thousand,
    as a file costs more than its lines. Lines without a year go; what isn't a number is null.
    """
    columns = ("year", *ANOMALY_COLUMNS)
    raw = spark.read.schema(", ".join(f"{c} string" for c in (("region", *columns) if keyed else columns))).option("recursiveFileLookup", True).csv(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/region=([^/]+)/", 1)
    region = F.col("region") if keyed else F.when(folder != "", folder).otherwise(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^/.]*)?$", 1))
    rows = raw.select(region.alias("region"), *columns).where(F.trim("year").rlike(r"^\d+$"))
    return rows.select("region", F.trim("year").cast("int").alias("year"), *(F.expr(f"try_cast(trim(`{c}`) as double)").alias(c) for c in ANOMALY_COLUMNS))


def daily_payloads(payloads: DataFrame, text: str = "payload", keys: tuple[str, ...] = ("location",)) -> DataFrame:
    """Rows (keys, cell, date, tmax, tmin, prcp) from JSON texts of one cell's object, or of a list of them."""
    cell = "struct<daily:struct<time:array<string>,temperature_2m_max:array<double>,temperature_2m_min:array<double>,precipitation_sum:array<double>>>"
    whole = F.when(F.ltrim(text).startswith("["), F.col(text)).otherwise(F.concat(F.lit("["), F.col(text), F.lit("]")))
    rows = payloads.select(*keys, F.posexplode(F.from_json(whole, f"array<{cell}>")).alias("cell", "_c"))
    d = F.col("_c.daily")
    zipped = F.arrays_zip(d["time"].alias("time"), d["temperature_2m_max"].alias("tmax"), d["temperature_2m_min"].alias("tmin"), d["precipitation_sum"].alias("prcp"))
    return rows.select(*keys, "cell", F.explode(zipped).alias("_d")).select(*keys, "cell", F.to_date("_d.time").alias("date"), "_d.tmax", "_d.tmin", "_d.prcp")


def daily_table(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, form: str = "parquet", schema: str = DAILY) -> DataFrame:
    """A daily table between two dates, inclusive; the bounds go down to the scan. NaN values become nulls."""
    rows = spark.read.schema(schema).format(form).option("header", True).load(path)
    for bound, keep in ((start, lambda d, b: d >= b), (end, lambda d, b: d <= b)):
        if bound is not None:
            rows = rows.where(keep(F.col("date"), F.to_date(F.lit(bound))))
    return rows.select(*(number(c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def shapes(spark: SparkSession, path: str | list[str], name: str = "name") -> DataFrame:
    """(name, geometry) of GeoJSON feature collections' polygons and multipolygons, all as multipolygons; others are null. A large file is read in many tasks."""
    rows = geojson.features(spark, path, f"`{name}`:string")
    return rows.select(F.col("properties").getField(name).alias("name"), multipolygon(F.col("kind"), F.col("coordinates")).alias("geometry"))


def multipolygon(kind: Column, coordinates: Column, ring: str = "array<array<array<double>>>") -> Column:
    return F.when(kind == "Polygon", F.array(F.from_json(coordinates, ring))).when(kind == "MultiPolygon", F.from_json(coordinates, f"array<{ring}>"))
