"""Monthly latitude-longitude grids as rows (month, lat, lon, t2m, precip): seasons, normals, anomalies, area means and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as cal

CELL = ("lat", "lon")
# Seasons with an El Nino and its peak index; the latitude that parts north from south.
EL_NINO = {1982: 2.2, 1991: 1.7, 1997: 2.4, 2015: 2.6, 2023: 2.0}
PARTING_LATITUDE = -13.5


def catalogue(spark, peaks: dict[int, float] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((peaks or EL_NINO).items()), "season int, oni double")


def seasonal(monthly: DataFrame, months: tuple[int, ...] = cal.SEASON_MONTHS) -> DataFrame:
    """(season, lat, lon, rain, temp): rain is the sum of rate by days, temp the mean weighed by days.

    A season counts if all its months occur in the data; a cell without a value in one of them has null.
    """
    rows = monthly.where(cal.in_months("month", months)).withColumn("season", cal.season_of("month", months[0])).withColumn("_d", cal.days_in_month("month").cast("double"))
    n = len(months)

    def whole(value: str, total: Column) -> Column:
        return F.when(F.count(value) == n, total)

    cells = rows.groupBy(*CELL, "season").agg(
        whole("precip", F.sum(F.col("precip") * F.col("_d"))).alias("rain"),
        whole("t2m", F.try_divide(F.sum(F.col("t2m") * F.col("_d")), F.sum("_d"))).alias("temp"),
    )
    complete = monthly.where(cal.in_months("month", months)).select(cal.season_of("month", months[0]).alias("season"), "month").groupBy("season").agg(F.count_distinct("month").alias("_n")).where(F.col("_n") == n).select("season")
    # A row for each year of the calendar at most: small at any number of cells.
    return cells.join(F.broadcast(complete), "season").select("season", *CELL, "rain", "temp")


def climatology(seasons: DataFrame, base: tuple[int, int]) -> DataFrame:
    """(lat, lon, rain, temp) means over the base seasons; null where a season's value is missing. ValueError unless all base seasons are there."""
    used = seasons.where(cal.within("season", *base))
    need = base[1] - base[0] + 1
    if (found := used.select("season").distinct().count()) != need:
        raise ValueError(f"the baseline needs {need} complete seasons, there are {found}")
    return normals(used, need)


def normals(used: DataFrame, need: int) -> DataFrame:
    return used.groupBy(*CELL).agg(*(F.when(F.count(c) == need, F.avg(c)).alias(c) for c in ("rain", "temp")))


def monthly_anomalies(rows: DataFrame, values: tuple[str, ...], base: tuple[int, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, month, anomalies): value less the mean of its calendar month over base seasons (October to September)."""
    w = Window.partitionBy(*keys, F.month("month"))
    based = cal.within(cal.season_of("month", cal.RAIN_SEASON_START), *base)
    return rows.select(*keys, "month", *((F.col(v) - F.avg(F.when(based, F.col(v))).over(w)).alias(v) for v in values))


def weighted_mean(value: str | Column, weight: str | Column = "w") -> Column:
    """Sum of w x over sum of w, over the rows with a value; null without any weight."""
    x, w = (F.col(c) if isinstance(c, str) else c for c in (value, weight))
    return F.try_divide(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))


def halves(lat: str = "lat") -> Column:
    """Each cell's regions: the whole, and its half."""
    return F.array(F.lit("all"), F.when(F.col(lat) >= PARTING_LATITUDE, F.lit("north")).otherwise(F.lit("south")))


def area_means(rows: DataFrame, values: tuple[str, ...], weights: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, region, values): area means of north, south and all. Sums combine before the shuffle, however many cells a region has.

    weights is (lat, lon, w), a row a cell: Spark joins it by broadcast only if its size allows.
    """
    joined = rows.join(weights, [*CELL]).withColumn("region", F.explode(halves()))
    return joined.groupBy(*by, "region").agg(*(weighted_mean(v).alias(v) for v in values))


def cosine_weights(cells: DataFrame) -> DataFrame:
    """(lat, lon, w) with the cosine of latitude, for cells that are wholly inside."""
    return cells.select(*CELL).distinct().withColumn("w", F.cos(F.radians("lat")))


def season_table(seasons: DataFrame, normal: DataFrame, weights: DataFrame) -> DataFrame:
    """(season, region, rain_pct, temp_anomaly, rain_mm, normal_mm, normal_temp): ratios are taken after averaging."""
    n = normal.select(*CELL, F.col("rain").alias("_rain"), F.col("temp").alias("_temp"))
    rows = seasons.join(n, [*CELL]).join(weights, [*CELL]).withColumn("region", F.explode(halves()))
    out = rows.groupBy("season", "region").agg(weighted_mean("rain").alias("rain_mm"), weighted_mean("_rain").alias("normal_mm"), weighted_mean(F.col("temp") - F.col("_temp")).alias("temp_anomaly"), weighted_mean("_temp").alias("normal_temp"))
    return out.withColumn("rain_pct", (F.try_divide("rain_mm", "normal_mm") - 1) * 100)


def ranked(table: DataFrame) -> DataFrame:
    """The table with dry_rank (1 = driest) and heat_rank (1 = hottest) by region; ranks are permutations, ties by season, missing values last."""
    by = Window.partitionBy("region")
    return table.withColumn("dry_rank", F.row_number().over(by.orderBy(F.asc_nulls_last("rain_pct"), "season"))).withColumn("heat_rank", F.row_number().over(by.orderBy(F.desc_nulls_last("temp_anomaly"), "season")))


def flagged(table: DataFrame, events: DataFrame) -> DataFrame:
    """The table with the catalogue's index, and whether the season is in it. Spark broadcasts the catalogue if its size allows."""
    return table.join(events, "season", "left").withColumn("el_nino", F.col("oni").isNotNull())


def missing_events(events: DataFrame, table: DataFrame) -> DataFrame:
    """Catalogue seasons that the data lack."""
    return events.join(table.select("season").distinct(), "season", "left_anti")


def present_events(events: DataFrame, table: DataFrame) -> DataFrame:
    return events.join(table.select("season").distinct(), "season", "left_semi")


def driest_others(table: DataFrame, events: DataFrame, n: int = 5, region: str = "south") -> DataFrame:
    """Of the region's n driest seasons those without an El Nino; seasons without data come last."""
    driest = table.where(F.col("region") == region).orderBy(F.asc_nulls_last("rain_pct"), "season").limit(n)
    return driest.join(events, "season", "left_anti")


def month_table(anomalies: DataFrame, value: str, events: DataFrame, table: DataFrame, season_value: str | Column, months: tuple[int, ...] = cal.SEASON_MONTHS) -> DataFrame:
    """(season, region, a column a month in the season's order, season_value) for each catalogue season and region of the season table."""
    rows = anomalies.where(cal.in_months("month", months)).withColumn("season", cal.season_of("month", months[0])).join(events.select("season"), "season", "left_semi")
    wide = rows.withColumn("_m", F.month("month")).groupBy("season", "region").pivot("_m", list(months)).agg(F.first(value))
    own = F.col(season_value) if isinstance(season_value, str) else season_value
    return wide.join(table.select("season", "region", own.alias("season_value")), ["season", "region"])


def month_totals(means: DataFrame) -> DataFrame:
    """Monthly area means with precip, mm a day, as mm of the month."""
    return means.withColumn("precip", F.col("precip") * cal.days_in_month("month"))


def shortfall_share(anomalies: DataFrame, season_rain: DataFrame, least: float = 100.0, seasons: DataFrame | None = None) -> DataFrame:
    """(season, region, month, share): a month's anomaly over its season's, for seasons short by more than `least` mm; only for those of a catalogue, if one is given."""
    short = season_rain.where(F.col("anomaly_mm") < -least).select("season", "region", "anomaly_mm")
    if seasons is not None:
        short = short.join(seasons.select("season").distinct(), "season", "left_semi")
    rows = anomalies.withColumn("season", cal.season_of("month", cal.RAIN_SEASON_START))
    return rows.join(short, ["season", "region"]).select("season", "region", "month", F.try_divide("anomaly", "anomaly_mm").alias("share"))


def catalogue_summary(table: DataFrame, events: DataFrame) -> DataFrame:
    """One row: catalogue seasons, how many are drier than normal in the south, and their mean south and north anomalies."""
    rows = table.join(events, "season", "left_semi")
    south, north = F.col("region") == "south", F.col("region") == "north"
    return rows.agg(F.count_if(south).alias("seasons"), F.count_if(south & (F.col("rain_pct") < 0)).alias("drier"), F.avg(F.when(south, F.col("rain_pct"))).alias("south_pct"), F.avg(F.when(north, F.col("rain_pct"))).alias("north_pct"))


def extremes(table: DataFrame) -> DataFrame:
    """The driest, wettest, hottest and coolest season of each region."""
    def at(f, c: str) -> Column:
        return f("season", F.struct(F.col(c), F.col("season")))

    return table.groupBy("region").agg(at(F.min_by, "rain_pct").alias("driest"), at(F.max_by, "rain_pct").alias("wettest"), at(F.max_by, "temp_anomaly").alias("hottest"), at(F.min_by, "temp_anomaly").alias("coolest"))


def absent_seasons(table: DataFrame) -> DataFrame:
    """Seasons between the first and the last that the table lacks."""
    span = table.agg(F.min("season").alias("_a"), F.max("season").alias("_b")).where("_a is not null")
    return span.select(F.explode(F.sequence("_a", "_b")).alias("season")).join(table.select("season").distinct(), "season", "left_anti")


def area_above(field: DataFrame, weights: DataFrame, value: str, limit: float, by: tuple[str, ...]) -> DataFrame:
    """(by, share_above, everywhere): the share of weighted area above a limit; whether every cell with weight is."""
    rows = field.join(weights, [*CELL])
    x, w = F.col(value), F.col("w")
    return rows.groupBy(*by).agg((F.try_divide(F.sum(F.when(x > limit, w).otherwise(F.when(x.isNotNull(), 0.0))), F.sum(F.when(x.isNotNull(), w))) * 100).alias("share_above"), (F.min(F.when(w > 0, x)) > limit).alias("everywhere"))


#: Sides of the squares that boxes are covered by, as powers of two degrees.
SMALLEST, LARGEST = -6, 9


def codes_of(districts: DataFrame) -> DataFrame:
    """districts with (_ka, _kb, _a, _b): rectangles of two to the power _ka by _kb degrees, numbered, that cover each box (south, north, west, east).

    A side is at least half the box's, so that a box is nine rows at most (more only beyond LARGEST), whether it is a field or the world.
    Boxes without an inside, or with nulls, have no rows.
    """
    def level(low: str, high: str) -> Column:
        return F.greatest(F.lit(SMALLEST), F.least(F.lit(LARGEST), F.ceil(F.log2(F.greatest((F.col(high) - F.col(low)) / 2, F.lit(2.0**SMALLEST)))).cast("int")))

    def along(low: str, high: str, k: str) -> Column:
        side = F.pow(F.lit(2.0), F.col(k))
        return F.explode(F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side)))

    boxes = districts.where("south <= north and west <= east").withColumns({"_ka": level("south", "north"), "_kb": level("west", "east")})
    return boxes.withColumn("_a", along("south", "north", "_ka")).withColumn("_b", along("west", "east", "_kb"))


def in_districts(cells: DataFrame, districts: DataFrame) -> DataFrame:
    """cells with the district(s) whose box (south, north, west, east) they lie in, edges included; a stream of cells too.

    Boxes are a few rectangles each, of a size that goes with theirs; a cell meets the one that it lies in of every size in use, and the
    exact test follows. The sizes in use, some of 16 by 16, come to the driver. Neither side need be small.
    """
    boxes = codes_of(districts)
    sizes = sorted((r["_ka"], r["_kb"]) for r in boxes.select("_ka", "_kb").distinct().collect())
    own = F.array(*(F.struct(F.lit(a).alias("_ka"), F.lit(b).alias("_kb"), F.floor(F.col("lat") / 2.0**a).alias("_a"), F.floor(F.col("lon") / 2.0**b).alias("_b")) for a, b in sizes))
    own = own if sizes else F.array().cast("array<struct<_ka:int,_kb:int,_a:bigint,_b:bigint>>")
    rows = cells.withColumn("_code", F.explode(own)).select(*(F.col(c) for c in cells.columns), "_code.*")
    box = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    return rows.join(boxes, ["_ka", "_kb", "_a", "_b"]).where(box).drop("_ka", "_kb", "_a", "_b", "south", "north", "west", "east")


def area_daily(cells: DataFrame, districts: DataFrame, values: tuple[str, ...] = ("tmax", "tmin", "prcp")) -> DataFrame:
    """(district, date, values): plain means of the cells in each district's box, to 2 places half to even."""
    return in_districts(cells, districts).groupBy("district", "date").agg(*(F.bround(F.avg(v), 2).alias(v) for v in values))


def joined_fields(t2m: DataFrame, tp: DataFrame) -> DataFrame:
    """One monthly table of kelvin and metres a day as degrees and mm a day. ValueError if the two cover different months."""
    a, b = (d.select(F.trunc("time", "MM").alias("month")).distinct() for d in (t2m, tp))
    if a.exceptAll(b).unionByName(b.exceptAll(a)).limit(1).count():
        raise ValueError("the two variables cover different months")
    return normalised(t2m, tp)


def normalised(t2m: DataFrame, tp: DataFrame) -> DataFrame:
    left = t2m.select(F.trunc("time", "MM").alias("month"), *CELL, (F.col("t2m") - 273.15).alias("t2m"))
    right = tp.select(F.trunc("time", "MM").alias("month"), *CELL, (F.col("tp") * 1000.0).alias("precip"))
    return left.join(right, ["month", *CELL])
