"""The four analyses end to end: each takes tables and returns its result tables by name; write() stores them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import EqualArea, Grid
from ..operators import daily as D
from ..operators import grid as G
from ..operators import raster as R
from ..operators import trends as T
from ..sources import sinks

HEAT = ["hot_days_pct", "cold_nights_pct", "heatwave_events", "heatwave_days", "longest_heatwave", "txx", "tnn"]
RAIN = ["total_mm", "wet_days", "rx1day_mm", "rx5day_mm", "heavy_days", "very_wet_mm", "longest_dry_spell", "onset_day"]


def tuned(spark: SparkSession) -> SparkSession:
    """A table dealt by location stays so: joins and groupings on location and more keys don't deal it anew."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def extremes(daily: DataFrame, base: tuple[int, int], recent: tuple[int, int], partitions: int | None = None) -> dict[str, DataFrame]:
    """Heat and rain indices of every location and year, their trends, comparisons and rankings, from one deal of the daily table by location.

    The indices and the heatwaves, a few rows a year, are stored; all else derives from them.
    """
    tuned(daily.sparkSession)
    rows = D.by_location(daily, partitions=partitions)
    heat, rain = sinks.stored(D.annual_heat_indices(rows, base), "heat"), sinks.stored(D.seasonal_rain_indices(rows, base), "rain")
    waves = sinks.stored(D.heatwaves(rows, D.daily_percentile(rows, "tmax", 90, base)), "waves")
    trends = T.index_trends(heat, HEAT).unionByName(T.index_trends(rain, RAIN, at="season"))
    compared = D.compare_periods(heat, HEAT, base, recent).unionByName(D.compare_periods(rain, RAIN, base, recent, at="season"))
    return {
        "heat": heat, "rain": rain, "trends": trends, "comparison": compared,
        "longest_heatwaves": D.top(waves, 5, F.desc("length"), F.col("start")), "driest_seasons": D.top(rain, 5, F.col("total_mm"), F.col("season")),
        "longest_dry_spells": D.top(rain, 2, F.desc("longest_dry_spell"), F.col("season")), "compound": D.overlapping(waves, D.spells(rows, F.coalesce(F.col("prcp") < 1, F.lit(False)), 10)), "onset": D.mean_onset(rain, *recent),
    }


def seasons(monthly: DataFrame, weights: DataFrame, events: DataFrame, base: tuple[int, int]) -> dict[str, DataFrame]:
    """Season table with ranks and catalogue, monthly anomalies by region, and what the catalogue's seasons were like."""
    fields = sinks.stored(G.seasonal(monthly), "seasons")
    table = sinks.stored(G.flagged(G.ranked(G.season_table(fields, G.climatology(fields, base), weights)), events), "table")
    means = G.month_totals(G.area_means(monthly, ("precip", "t2m"), weights, ("month",)))
    anomalies = sinks.stored(G.monthly_anomalies(means, ("precip", "t2m"), base, ("region",)), "months")
    short = F.col("rain_mm") - F.col("normal_mm")
    by_month = {"catalogue_rain": G.month_table(anomalies, "precip", events, table, short), "catalogue_heat": G.month_table(anomalies, "t2m", events, table, "temp_anomaly")}
    shares = G.shortfall_share(anomalies.select("region", "month", F.col("precip").alias("anomaly")), table.select("season", "region", short.alias("anomaly_mm")))
    return {"seasons": table, "months": anomalies, "catalogue": G.catalogue_summary(table, events), **by_month, "shortfall": shares, "driest_others": G.driest_others(table, events), "missing": G.missing_events(events, table), "absent": G.absent_seasons(table)}


def long_term(series: DataFrame, recent_start: int, keys: tuple[str, ...] = T.KEY) -> dict[str, DataFrame]:
    """Trends, breakpoints, rolling rates, smoothed series, decades, warmest years and the headline row of every series."""
    rows = series.repartition(*keys)
    return {"trend": T.linear_trend(rows, keys=keys), "recent": T.linear_trend(rows, recent_start, keys=keys), "breakpoint": T.breakpoint(rows, keys=keys), "rolling": T.rolling_trend(rows, keys=keys), "smooth": T.rolling_mean(rows, keys=keys), "decades": T.decade_means(rows, keys), "warmest": T.warmest_years(rows, keys=keys), "change": T.change_since(rows, keys=keys), "headline": T.headline(rows, recent_start, keys=keys)}


def terrain(raster: DataFrame, grid: Grid, projection: EqualArea, places: DataFrame, lines: DataFrame, samples: int = 800) -> dict[str, DataFrame]:
    """Despiked elevation, its statistics and bands, elevations of places (name, lon, lat) and profiles along lines (name, x0, y0, x1, y1)."""
    clean = sinks.stored(R.despike_twice(raster, grid.height, grid.width), "elevation")
    masked = sinks.stored(clean.join(raster.select("row", "col", "inside"), ["row", "col"]), "masked")
    profiles = sinks.stored(R.profile(lines, masked, grid, samples), "profiles")
    return {"elevation": clean, "stats": R.elevation_stats(masked, grid.cell_km2, grid, projection), "bands": R.area_by_band(masked), "places": R.elevations_at(places, clean, grid, projection), "profiles": profiles, "features": R.profile_features(profiles)}


def write(tables: dict[str, DataFrame], path: str, places: int = 2) -> None:
    """Each table below path, doubles rounded half to even."""
    for name, table in tables.items():
        sinks.write_indices(table, f"{path.rstrip('/')}/{name}", places, by=None)
