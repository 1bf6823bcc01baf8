"""Stepped classes, colour ramps and precipitation predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import _col

WET_MM, HEAVY_MM = 1.0, 20.0
# Class edges of rain anomalies (%), and heights (m) with their tints.
RAIN_EDGES = (-50.0, -35.0, -20.0, -5.0, 5.0, 20.0, 35.0, 50.0)
TEMPERATURE_EDGES = (-1.25, -0.75, -0.25, 0.25, 0.75, 1.25, 1.75, 2.25)
TINTS = (
    (300.0, "#1f5a46"),
    (550.0, "#3f7a52"),
    (800.0, "#7d9c5e"),
    (1000.0, "#b5b578"),
    (1150.0, "#d9cc94"),
    (1300.0, "#e6cf9e"),
    (1450.0, "#d4a877"),
    (1650.0, "#b5835c"),
    (1900.0, "#8f6450"),
    (2300.0, "#f1ebe3"),
)


def is_wet(prcp: str | Column) -> Column:
    return F.coalesce(_col(prcp) >= WET_MM, F.lit(False))


def is_dry(prcp: str | Column) -> Column:
    return F.coalesce(_col(prcp) < WET_MM, F.lit(False))


def is_heavy(prcp: str | Column) -> Column:
    return F.coalesce(_col(prcp) >= HEAVY_MM, F.lit(False))


def step_class(value: str | Column, edges: tuple[float, ...], missing: int | None = None) -> Column:
    """How many edges the value reaches: 0 below the first, len(edges) from the last on. A missing value has class `missing`."""
    v = _col(value)
    n = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= v))
    return F.when(v.isNotNull(), n).otherwise(F.lit(missing).cast("int"))


def band_of(value: str | Column, edges: tuple[float, ...]) -> Column:
    """The band [edge i, edge i + 1) of a value, from 0; the last band has its upper edge too; null outside."""
    v = _col(value)
    return F.when((v >= edges[0]) & (v <= edges[-1]), F.least(step_class(v, edges) - 1, F.lit(len(edges) - 2)))


def ramp(value: str | Column, stops: tuple[tuple[float, str], ...] = TINTS) -> Column:
    """(r, g, b) from 0 to 1, interpolated between stops and clamped at the ends."""
    v = _col(value)

    def channel(at: int) -> Column:
        level = [int(c[1 + 2 * at : 3 + 2 * at], 16) / 255.0 for _, c in stops]
        heights = [h for h, _ in stops]
        out = F.when(v <= heights[0], F.lit(level[0]))
        for h0, h1, l0, l1 in zip(heights, heights[1:], level, level[1:]):
            out = out.when(v <= h1, F.lit(l0) + (v - h0) * ((l1 - l0) / (h1 - h0)))
        return out.when(v > heights[-1], F.lit(level[-1]))

    return F.struct(*(channel(i).alias(c) for i, c in enumerate("rgb")))
