"""Geographic columns: web-map tiles, an ellipsoidal equal-area projection, raster addressing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import _col

# The WGS84 ellipsoid.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)


def tile_x(lon: str | Column, zoom: int) -> Column:
    return (_col(lon) + 180.0) / 360.0 * float(2**zoom)


def tile_y(lat: str | Column, zoom: int) -> Column:
    return (1.0 - F.asinh(F.tan(F.radians(_col(lat)))) / math.pi) / 2.0 * float(2**zoom)


def terrarium(r: str | Column, g: str | Column, b: str | Column) -> Column:
    """Metres from the three channels of an elevation tile."""
    return _col(r) * 256.0 + _col(g) + _col(b) / 256.0 - 32768.0


def in_box(lon: str | Column, lat: str | Column, west: float, south: float, east: float, north: float, margin: float = 0.0) -> Column:
    return _col(lon).between(west - margin, east + margin) & _col(lat).between(south - margin, north + margin)


def _q(sin: Column) -> Column:
    """Snyder's q of a latitude's sine."""
    s = sin * E
    return (1 - E2) * (sin / (1 - s * s) + F.log((1 + s) / (1 - s)) / (2 * E))


def _q_of(lat: float) -> float:
    sin = math.sin(math.radians(lat))
    s = E * sin
    return (1 - E2) * (sin / (1 - s * s) + math.log((1 + s) / (1 - s)) / (2 * E))


@dataclass(frozen=True)
class EqualArea:
    """Lambert's azimuthal equal-area projection on WGS84 (Snyder 1987, with authalic latitudes), centred at (lon, lat)."""

    lon: float
    lat: float

    def _constants(self) -> tuple[float, float, float, float, float]:
        qp, phi = _q_of(90.0), math.radians(self.lat)
        beta = math.asin(_q_of(self.lat) / qp)
        rq = A * math.sqrt(qp / 2)
        d = A * math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2) / (rq * math.cos(beta))
        return qp, math.sin(beta), math.cos(beta), rq, d

    def forward(self, lon: str | Column, lat: str | Column) -> tuple[Column, Column]:
        qp, s1, c1, rq, d = self._constants()
        sb = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _q(F.sin(F.radians(_col(lat)))) / qp))
        cb = F.sqrt(1 - sb * sb)
        dl = F.radians(_col(lon) - self.lon)
        b = rq * F.sqrt(2 / (1 + s1 * sb + c1 * cb * F.cos(dl)))
        return b * d * cb * F.sin(dl), b / d * (c1 * sb - s1 * cb * F.cos(dl))

    def inverse(self, x: str | Column, y: str | Column) -> tuple[Column, Column]:
        """Degrees (lon, lat) of a place on the plane; not numbers beyond the disc that the ellipsoid fills there."""
        _, s1, c1, rq, d = self._constants()
        x, y = _col(x), _col(y)
        rho = F.sqrt((x / d) * (x / d) + (y * d) * (y * d))
        ce = 2 * F.asin(rho / (2 * rq))
        at_centre = rho < 1e-9
        sb = F.when(at_centre, F.lit(s1)).otherwise(F.cos(ce) * s1 + d * y * F.sin(ce) * c1 / F.when(at_centre, F.lit(1.0)).otherwise(rho))
        # Rounding alone may carry the sine beyond 1; not a number, which Spark takes for the largest, stays one.
        beta = F.asin(F.when(F.isnan(sb), sb).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sb))))
        # Snyder's series from authalic to geodetic latitude, good to about a centimetre.
        e4, e6 = E2**2, E2**3
        phi = beta + (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
        lon = F.lit(self.lon) + F.degrees(F.atan2(x * F.sin(ce), d * rho * c1 * F.cos(ce) - d * d * y * s1 * F.sin(ce)))
        return F.when(at_centre, F.lit(self.lon)).otherwise(lon), F.degrees(phi)


@dataclass(frozen=True)
class Grid:
    """A north-up raster in metres: (west, north) is the outer corner of cell (0, 0)."""

    west: float
    north: float
    resolution: float
    width: int
    height: int

    @property
    def cell_km2(self) -> float:
        return self.resolution**2 / 1e6

    def pixel(self, x: str | Column, y: str | Column) -> tuple[Column, Column]:
        """Fractional (row, col)."""
        return (self.north - _col(y)) / self.resolution, (_col(x) - self.west) / self.resolution

    def xy(self, row: str | Column, col: str | Column) -> tuple[Column, Column]:
        return self.west + _col(col) * self.resolution, self.north - _col(row) * self.resolution

    def cell(self, row: str | Column, col: str | Column) -> tuple[Column, Column]:
        """The cell of a fractional place, clamped to the grid."""
        return F.greatest(F.lit(0), F.least(F.lit(self.height - 1), _col(row).cast("int"))), F.greatest(F.lit(0), F.least(F.lit(self.width - 1), _col(col).cast("int")))
