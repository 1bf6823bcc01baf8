"""Calendar columns: the 366-day year, season labels, month predicates and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAIN_YEAR_START, RAIN_SEASON_START = 7, 10
SEASON_MONTHS, CORE_MONTHS = (10, 11, 12, 1, 2, 3), (11, 12, 1, 2, 3)


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_leap(date: str | Column) -> Column:
    return F.dayofyear(F.make_date(F.year(_col(date)), F.lit(12), F.lit(31))) == 366


def leap_day_of_year(date: str | Column) -> Column:
    """The day's number in a year that always has 29 February: 1 March is 61, 31 December 366."""
    d = _col(date)
    return F.dayofyear(d) + F.when((F.month(d) > 2) & ~is_leap(d), 1).otherwise(0)


def season_of(date: str | Column, start_month: int = RAIN_YEAR_START) -> Column:
    """The year in which the day's season began, for seasons of twelve months from start_month."""
    d = _col(date)
    return F.year(d) - F.when(F.month(d) < start_month, 1).otherwise(0)


def season_text(season: str | Column) -> Column:
    """2023 as 2023/24."""
    s = _col(season)
    return F.when(s.isNotNull(), F.format_string("%d/%02d", s.cast("int"), F.pmod(s.cast("int") + 1, F.lit(100))))


def in_months(date: str | Column, months: tuple[int, ...] = SEASON_MONTHS) -> Column:
    return F.month(_col(date)).isin(*months)


def days_in_month(date: str | Column) -> Column:
    return F.day(F.last_day(_col(date)))


def within(value: str | Column, low: object = None, high: object = None) -> Column:
    """Inclusive bounds, each of which may be open."""
    out = F.lit(True)
    if low is not None:
        out &= _col(value) >= low
    if high is not None:
        out &= _col(value) <= high
    return out


def signed_text(value: str | Column, decimals: int = 0, unit: str = "%") -> Column:
    """A number with its sign and unit, rounded half to even; never -0 and no sign on a zero."""
    rounded = F.bround(_col(value).cast("double"), decimals)
    return F.when(rounded.isNull(), None).when(rounded == 0, F.format_string(f"%.{decimals}f{unit.replace('%', '%%')}", F.abs(rounded))).otherwise(F.format_string(f"%+.{decimals}f{unit.replace('%', '%%')}", rounded))


def degree_text(lon: str | Column, lat: str | Column) -> Column:
    """Latitude, then longitude, as 9.95° S, 33.35° E."""
    lon, lat = _col(lon), _col(lat)
    return F.format_string("%.2f° %s, %.2f° %s", F.abs(lat), F.when(lat < 0, "S").otherwise("N"), F.abs(lon), F.when(lon < 0, "W").otherwise("E"))


def number(column: str | Column) -> Column:
    """A double with NaN as null: missing values are nulls throughout this library."""
    c = _col(column).cast("double")
    return F.when(~F.isnan(c), c)
