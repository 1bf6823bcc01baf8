"""District means of cells that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import in_districts


def area_daily_stream(cells: DataFrame, districts: DataFrame, values: tuple[str, ...] = ("tmax", "tmin", "prcp"), late: str = "2 days") -> DataFrame:
    """(district, date, values) of a stream of cells (time, lat, lon, values): a day's mean is given out once the watermark has passed it.

    State is one running sum and count a district and open day; cells later than `late` are left out.
    """
    days = in_districts(cells.withWatermark("time", late), districts).groupBy("district", F.window("time", "1 day").alias("_w")).agg(*(F.bround(F.avg(v), 2).alias(v) for v in values))
    return days.select("district", F.to_date("_w.start").alias("date"), *values)
