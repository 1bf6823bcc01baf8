"""Trends of many yearly series at once: rows (series, year, value), values null where missing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as cal
from ..functions.distributions import kendall_p_value, t_critical, t_p_value
from ..functions.pairs import Slopes, concordance

KEY = ("series",)


def annual_series(table: DataFrame, value: str = "jd", keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """Years with a value in the annual column, as (keys, year, value)."""
    return table.where(F.col(value).isNotNull()).select(*keys, "year", F.col(value).alias("value"))


def linear_trend(rows: DataFrame, start: int | None = None, end: int | None = None, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Least squares by series: first and last year, slope and 95% half-width a decade, two-sided p, R squared, total change.

    One aggregation; only the t distribution needs Python, on a row a series. Series of fewer than 3 values have null
    statistics. A constant series has R squared 0.
    """
    used = rows.where(cal.within("year", start, end) & F.col("value").isNotNull())
    x, y = F.col("year").cast("double"), F.col("value").cast("double")
    sums = used.groupBy(*keys).agg(F.count("*").alias("n"), F.min("year").alias("start"), F.max("year").alias("end"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    enough = F.col("n") >= 3
    slope = F.when(enough, F.try_divide("sxy", "sxx"))
    df = F.col("n") - 2
    rest = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    out = sums.withColumn("_slope", slope).withColumn("_err", F.when(enough, F.sqrt(F.try_divide(F.try_divide(rest, df), F.col("sxx")))))
    r2 = F.when(enough, F.coalesce(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")), F.lit(0.0)))
    t = F.when(F.col("_err") > 0, F.col("_slope") / F.col("_err")).otherwise(F.when(F.col("_slope") == 0, 0.0).otherwise(F.when(enough, F.lit(float("inf")))))
    return out.select(
        *keys, "n", "start", "end", (F.col("_slope") * 10).alias("slope_per_decade"), (t_critical(F.when(enough, df)) * F.col("_err") * 10).alias("ci95_per_decade"),
        t_p_value(t, F.when(enough, df)).alias("p_value"), r2.alias("r_squared"), (F.col("_slope") * (F.col("end") - F.col("start"))).alias("total_change"),
    )


def fit_one(rows: DataFrame, start: int | None = None, end: int | None = None) -> dict:
    """The trend of a single series; ValueError below 3 values."""
    got = linear_trend(rows.withColumn("_one", F.lit(1)), start, end, ("_one",)).first()
    if got is None or got["n"] < 3:
        raise ValueError("a trend needs at least 3 values")
    return {k: v for k, v in got.asDict().items() if k != "_one"}


def rolling_trend(rows: DataFrame, window: int = 30, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, year, trend): slope a decade of the last `window` rows with a value, by the year in which they end."""
    used = rows.where(F.col("value").isNotNull())
    w = Window.partitionBy(*keys).orderBy("year").rowsBetween(1 - window, 0)
    # Years are counted from the frame's own place, so that sums of squares stay small.
    x = F.col("year").cast("double") - 1950.0
    return used.withColumn("trend", F.regr_slope(F.col("value"), x).over(w) * 10).withColumn("_n", F.count("*").over(w)).where(F.col("_n") == window).select(*keys, "year", "trend")


def breakpoint(rows: DataFrame, min_segment: int = 15, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The hinge a + b x + c max(0, x - k) of least squared error over all inner years k, the earliest on ties.

    For each k the normal equations need only sums over the later rows of 1, x, x squared, y and x y: one growing window in
    descending order. x is centred by series. Series without an inner year give no row.
    """
    used = rows.where(F.col("value").isNotNull()).select(*keys, "year", F.col("value").alias("y"))
    part = Window.partitionBy(*keys)
    x = used.withColumn("x", F.col("year") - F.avg("year").over(part)).withColumn("_i", F.row_number().over(part.orderBy("year"))).withColumn("_n", F.count("*").over(part))
    for name, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("sxy", F.col("x") * F.col("y")), ("syy", F.col("y") * F.col("y"))):
        x = x.withColumn(name, F.sum(e).over(part))
    after = part.orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, -1)
    for name, e in (("t0", F.lit(1.0)), ("t1", F.col("x")), ("t2", F.col("x") * F.col("x")), ("u0", F.col("y")), ("u1", F.col("x") * F.col("y"))):
        x = x.withColumn(name, F.coalesce(F.sum(e).over(after), F.lit(0.0)))
    inner = x.where((F.col("_i") > min_segment) & (F.col("_i") <= F.col("_n") - min_segment))
    k = F.col("x")
    h, hh = F.col("t1") - k * F.col("t0"), F.col("t2") - 2 * k * F.col("t1") + k * k * F.col("t0")
    xh, yh = F.col("t2") - k * F.col("t1"), F.col("u1") - k * F.col("u0")
    n = F.col("_n")
    # Centred second moments: x against itself, against h and so on.
    cols = {"cxx": F.col("sxx") - F.col("sx") * F.col("sx") / n, "chh": hh - h * h / n, "cxh": xh - F.col("sx") * h / n, "cxy": F.col("sxy") - F.col("sx") * F.col("sy") / n, "chy": yh - h * F.col("sy") / n, "cyy": F.col("syy") - F.col("sy") * F.col("sy") / n}
    inner = inner.withColumns(cols)
    det = F.col("cxx") * F.col("chh") - F.col("cxh") * F.col("cxh")
    b = F.try_divide(F.col("cxy") * F.col("chh") - F.col("chy") * F.col("cxh"), det)
    c = F.try_divide(F.col("chy") * F.col("cxx") - F.col("cxy") * F.col("cxh"), det)
    inner = inner.withColumn("b", b).withColumn("c", c)
    sse = F.greatest(F.col("cyy") - F.col("b") * F.col("cxy") - F.col("c") * F.col("chy"), F.lit(0.0))
    line = F.greatest(F.col("cyy") - F.try_divide(F.col("cxy") * F.col("cxy"), F.col("cxx")), F.lit(0.0))
    best = inner.groupBy(*keys).agg(F.min_by(F.struct("year", "b", "c", sse.alias("sse"), line.alias("line")), F.struct(F.round(sse, 12), F.col("year"))).alias("z"))
    return best.select(*keys, F.col("z.year").alias("year"), (F.col("z.b") * 10).alias("slope_before"), ((F.col("z.b") + F.col("z.c")) * 10).alias("slope_after"), F.col("z.sse").alias("sse"), F.col("z.line").alias("sse_line"), F.try_divide(F.col("z.b") + F.col("z.c"), F.col("z.b")).alias("acceleration"))


SEN = "n long, start int, end int, slope double, low double, high double, s double, variance double, ties boolean"


def _sen(values: pd.DataFrame, z: float = 1.959963984540054) -> tuple:
    """Theil-Sen and Mann-Kendall of one series (year, value), without the p-value."""
    v = values.sort_values("year")
    x, y = v["year"].to_numpy(float), v["value"].to_numpy(float)
    n = len(x)
    if n < 2:
        return n, int(x[0]) if n else None, int(x[-1]) if n else None, None, None, None, None, None, None
    slopes, s = Slopes(x, y), float(concordance(x, y))

    def tied(a: np.ndarray) -> np.ndarray:
        c = np.unique(a, return_counts=True)[1].astype(float)
        return c[c > 1]

    ty, tx, m = tied(y), tied(x), n * (n - 1.0)
    interval = (m * (2 * n + 5) - sum(k * (k - 1) * (2 * k + 5) for k in (*tx, *ty))) / 18
    v0 = (m * (2 * n + 5) - (ty * (ty - 1) * (2 * ty + 5)).sum() - (tx * (tx - 1) * (2 * tx + 5)).sum()) / 18
    v1 = (tx * (tx - 1)).sum() * (ty * (ty - 1)).sum() / (2 * m)
    v2 = (tx * (tx - 1) * (tx - 2)).sum() * (ty * (ty - 1) * (ty - 2)).sum() / (9 * m * max(n - 2, 1))
    middle = low = high = None
    if slopes.n:
        reach = z * np.sqrt(max(interval, 0.0))
        middle = slopes.median()
        low = slopes[max(int(np.round((slopes.n - reach) / 2)) - 1, 0)]
        high = slopes[min(int(np.round((slopes.n + reach) / 2)), slopes.n - 1)]
    return n, int(x[0]), int(x[-1]), middle, low, high, s, float(v0 + v1 + v2), bool(len(ty) or len(tx))


def sen_stats(rows: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, SEN): a row a series with a value.

    A series is a group of its years, of any number: S counts inversions and the slopes are selected, in O(n log n) and without
    the n squared / 2 pairs. The scale is the number of series, which Spark partitions.
    """
    used = rows.where(F.col("value").isNotNull()).select(*keys, "year", F.col("value").cast("double").alias("value"))
    schema = ", ".join(f"{k} {used.schema[k].dataType.simpleString()}" for k in keys) + ", " + SEN
    names = [c.split()[0] for c in SEN.split(", ")]

    def run(key: tuple, values: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *_sen(values))], columns=[*keys, *names])

    return used.groupBy(*keys).applyInPandas(run, schema)


def sen_trend(rows: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Theil-Sen slope a decade with its 95% interval, and Mann-Kendall's p: a row a series."""
    p = kendall_p_value("s", "n", "variance", "ties")
    return sen_stats(rows, keys).select(*keys, "n", "start", "end", (F.col("slope") * 10).alias("slope_per_decade"), (F.col("low") * 10).alias("ci95_low"), (F.col("high") * 10).alias("ci95_high"), p.alias("p_value")).withColumn("significant", F.col("p_value") < 0.05)


def sen_slope(rows: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, slope_per_decade, s): the slope and Mann-Kendall's S; series without a pair of years give no row."""
    return sen_stats(rows, keys).where("slope is not null").select(*keys, (F.col("slope") * 10).alias("slope_per_decade"), "s")


def sen_line(rows: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, year, value, fitted): the Theil-Sen line, its intercept the median of value - slope year. A slope a series joins the rows."""
    slopes = sen_stats(rows, keys).where("slope is not null").select(*keys, F.col("slope").alias("_b"))
    used = rows.where(F.col("value").isNotNull()).join(slopes, [*keys])
    a = F.median(F.col("value") - F.col("_b") * F.col("year")).over(Window.partitionBy(*keys))
    return used.withColumn("_a", a).select(*keys, "year", "value", (F.col("_a") + F.col("_b") * F.col("year")).alias("fitted"))


def index_trends(table: DataFrame, indices: Sequence[str], keys: tuple[str, ...] = ("location",), at: str = "year") -> DataFrame:
    """Sen trends of many index columns as one table, keyed by `index` too."""
    long = table.select(*keys, F.col(at).alias("year"), *(F.col(i).cast("double").alias(i) for i in indices)).unpivot([*keys, "year"], list(indices), "index", "value")
    return sen_trend(long, (*keys, "index"))


def season_trends(table: DataFrame, seasons: Sequence[str] = ("djf", "mam", "jja", "son"), start: int | None = None, end: int | None = None, keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """Linear trends of season columns, with the fastest season of each key marked."""
    long = table.select(*keys, "year", *seasons).unpivot([*keys, "year"], list(seasons), "season", "value")
    out = linear_trend(long, start, end, (*keys, "season"))
    fastest = F.max_by("season", F.struct("slope_per_decade", "season")).over(Window.partitionBy(*keys))
    return out.withColumn("fastest", F.col("season") == fastest)


def rolling_mean(rows: DataFrame, window: int = 10, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, year, mean) centred on the row, full windows only; an even window reaches one further back."""
    w = Window.partitionBy(*keys).orderBy("year").rowsBetween(-(window // 2), window - 1 - window // 2)
    return rows.withColumn("mean", F.when(F.count("value").over(w) == window, F.avg("value").over(w))).select(*keys, "year", "mean")


def warmest_years(rows: DataFrame, n: int = 10, keys: tuple[str, ...] = KEY) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("value"), "year")
    return rows.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*keys, "rank", "year", "value")


def records_lately(rows: DataFrame, n: int = 10, years: int = 10, keys: tuple[str, ...] = KEY) -> DataFrame:
    """How many of the n warmest years lie within the last `years` years of the series."""
    last = rows.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.max("year").alias("_last"))
    return warmest_years(rows, n, keys).join(last, [*keys]).groupBy(*keys).agg(F.count_if(F.col("year") > F.col("_last") - years).alias("records"))


def decade_means(rows: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Means of decades with ten values, and the change from the one listed before."""
    decade = (F.floor(F.col("year") / 10) * 10).cast("int")
    means = rows.groupBy(*keys, decade.alias("decade")).agg(F.avg("value").alias("mean"), F.count("value").alias("_n")).where(F.col("_n") == 10).drop("_n")
    return means.withColumn("change", F.col("mean") - F.lag("mean").over(Window.partitionBy(*keys).orderBy("decade")))


def change_since(rows: DataFrame, reference: tuple[int, int] = (1880, 1900), recent: int = 10, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The mean of the last `recent` values less the mean of the reference years."""
    used = rows.where(F.col("value").isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("year"))))
    return used.groupBy(*keys).agg((F.avg(F.when(F.col("_r") <= recent, F.col("value"))) - F.avg(F.when(cal.within("year", *reference), F.col("value")))).alias("change"))


def headline(rows: DataFrame, recent_start: int, window: int = 30, min_segment: int = 15, keys: tuple[str, ...] = KEY) -> DataFrame:
    """A row a series: long-term and recent rates and their ratio, the hinge's gain and speed-up, the latest rolling rate, recent records."""
    k = [*keys]
    full = linear_trend(rows, keys=keys).select(*k, F.col("slope_per_decade").alias("long_term"))
    late = linear_trend(rows, recent_start, keys=keys).select(*k, F.col("slope_per_decade").alias("recent"))
    hinge = breakpoint(rows, min_segment, keys).select(*k, F.col("year").alias("break_year"), (1 - F.try_divide("sse", "sse_line")).alias("hinge_gain"), F.when(F.col("slope_before") > 0, F.col("acceleration")).alias("speed_up"))
    latest = rolling_trend(rows, window, keys).groupBy(*k).agg(F.max_by("trend", "year").alias("latest_rolling"))
    out = full.join(late, k, "left").join(hinge, k, "left").join(latest, k, "left").join(records_lately(rows, keys=keys), k, "left")
    return out.withColumn("rate_ratio", F.try_divide("recent", "long_term"))
