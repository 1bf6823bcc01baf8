"""Daily series of many locations: thresholds, exceedances, spells, yearly and rainy-season indices.

Every function takes rows keyed by `location` (or the given keys) and runs for all keys at once. Rows should lie on a
gapless calendar (see spine): spells and rolling sums go by rows, as their definitions do. Missing values are nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as cal
from ..functions.classes import is_dry, is_heavy, is_wet

KEY = ("location",)


def spine(daily: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Every day from the first to the last of all rows for each key; days that were absent have nulls, and prcp 0.

    A row is repeated up to the day before its key's next one, so that rows that lie together by keys stay so: no join, no exchange of days.
    Rows without a date go; of a key that is null all values are missing, as nothing equals it.
    """
    following = F.date_sub(F.lead("date").over(Window.partitionBy(*keys).orderBy("date")), 1)
    rows = daily.where(F.col("date").isNotNull()).withColumn("_from", F.col("date"))
    days = rows.withColumn("_to", F.coalesce(F.greatest(F.col("date"), following), F.col("date"))).withColumn("date", F.explode(F.sequence("_from", "_to")))
    own = F.col("date") == F.col("_from")
    for k in keys:
        own = own & F.col(k).isNotNull()
    values = [c for c in daily.columns if c not in (*keys, "date")]
    return days.select(*keys, "date", *((F.coalesce(F.when(own, F.col(c)), F.lit(0.0)) if c == "prcp" else F.when(own, F.col(c))).alias(c) for c in values))


def by_location(daily: DataFrame, keys: tuple[str, ...] = KEY, partitions: int | None = None) -> DataFrame:
    """The one large shuffle: later groupings and windows on these keys and more use its partitioning."""
    return daily.repartition(partitions, *keys) if partitions else daily.repartition(*keys)


def daily_percentile(daily: DataFrame, value: str, q: float, base: tuple[int, int], window: int = 5, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, doy, threshold): the q-th percentile of base years' values within window // 2 days on the ring of 366 days.

    Base rows with a value are gathered by calendar day once, as arrays; a day's pool is those of its neighbours, which a window over
    the days of a key puts together, so that no value is copied before it is dealt out. Days without a base row of their own have
    thresholds too, from their neighbours. Thresholds are rounded to 6 places, so that a comparison doesn't hang on the last bit
    of an interpolation.
    """
    half = window // 2
    rows = daily.where(cal.within(F.year("date"), *base) & F.col(value).isNotNull()).select(*keys, cal.leap_day_of_year("date").cast("int").alias("_d"), F.col(value).alias("_v"))
    days = rows.groupBy(*keys, "_d").agg(F.collect_list("_v").alias("_v"))
    # The ring: days within reach of its ends stand beyond the other end too.
    turns = F.array_compact(F.array(F.col("_d"), F.when(F.col("_d") <= half, F.col("_d") + 366), F.when(F.col("_d") > 366 - half, F.col("_d") - 366)))
    days = days.select(*keys, F.explode(turns).alias("_d"), "_v")
    order = Window.partitionBy(*keys).orderBy("_d")
    # Days that have no rows get empty arrays, from the day before them on.
    first = F.when(F.lag("_d").over(order).isNull(), F.col("_d") - half).otherwise(F.col("_d"))
    last = F.least(F.coalesce(F.lead("_d").over(order) - 1, F.col("_d") + half), F.lit(366 + half))
    days = days.select(*keys, "_d", "_v", first.alias("_a"), last.alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b")).alias("doy"), "_d", "_v")
    days = days.select(*keys, "doy", F.when(F.col("doy") == F.col("_d"), F.col("_v")).alias("_v"))
    pool = F.array_sort(F.flatten(F.collect_list("_v").over(Window.partitionBy(*keys).orderBy("doy").rangeBetween(-half, half))))
    pools = days.select(*keys, "doy", pool.alias("_p")).where(F.col("doy").between(1, 366) & (F.size("_p") > 0))
    at = (F.size("_p") - 1) * (q / 100.0)
    low = F.get("_p", F.floor(at).cast("int"))
    return pools.select(*keys, "doy", F.round(low + (at - F.floor(at)) * (F.coalesce(F.get("_p", F.floor(at).cast("int") + 1), low) - low), 6).alias("threshold"))


def exceedance(daily: DataFrame, thresholds: DataFrame, value: str, above: bool = True, keys: tuple[str, ...] = KEY, name: str = "flag") -> DataFrame:
    """daily with `name`, whether the value is strictly beyond its calendar day's threshold; false where either is missing.

    A key's thresholds meet its days as one array of 366, so that rows that lie together by keys stay so. A key has one threshold a day.
    """
    # The map is a lambda's argument, so that it is made once a key and not once a day.
    by_day = F.map_from_entries(F.collect_list(F.struct("doy", "threshold")))
    year = F.get(F.transform(F.array(by_day), lambda m: F.transform(F.sequence(F.lit(1), F.lit(366)), lambda d: F.try_element_at(m, d))), 0)
    years = thresholds.where(F.col("doy").isNotNull()).groupBy(*keys).agg(year.alias("_t"))
    threshold = F.get("_t", cal.leap_day_of_year("date") - 1)
    beyond = F.col(value) > threshold if above else F.col(value) < threshold
    return daily.join(years, [*keys], "left").withColumn(name, F.coalesce(beyond, F.lit(False))).drop("_t")


#: Days, or steps of a whole number, that a block of a series spans at most.
BLOCK = 512


def block_of(rows: DataFrame, order: str, size: int = BLOCK) -> Column:
    """The block of the order column that a row lies in; one block for what is neither a date, a time nor a number."""
    kind = rows.schema[order].dataType.typeName()
    at = F.unix_date(F.to_date(order)) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(order) if kind in ("byte", "short", "integer", "long", "float", "double") else None
    return F.lit(0).cast("long") if at is None else F.floor(at / size)


def spells(rows: DataFrame, flag: str | Column, min_length: int = 1, keys: tuple[str, ...] = KEY, order: str = "date", peak: str | None = None, block: int = BLOCK) -> DataFrame:
    """Runs of consecutive true rows: (keys, start, end, length[, peak]), `peak` being the largest of that column within the run.

    Runs are found within blocks of each series, where a run is told by the number of false rows before it, and those that touch a
    block's ends are joined: of a series only these, two a block at most, meet in one task. Rows without a place in the order come
    first. Where rows lie together by keys already, neither step deals them out again.
    """
    keys = tuple(keys)
    flag = F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))
    own = Window.partitionBy(*keys, "_block")
    marked = rows.withColumn("_f", flag).withColumn("_block", block_of(rows, order, block))
    false = F.sum(F.when(F.col("_f"), 0).otherwise(1))
    marked = marked.withColumn("_run", false.over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_last", false.over(own))
    held = F.col("_f")
    parts = [F.min(F.when(held, F.col(order))).alias("start"), F.max(F.when(held, F.col(order))).alias("end"), F.count_if(held).alias("length"), F.max(F.col("_run") == F.col("_last")).alias("_tail")]
    if peak:
        parts.append(F.max(F.when(held, F.col(peak))).alias("peak"))
    # A block's last run is kept also if it is empty: nothing goes on from there.
    pieces = marked.groupBy(*keys, "_block", "_run").agg(*parts).where((F.col("length") > 0) | F.col("_tail"))
    edge = F.col("_tail") | (F.col("_run") == 0)
    pieces = pieces.withColumn("_edge", edge).withColumn("_of", F.when(edge, F.lit(None).cast("long")).otherwise(F.col("_block")))
    line = Window.partitionBy(*keys, "_edge", "_of").orderBy("_block", "_run")
    goes_on = F.col("_edge") & (F.col("_run") == 0) & (F.col("length") > 0) & F.lag(F.col("_tail") & (F.col("length") > 0), 1, False).over(line)
    pieces = pieces.withColumn("_new", F.sum(F.when(goes_on, 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = [F.min("start").alias("start"), F.max("end").alias("end"), F.sum("length").cast("int").alias("length")] + ([F.max("peak").alias("peak")] if peak else [])
    return pieces.groupBy(*keys, "_edge", "_of", "_new").agg(*whole).where((F.col("length") > 0) & (F.col("length") >= min_length)).drop("_edge", "_of", "_new")


def heatwaves(daily: DataFrame, thresholds: DataFrame, min_length: int = 3, keys: tuple[str, ...] = KEY) -> DataFrame:
    return spells(exceedance(daily, thresholds, "tmax", True, keys), "flag", min_length, keys, peak="tmax")


def heatwave_years(events: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Events, days and the longest by the year in which they began."""
    return events.groupBy(*keys, F.year("start").alias("year")).agg(F.count("*").cast("int").alias("heatwave_events"), F.sum("length").cast("int").alias("heatwave_days"), F.max("length").alias("longest_heatwave"))


def yearly_extremes(daily: DataFrame, min_rows: int = 365, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, year, txx, tnn, days) of years with enough rows, with or without values."""
    return daily.groupBy(*keys, F.year("date").alias("year")).agg(F.max("tmax").alias("txx"), F.min("tmin").alias("tnn"), F.count("*").alias("days")).where(F.col("days") >= min_rows)


def annual_heat_indices(daily: DataFrame, base: tuple[int, int], hot: float = 90.0, cold: float = 10.0, keys: tuple[str, ...] = KEY, min_rows: int = 365) -> DataFrame:
    """Hot days and cold nights (% of rows), heatwave events, days and longest, txx and tnn, of complete years."""
    high, low = daily_percentile(daily, "tmax", hot, base, keys=keys), daily_percentile(daily, "tmin", cold, base, keys=keys)
    flagged = exceedance(exceedance(daily, high, "tmax", True, keys, "_hot"), low, "tmin", False, keys, "_cold")
    years = flagged.groupBy(*keys, F.year("date").alias("year")).agg(
        (F.avg(F.col("_hot").cast("double")) * 100).alias("hot_days_pct"), (F.avg(F.col("_cold").cast("double")) * 100).alias("cold_nights_pct"), F.max("tmax").alias("txx"), F.min("tmin").alias("tnn"), F.count("*").alias("_n")
    )
    events = heatwave_years(spells(flagged, "_hot", 3, keys, peak="tmax"), keys)
    out = years.where(F.col("_n") >= min_rows).join(events, [*keys, "year"], "left").fillna(0, ["heatwave_events", "heatwave_days", "longest_heatwave"])
    return out.select(*keys, "year", "hot_days_pct", "cold_nights_pct", "heatwave_events", "heatwave_days", "longest_heatwave", "txx", "tnn")


def wet_day_percentile(daily: DataFrame, base: tuple[int, int], q: float = 95.0, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, p): the percentile of wet days within base seasons (July to June)."""
    rows = daily.where(is_wet("prcp") & cal.within(cal.season_of("date"), *base))
    return rows.groupBy(*keys).agg(F.round(F.percentile("prcp", q / 100.0), 6).alias("p"))


def with_season(daily: DataFrame, start_month: int = cal.RAIN_YEAR_START) -> DataFrame:
    return daily.withColumn("season", cal.season_of("date", start_month))


def rain_totals(daily: DataFrame, base: tuple[int, int], min_rows: int = 365, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, season, total, wet, heaviest, heavy, very wet) of complete seasons; very wet is 0 where no day is."""
    p = wet_day_percentile(daily, base, keys=keys)
    rows = with_season(daily).join(p, [*keys], "left")
    out = rows.groupBy(*keys, "season").agg(
        F.round(F.sum("prcp"), 6).alias("total_mm"),
        F.count_if(is_wet("prcp")).cast("int").alias("wet_days"),
        F.max("prcp").alias("rx1day_mm"),
        F.count_if(is_heavy("prcp")).cast("int").alias("heavy_days"),
        F.round(F.coalesce(F.sum(F.when(F.col("prcp") > F.col("p"), F.col("prcp"))), F.lit(0.0)), 6).alias("very_wet_mm"),
        F.count("*").alias("days"),
    )
    return out.where(F.col("days") >= min_rows).drop("days")


def rolling_max_total(daily: DataFrame, days: int = 5, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, season, rx): the season's largest total of `days` rows of the season, all with values."""
    w = Window.partitionBy(*keys, "season").orderBy("date").rowsBetween(1 - days, 0)
    rows = with_season(daily).withColumn("_t", F.when(F.count("prcp").over(w) == days, F.sum("prcp").over(w)))
    return rows.groupBy(*keys, "season").agg(F.round(F.max("_t"), 6).alias(f"rx{days}day_mm"))


def longest_dry_spell(daily: DataFrame, months: tuple[int, ...] = cal.CORE_MONTHS, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, season, longest_dry_spell) over the season's rows of the given months; 0 without a dry day."""
    rows = with_season(daily).where(cal.in_months("date", months))
    found = spells(rows, is_dry("prcp"), 1, (*keys, "season")).groupBy(*keys, "season").agg(F.max("length").alias("longest_dry_spell"))
    return rows.select(*keys, "season").distinct().join(found, [*keys, "season"], "left").fillna(0, ["longest_dry_spell"])


def dry_spells(daily: DataFrame, start: str, end: str, min_length: int = 10, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Dry spells clipped to a window of dates."""
    return spells(daily.where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))), is_dry("prcp"), min_length, keys)


def _onset_marks(rows: DataFrame, by: list[str], start_month: int, rain_mm: float, over_days: int, dry: int, check_days: int) -> tuple[DataFrame, Column, Column]:
    """rows (by, date, prcp) with what the onset's two aggregates need, and those: the first sound candidate, and the first that ends the search.

    Windows are over a season's rows in order; rows before start_month count for nothing in them.
    """
    part = Window.partitionBy(*by).orderBy("_day")
    late = F.col("date") >= F.make_date("season", F.lit(start_month), F.lit(1))
    rain = F.when(late, F.col("prcp"))
    trailing = part.rowsBetween(1 - over_days, 0)
    total = F.when(F.count(rain).over(trailing) == over_days, F.round(F.sum(rain).over(trailing), 6))
    in_run = F.sum((late & is_dry("prcp")).cast("int")).over(part.rowsBetween(1 - dry, 0)) == dry
    rows = rows.withColumn("_day", F.datediff("date", F.lit("1970-01-01").cast("date"))).withColumn("_total", total).withColumn("_run", in_run)
    # A dry run lies within the days ahead if it ends there, at least `dry` days on.
    rows = rows.withColumn("_ahead", F.count("*").over(part.rangeBetween(1, check_days))).withColumn("_broken", F.coalesce(F.max("_run").over(part.rangeBetween(dry, check_days)), F.lit(False)))
    candidate = late & (F.col("_total") >= rain_mm)
    first = F.min(F.when(candidate & (F.col("_ahead") >= check_days) & ~F.col("_broken"), F.col("date")))
    stop = F.min(F.when(candidate & (F.col("_ahead") < check_days), F.col("date")))
    return rows, first, stop


def _onset(first: str = "_first", stop: str = "_stop") -> Column:
    return F.when(F.col(stop).isNull() | (F.col(first) < F.col(stop)), F.col(first))


def _onset_day(onset: str = "onset") -> Column:
    return F.datediff(onset, F.make_date("season", F.lit(10), F.lit(1)))


def rain_onset(daily: DataFrame, start_month: int = 10, rain_mm: float = 20.0, over_days: int = 3, dry: int = 10, check_days: int = 30, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, season, onset, onset_day): the first day, from start_month on, whose trailing total reaches rain_mm and which no
    dry spell of `dry` days follows within check_days.

    A day that qualifies by its total but has no check_days rows after it ends the season's search. All of it is window
    expressions over the season's rows from start_month on; seasons without an onset have nulls.
    """
    by = [*keys, "season"]
    rows = with_season(daily).where(F.col("date") >= F.make_date("season", F.lit(start_month), F.lit(1)))
    rows, first, stop = _onset_marks(rows, by, start_month, rain_mm, over_days, dry, check_days)
    out = rows.groupBy(*by).agg(first.alias("_first"), stop.alias("_stop")).select(*by, _onset().alias("onset"))
    return out.withColumn("onset_day", _onset_day())


def seasonal_rain_indices(daily: DataFrame, base: tuple[int, int], keys: tuple[str, ...] = KEY, min_rows: int = 365) -> DataFrame:
    """All rain indices of complete seasons (July to June): one sort of the daily rows by season and day serves the running totals,
    the dry runs and the onset, and one aggregation gathers all; only the wet days' percentile reads the rows once more."""
    by = [*keys, "season"]
    rows = with_season(daily).join(wet_day_percentile(daily, base, keys=keys), [*keys], "left")
    rows, first, stop = _onset_marks(rows, by, 10, 20.0, 3, 10, 30)
    part = Window.partitionBy(*by).orderBy("_day")
    five = part.rowsBetween(-4, 0)
    dry_core = cal.in_months("date", cal.CORE_MONTHS) & F.coalesce(is_dry("prcp"), F.lit(False))
    rows = rows.withColumn("_five", F.when(F.count("prcp").over(five) == 5, F.sum("prcp").over(five))).withColumn("_i", F.row_number().over(part))
    # A dry run's length so far: rows since the last that isn't dry, or not of the core months.
    rows = rows.withColumn("_dry", F.col("_i") - F.coalesce(F.max(F.when(~dry_core, F.col("_i"))).over(part.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("_days"), F.round(F.sum("prcp"), 6).alias("total_mm"), F.count_if(is_wet("prcp")).cast("int").alias("wet_days"), F.max("prcp").alias("rx1day_mm"),
        F.round(F.max("_five"), 6).alias("rx5day_mm"), F.count_if(is_heavy("prcp")).cast("int").alias("heavy_days"),
        F.round(F.coalesce(F.sum(F.when(F.col("prcp") > F.col("p"), F.col("prcp"))), F.lit(0.0)), 6).alias("very_wet_mm"),
        F.max("_dry").alias("longest_dry_spell"), first.alias("_first"), stop.alias("_stop"),
    ).where(F.col("_days") >= min_rows)
    out = out.withColumn("onset", _onset()).withColumn("onset_day", _onset_day())
    return out.select(*by, "total_mm", "wet_days", "rx1day_mm", "rx5day_mm", "heavy_days", "very_wet_mm", "longest_dry_spell", "onset", "onset_day")


def monthly_anomaly(daily: DataFrame, value: str, base: tuple[int, int], keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, year, month, anomaly): monthly means less the mean of the base years' monthly means of that month."""
    months = daily.groupBy(*keys, F.year("date").alias("year"), F.month("date").alias("month")).agg(F.avg(value).alias("mean"))
    w = Window.partitionBy(*keys, "month")
    normal = F.avg(F.when(cal.within("year", *base), F.col("mean"))).over(w)
    return months.select(*keys, "year", "month", (F.col("mean") - normal).alias("anomaly"))


def anomaly_table(anomalies: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """A row for each year, columns 1 to 12."""
    return anomalies.groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.first("anomaly"))


def compare_periods(rows: DataFrame, values: list[str], base: tuple[int, int], recent: tuple[int, int], keys: tuple[str, ...] = KEY, at: str = "year") -> DataFrame:
    """(keys, index, base_mean, recent_mean, ratio, change_pct) for each column."""
    long = rows.select(*keys, at, *(F.col(v).cast("double").alias(v) for v in values)).unpivot([*keys, at], values, "index", "value")
    means = long.groupBy(*keys, "index").agg(F.avg(F.when(cal.within(at, *base), F.col("value"))).alias("base_mean"), F.avg(F.when(cal.within(at, *recent), F.col("value"))).alias("recent_mean"))
    ratio = F.try_divide("recent_mean", "base_mean")
    return means.withColumn("ratio", ratio).withColumn("change_pct", (ratio - 1) * 100)


def rain_split(seasons: DataFrame, base: tuple[int, int], keys: tuple[str, ...] = KEY) -> DataFrame:
    """Each season's rain on very wet days and on others, and the base seasons' mean total."""
    mean = F.avg(F.when(cal.within("season", *base), F.col("total_mm"))).over(Window.partitionBy(*keys))
    return seasons.select(*keys, "season", "very_wet_mm", (F.col("total_mm") - F.col("very_wet_mm")).alias("other_mm"), mean.alias("base_total_mm"))


def mean_onset(onsets: DataFrame, low: int | None = None, high: int | None = None, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, mean_onset_day, mean_onset): the mean day after 1 October and its month-day."""
    means = onsets.where(cal.within("season", low, high)).groupBy(*keys).agg(F.avg("onset_day").alias("mean_onset_day"))
    return means.withColumn("mean_onset", F.date_format(F.date_add(F.lit("2000-10-01").cast("date"), F.bround("mean_onset_day").cast("int")), "MM-dd"))


def top(rows: DataFrame, n: int, *order: Column, keys: tuple[str, ...] = KEY, rank: str = "rank") -> DataFrame:
    """The first n rows of each key in the given order; give an order without ties."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def overlapping(events: DataFrame, windows: DataFrame, keys: tuple[str, ...] = KEY, days: int = 32) -> DataFrame:
    """Pairs of events and windows of one key that share a day, and how many. Columns start, end of windows become w_start, w_end.

    An equi-join on key and stretches of `days` days with the exact test after it: an interval is a row for each stretch that it lies in,
    one or two for most, and meets what is at most so far away. A pair is told in the stretch where its overlap begins. Give longer
    stretches for intervals of many years. Intervals that end before they start have no pairs.
    """
    def stretches(df: DataFrame, a: str, b: str) -> DataFrame:
        at = [F.floor(F.unix_date(F.to_date(c)) / days) for c in (a, b)]
        return df.where(F.col(a) <= F.col(b)).withColumn("_y", F.explode(F.sequence(*at)))

    other = windows.withColumnsRenamed({c: f"w_{c}" for c in windows.columns if c not in keys})
    left, right = stretches(events, "start", "end"), stretches(other, "w_start", "w_end")
    begin = F.greatest("start", "w_start")
    pairs = left.join(right, [*keys, "_y"]).where((F.col("end") >= F.col("w_start")) & (F.col("start") <= F.col("w_end")) & (F.floor(F.unix_date(F.to_date(begin)) / days) == F.col("_y"))).drop("_y")
    return pairs.withColumn("overlap_days", F.datediff(F.least("end", "w_end"), begin) + 1)
