"""Domain views over the driver's tables: the same text for Spark and for the oracles, but for two views with arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.daily import by_location, spine

BASE, RECENT, BASE_SEASONS = (1996, 1999), (1999, 2001), (1996, 1999)

# A location for every twenty suppliers, a series for every priority and three hundred customers, a cell for every supplier: the keys
# grow with the tables. A day's values come from the lowest and highest price of its rows, so that they vary as much at any scale.
DAILY_RAW = """
select cast(floor(l_suppkey / 20) as int) as location, cast(l_shipdate as date) as date,
 15 + cast(min(cast(round(l_extendedprice * 100) as bigint)) % 2000 as double) / 100 as tmax,
 2 + cast(max(cast(round(l_extendedprice * 100) as bigint)) % 1700 as double) / 100 as tmin,
 cast(greatest(min(cast(round(l_extendedprice * 100) as bigint)) % 61 - 25, 0) as double) as prcp
from {lineitem} group by floor(l_suppkey / 20), cast(l_shipdate as date)"""
SERIES = """
select concat(o_orderpriority, ' ', cast(cast(floor(o_custkey / 300) as int) as {string})) as series, cast(1880 + (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 as int) as year,
 cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / count(*) / 1000000 as value
from {orders} group by o_orderpriority, floor(o_custkey / 300), year(o_orderdate), month(o_orderdate)"""
# Latitudes of 41 rows, dealt so that both halves have cells at any scale; further suppliers lie further east.
MONTHLY = """
select cast(date_trunc('month', l_shipdate) as date) as month,
 cast(-8 as double) - (cast(floor(l_suppkey / 10) as bigint) * 23 % 41) * 0.25e0 as lat, 22 + cast(l_suppkey % 10 as double) * 0.25e0 + floor(l_suppkey / 410) * 2.5e0 as lon,
 20 + cast(sum(cast(round(l_discount * 100) as bigint)) as double) / count(*) as t2m,
 cast(sum(cast(l_quantity as bigint)) as double) / count(*) / 5 as precip
from {lineitem} group by date_trunc('month', l_shipdate), l_suppkey"""
POINTS = """
select c_custkey as name, 22 + cast(c_custkey % 1200 as double) / 100 as lon, cast(c_custkey % 997 as double) / 100 - 18 as lat
from {customer}"""

DUCK = {
    "daily_raw": DAILY_RAW,
    "series": SERIES,
    "monthly": MONTHLY,
    "points": POINTS,
    "daily": """select s.location, s.date, tmax, tmin, coalesce(prcp, 0) as prcp from
 (select location, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from daily_raw group by location) s
 left join daily_raw r on r.location = s.location and r.date = s.date""",
    "raster": """select cast(vec_id as int) as row, cast(i - 1 as int) as col, 1200 + 1500 * cast(embedding[i] as double) as elevation, label <> 0 as inside
 from (select vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)""",
}
NEEDS = {"daily": ("daily_raw",)}
TABLES = ("lineitem", "orders", "customer")


def ctes(*names: str) -> str:
    """The WITH clause of the views that an oracle needs, and what they need."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    return "with " + ", ".join(f"{n} as ({DUCK[n].format(**{t: t for t in TABLES}, string='varchar')})" for n in order)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, **given: DataFrame) -> DataFrame:
    return spark.sql(text.replace("{string}", "string"), **{t: given[t] if t in given else table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})


#: Rows of lineitem that a task of the daily views has, about.
TASK_ROWS = 1_000_000


def _daily_tasks(spark: SparkSession, sf_dir: str) -> int:
    """As many tasks as the table's rows want, told by the files' footers: a task's memory then doesn't grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS))


def daily_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").repartition(_daily_tasks(spark, sf_dir), F.expr("floor(l_suppkey / 20)"))
    return _sql(spark, sf_dir, DAILY_RAW, lineitem=rows)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine(by_location(daily_raw(spark, sf_dir), partitions=_daily_tasks(spark, sf_dir)))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SERIES)


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, MONTHLY)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, POINTS)


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("row"), (F.col("label") != 0).alias("inside"), F.posexplode("embedding").alias("col", "v"))
    return rows.select("row", "col", (1200 + 1500 * F.col("v").cast("double")).alias("elevation"), "inside")
