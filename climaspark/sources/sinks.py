"""Writers of result tables, and the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rounded(table: DataFrame, places: int) -> DataFrame:
    """Doubles rounded half to even."""
    return table.select(*(F.bround(c, places).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes))


def write_indices(table: DataFrame, path: str, places: int, by: str | None = "location", form: str = "parquet") -> None:
    writer = rounded(table, places).write.mode("overwrite").option("header", True).format(form)
    (writer.partitionBy(by) if by else writer).save(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a temporary one in local mode, as in tests; on a cluster ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(table: DataFrame, name: str) -> DataFrame:
    """The table written to a new shared folder and read again: what derives from it doesn't compute it once more."""
    path = shared_folder(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
