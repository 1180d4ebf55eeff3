"""Retention in the catalogue: monthly partitions made ahead and dropped, tables whose rows change by a swap, logs that streams append to.

A month is a partition that the catalogue knows, so that it is there before its first row and goes with its files. A table that is
rewritten gets a new folder, and one entry of the catalogue then points to it: a reader sees the old rows or the new ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import expired_months, with_month


def month_after(month: str, n: int = 1) -> str:
    year, m = divmod(int(month[:4]) * 12 + int(month[5:]) - 1 + n, 12)
    return f"{year:04}-{m + 1:02}"


def create_monthly(spark: SparkSession, name: str, df: DataFrame) -> None:
    """An empty table of the rows' columns with a partition column ``month``. It is the warehouse's own, so files go with partitions."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, month STRING) USING parquet PARTITIONED BY (month)")


def months_of(spark: SparkSession, name: str) -> list[str]:
    """The months that the catalogue has, from its own entries: no file is listed or read."""
    return sorted(r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {name}").collect())


def make_months(spark: SparkSession, name: str, today: date, ahead: int = 2) -> list[str]:
    """This month's partition and those of the next ones, where they are not there yet."""
    wanted = [month_after(today.strftime("%Y-%m"), n) for n in range(ahead + 1)]
    new = sorted(set(wanted) - set(months_of(spark, name)))
    if new:
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS " + " ".join(f"PARTITION (month='{m}')" for m in new))
    return new


def drop_expired(spark: SparkSession, name: str, today: date, keep_days: int) -> list[str]:
    """Drop the months that lie wholly before the window, their files too: one statement, one change of the catalogue."""
    old = expired_months(months_of(spark, name), today, keep_days)
    if old:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS " + ", ".join(f"PARTITION (month='{m}')" for m in old) + " PURGE")
    return old


def append_months(df: DataFrame, name: str, at: str = "created_at") -> None:
    """Append rows to a monthly table; months that it lacks are added."""
    with_month(df, at).select(*df.sparkSession.table(name).columns).write.mode("append").insertInto(name)


def log_writer(path: str, at: str = "created_at") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append a batch to a log by month, under its batch id, so that a retry writes nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = with_month(batch, at).withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(path)

    return write


# ---- tables that are swapped --------------------------------------------------------------------


def location_of(spark: SparkSession, name: str) -> str:
    return next(r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect() if r.col_name == "Location")


def swap(spark: SparkSession, name: str, df: DataFrame, base: str) -> str:
    """Give a table new rows: they are written beside it, then its entry points to them. Returns the folder it had.

    ``df`` may read the table itself. The old folder stays for readers that have begun and for the caller to remove.
    """
    old, new = location_of(spark, name), f"{base.rstrip('/')}/{name.replace('.', '_')}-{uuid.uuid4().hex}"
    df.write.parquet(new)
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{new}'")
    spark.catalog.refreshTable(name)
    return old


def keep_younger(spark: SparkSession, name: str, at: str, today: date, keep_days: int, base: str) -> tuple[int, str | None]:
    """Retention by age: how many rows are too old, and the folder that the table had if it was rewritten without them."""
    first = F.date_sub(F.lit(today), keep_days)
    table = spark.table(name)
    old = table.where(F.col(at) < first).count()
    return old, swap(spark, name, table.where((F.col(at) >= first) | F.col(at).isNull()), base) if old else None
