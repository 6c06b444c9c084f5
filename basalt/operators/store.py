"""The store: a Parquet table by month that is deduplicated when it is read."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .project import COLUMNS

KEY = ("tenant_id", "event_time", "event_id")
RETENTION_DAYS = 365


def month(c: Column) -> Column:
    return F.year(c) * 100 + F.month(c)


def append(rows: DataFrame, path: str, write_seq: Column) -> None:
    """Add rows in the store's columns; write_seq says which of two rows with one key was written later.

    Rows are clustered by month before they are written: a month makes as many files as its size asks, for adaptive
    execution splits what is large and joins what is small. Within a file they are sorted by the key, which lets a
    reader skip row groups of other tenants.
    """
    out = rows.withColumn("write_seq", write_seq).withColumn("event_month", month(F.col("event_time")))
    out.hint("rebalance", F.col("event_month")).sortWithinPartitions("event_month", *KEY).write.mode("append").partitionBy("event_month").option("compression", "zstd").parquet(path)


def scan(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Raw rows, replays included. A range of event times prunes months as well as rows."""
    df = spark.read.parquet(path)
    for t, keep in ((since, lambda c, v: c >= v), (until, lambda c, v: c <= v)):
        if t is not None:
            df = df.filter(keep(F.col("event_time"), F.lit(t)) & keep(F.col("event_month"), F.lit(t.year * 100 + t.month)))
    return df


def final(rows: DataFrame, write_seq: str = "write_seq", keep: list[str] = COLUMNS) -> DataFrame:
    """One row for each (tenant, event time, event id): the one written last.

    A filter on a key column is pushed below the window to the scan; others have to see the surviving row. Rows of one
    key that meet in a task are cut to the last before the shuffle. merging.final_rows() needs no shuffle of merged rows.
    """
    last = Window.partitionBy(*KEY).orderBy(F.desc(write_seq))
    return rows.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").select(*keep)


def final_count(rows: DataFrame, *by: str) -> DataFrame:
    """Rows after deduplication, for key columns only: no window and no column besides the key is read."""
    return rows.select(*KEY).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("events"))


def _kept_from(now: Column, days: int) -> Column:
    """The first instant that retention keeps: event times count in whole seconds, and are kept for more than `days`."""
    return F.date_trunc("second", now - F.expr(f"interval {days} days")) + F.expr("interval 1 second")


def retained(rows: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows that retention leaves: those whose event time, in whole seconds, is less than `days` ago.

    The bound is a constant, so it reaches the scan; where rows have their month, whole months are left out.
    """
    limit = _kept_from(now, days)
    keep = F.col("event_time") >= limit
    if "event_month" in rows.columns:
        keep = keep & (F.col("event_month") >= month(limit))
    return rows.filter(keep)


def expired_months(rows: DataFrame, now: Column, days: int = RETENTION_DAYS, month_of: Column | None = None) -> DataFrame:
    """(event_month, events) of the months of which retention leaves no row."""
    of = F.col("event_month") if month_of is None else month_of
    return rows.filter(of < month(_kept_from(now, days))).groupBy(of.alias("event_month")).agg(F.count(F.lit(1)).alias("events"))


def drop_expired(spark: SparkSession, path: str, now: Column, days: int = RETENTION_DAYS) -> list[int]:
    """Delete the store's folders of such months, and say which; rows of the last month that is left are for retained()."""
    limit = spark.range(1).select(month(_kept_from(now, days))).first()[0]
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for f in fs.listStatus(root):
        name, _, value = f.getPath().getName().partition("=")
        if name == "event_month" and value.isdigit() and int(value) < limit:
            fs.delete(f.getPath(), True)
            gone.append(int(value))
    return sorted(gone)
