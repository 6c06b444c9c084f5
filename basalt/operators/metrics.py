"""Labelled counters, gauges and histograms as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the histograms.
BUCKETS = {
    "seconds": (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10),
    "batch_events": (1, 10, 100, 500, 1000, 5000, 10000),
    "event_delay_seconds": (0.05, 0.25, 1, 5, 30, 300, 3600),
    "event_lag_seconds": (1, 5, 30, 120, 600, 3600, 86400),
}


def seconds_between(start: Column, end: Column) -> Column:
    """May be negative."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def counter(df: DataFrame, name: str, *labels: Column | str, value: Column | None = None) -> DataFrame:
    """(metric, label, value): rows, or the sum of value, for each combination of labels."""
    label = F.concat_ws(",", *labels) if labels else F.lit("")
    total = F.count(F.lit(1)) if value is None else F.sum(value)
    return df.groupBy(label.alias("label")).agg(total.cast("long").alias("value")).select(F.lit(name).alias("metric"), "label", "value")


def histogram(df: DataFrame, value: Column, bounds: tuple[float, ...]) -> DataFrame:
    """(le, count): how many values are at most each bound, with +Inf, the sum and the count as rows of their own.

    One aggregation over all bounds at once; nulls are left out. The sum is taken in millionths, so that it is the same
    in whatever order rows are added.
    """
    v = value.cast("double")
    cells = [F.sum(F.when(v <= b, 1).otherwise(0)).cast("double").alias(f"c{i}") for i, b in enumerate(bounds)]
    row = df.filter(v.isNotNull()).agg(*cells, F.count(F.lit(1)).cast("double").alias("n"), (F.coalesce(F.sum(F.round(v * 1e6).cast("decimal(20,0)")), F.lit(0)).cast("double") / 1e6).alias("s"))
    names = [(f"{b:g}", f"c{i}") for i, b in enumerate(bounds)] + [("+Inf", "n"), ("_count", "n"), ("_sum", "s")]
    entries = F.array(*[F.struct(F.lit(k).alias("le"), F.coalesce(F.col(c), F.lit(0.0)).alias("count")) for k, c in names])
    return row.select(F.explode(entries).alias("e")).select("e.le", "e.count")


def nearest_rank(df: DataFrame, value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """(p50, p95, ..., max): of the sorted values the one at index n * p / 100 rounded down, the last at most.

    Values are counted first and cut into ranges at approximate quantiles, so the running count is taken within
    ranges of distinct values and over the ranges' sums; no task holds all values. Nulls are left out.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # one row of as many numbers as there are ranges
    cuts = sorted(set(counts.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 1000)).first()[0] or [])) if parts > 1 else []
    bounds = F.array(*map(F.lit, cuts))
    ranged = counts.withColumn("part", F.size(F.filter(bounds, lambda b: b <= F.col("v"))) if cuts else F.lit(0))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("in_part"))
    # one task, over as many rows as there are ranges
    earlier, all_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("before"), F.sum("in_part").over(all_parts).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranged.withColumn("upto", upto).join(sums, "part").withColumn("last", F.col("before") + F.col("upto"))
    rank = lambda p: F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1)
    pick = [F.min(F.when(F.col("last") > rank(p), F.col("v"))).alias(f"p{p}") for p in percents]
    return ranked.agg(*pick, F.max("v").alias("max"))


def lag(offsets: DataFrame) -> DataFrame:
    """Records left to read on each partition of (topic, partition, next_offset, end_offset)."""
    return offsets.select("topic", "partition", F.greatest(F.col("end_offset") - F.coalesce("next_offset", F.lit(0)), F.lit(0)).alias("lag"))


def drift(declared: DataFrame, current: DataFrame, key: str = "name", value: str = "value") -> DataFrame:
    """Settings whose current value is absent or not the declared one."""
    now = current.select(F.col(key), F.col(value).alias("current"))
    return declared.select(F.col(key), F.col(value).alias("declared")).join(now, key, "left").filter(~F.col("declared").eqNullSafe(F.col("current")))


def outstanding(shipped: DataFrame, applied: DataFrame, key: str = "version") -> DataFrame:
    """What was shipped and not applied yet."""
    return shipped.join(applied.select(key).distinct(), key, "left_anti")


def lag_state(log: DataFrame) -> DataFrame:
    """(topic, partition, lag) from what happened: log(topic, partition, seq, kind, offset), kind being end, commit or revoke.

    A commit only moves the next offset on, an end replaces the one before; a revoke forgets both. A partition is
    listed if an end has come since it was last revoked, whether or not anything was committed.
    """
    since = F.max(F.when(F.col("kind") == "revoke", F.col("seq"))).over(Window.partitionBy("topic", "partition"))
    live = log.withColumn("_since", since).filter(F.col("_since").isNull() | (F.col("seq") > F.col("_since")))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("offset"))
    held = live.groupBy("topic", "partition").agg(F.max(of("commit")).alias("next_offset"), F.max_by(of("end"), F.when(F.col("kind") == "end", F.col("seq"))).alias("end_offset"))
    return lag(held.filter("end_offset IS NOT NULL"))


def writer_counters(attempts: DataFrame) -> DataFrame:
    """eventstore_batches_total by label: attempts(batch, attempt, stored, events, seconds), of which those not stored were retried."""
    return counter(attempts, "eventstore_batches_total", F.when(F.col("stored"), "stored").otherwise("retried"))


def fetch_counters(fetches: DataFrame) -> DataFrame:
    """backbone_* counters of fetches(topic, partition, records, fetch_error, commit_error, refresh_error)."""
    return (
        counter(fetches.filter("NOT fetch_error"), "backbone_records_fetched_total", "topic", value=F.col("records"))
        .unionByName(counter(fetches.filter("fetch_error"), "backbone_fetch_errors_total", F.col("topic"), F.col("partition").cast("string")))
        .unionByName(counter(fetches.filter("commit_error"), "backbone_commit_errors_total"))
        .unionByName(counter(fetches.filter("refresh_error"), "backbone_consumer_lag_refresh_errors_total", "topic"))
    )
