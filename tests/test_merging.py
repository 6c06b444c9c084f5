"""The merging store, the writer into it and the dedup of replays."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from basalt.operators import merging, metrics, store
from basalt.operators.project import COLUMNS
from basalt.sources.codec import encode
from basalt.streaming import pipelines
from basalt.streaming.pipelines import Retry, drop_replays, read_backbone, start_writer
from test_contract import event, frame


def rows(spark, given):
    """given: (tenant, time, id, source, write_seq)."""
    df = spark.createDataFrame(given, "tenant_id string, event_time timestamp, event_id string, source string, seq string")
    for c in COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df.select(*COLUMNS, "seq")


def put(spark, root, batch, given):
    df = rows(spark, given)
    merging.write_batch(df, root, batch, F.col("seq"))


JAN, FEB = datetime(2024, 1, 5), datetime(2024, 2, 5)


def seen(s):
    return sorted((r.event_id, r.source) for r in merging.final_rows(s).collect())


def test_batches_merge_and_readers(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(ValueError):
        merging.final_rows(merging.open_store(spark, root))
    put(spark, root, "1", [("t", JAN, "a", "old", "1"), ("t", JAN, "b", "b1", "1"), ("t", FEB, "c", "c1", "1")])
    put(spark, root, "2", [("t", JAN, "a", "new", "2"), ("t", JAN, "a", "new", "2")])
    put(spark, root, "2", [("t", JAN, "a", "again", "2")])  # the batch is tried again
    first = [("a", "again"), ("b", "b1"), ("c", "c1")]
    assert seen(merging.open_store(spark, root)) == first
    assert merging.merge(spark, root) == [202401, 202402] and merging.merge(spark, root) == []
    merged = merging.open_store(spark, root)
    assert seen(merged) == first and merged.tail is None
    plan = merging.final_rows(merged)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    # a row of an older batch that comes late, a newer one, and one of a key that isn't there
    put(spark, root, "3", [("t", JAN, "a", "late", "0"), ("t", FEB, "c", "c3", "3"), ("u", FEB, "d", "d3", "3")])
    during = merging.open_store(spark, root)
    second = [("a", "again"), ("b", "b1"), ("c", "c3"), ("d", "d3")]
    assert seen(during) == second
    plan = merging.final_rows(during)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert merging.merge(spark, root) == [202401, 202402]
    after = merging.open_store(spark, root)
    assert seen(during) == seen(after) == second  # who read before the merge reads on
    assert sorted(merging.vacuum(spark, root)) == ["merged/version=1/event_month=202401", "merged/version=1/event_month=202402", "raw/batch=1", "raw/batch=2", "raw/batch=3"]
    assert seen(merging.open_store(spark, root)) == second and merging.vacuum(spark, root) == []
    put(spark, root, "4", [("u", FEB, "d", "d4", "4")])
    assert merging.merge(spark, root) == [202402] and merging.open_store(spark, root).state.months == {"202401": 2, "202402": 3}


def test_only_one_of_two_merges_publishes(spark, tmp_path):
    root = str(tmp_path / "store")
    put(spark, root, "1", [("t", JAN, "a", "x", "1")])
    merging.merge(spark, root)
    put(spark, root, "2", [("t", JAN, "b", "x", "2")])
    files = merging._Files(spark, root)
    files.publish("ledger/000000000002.json", files.read("ledger/000000000001.json").replace('"version": 1', '"version": 2'))
    ours = merging._state
    try:
        merging._state = lambda f: merging.State(1, {"202401": 1}, ["1"])
        with pytest.raises(Exception, match="(?i)exist"):
            merging.merge(spark, root)
    finally:
        merging._state = ours
    assert seen(merging.open_store(spark, root)) == [("a", "x"), ("b", "x")]


def log(spark, path, events, partition=3, start=0, mode="append"):
    made = frame(spark, events).select(F.lit(b"agent").alias("key"), encode(F.col("event")).alias("value"), F.lit(partition).alias("partition"), (F.col("i") + start).cast("long").alias("offset"))
    made.coalesce(1).write.mode(mode).parquet(path)


def test_three_failures_leave_one_copy_and_measures(spark, tmp_path, monkeypatch):
    topic, db, bad, cp, measures = (str(tmp_path / x) for x in ("topic", "store", "quarantine", "cp", "measures"))
    log(spark, topic, [event(event_id=f"evt-{i:08d}") for i in range(6)] + [event(event_id="")])
    fails, write = [3], pipelines.quarantine

    def flaky(df):
        fails[0] -= 1
        if fails[0] >= 0:
            raise OSError("the rows are written, the quarantine is away")
        return write(df)

    monkeypatch.setattr(pipelines, "quarantine", flaky)
    start_writer(read_backbone(spark, topic), db, bad, cp, Retry(first_seconds=0.01, sleep=lambda s: None), measures).awaitTermination()
    assert merging.open_store(spark, db).tail.count() == 6
    told = spark.read.parquet(measures)
    assert sorted((r.attempt, r.stored, r.events, r.quarantined) for r in told.collect()) == [(1, False, 0, 0), (2, False, 0, 0), (3, False, 0, 0), (4, True, 6, 1)]
    assert {r.label: r["value"] for r in metrics.writer_counters(told).collect()} == {"stored": 1, "retried": 3}
    hist = {r["le"]: r["count"] for r in metrics.histogram(told, F.col("seconds"), metrics.BUCKETS["seconds"]).collect()}
    assert hist["_count"] == 4


def test_a_new_checkpoint_writes_later(spark, tmp_path):
    topic, db, bad = (str(tmp_path / x) for x in ("topic", "store", "quarantine"))
    one = event(event_id="evt-00000001")
    for n, name in enumerate(("first", "second")):
        log(spark, topic, [one | {"authentication": one["authentication"] | {"method": name}}] if isinstance(one, dict) else [event(event_id="evt-00000001", authentication__method=name)], start=n, mode="overwrite")
        start_writer(read_backbone(spark, topic), db, bad, str(tmp_path / f"cp{n}")).awaitTermination()
    assert [r.auth_method for r in merging.final_rows(merging.open_store(spark, db)).collect()] == ["second"]


def test_start_is_refused_on_a_table_that_is_behind(spark, tmp_path):
    spark.sql("CREATE TABLE IF NOT EXISTS behind_writer (event_id STRING) USING parquet")
    topic = str(tmp_path / "topic")
    log(spark, topic, [event()])
    with pytest.raises(RuntimeError, match="tenant_id"):
        start_writer(read_backbone(spark, topic), str(tmp_path / "s"), str(tmp_path / "q"), str(tmp_path / "c"), table="behind_writer")


def test_replays_are_dropped_within_the_bound(spark, tmp_path):
    topic, db, bad = (str(tmp_path / x) for x in ("topic", "store", "quarantine"))
    events = [event(event_id=f"evt-{i:08d}") for i in range(4)]
    run = lambda bound: start_writer(drop_replays(read_backbone(spark, topic), bound), db, bad, str(tmp_path / "cp")).awaitTermination()
    log(spark, topic, events + events[:2])
    run("1 hour")
    log(spark, topic, [events[0], event(event_id="evt-00000009")], start=50)
    run("1 hour")
    assert sorted(r.event_id for r in merging.open_store(spark, db).tail.collect()) == [f"evt-{i:08d}" for i in (0, 1, 2, 3, 9)]


def test_month_grows_with_its_rows(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        made = spark.range(0, 20_000, 1, 32).select(F.lit("t").alias("tenant_id"), F.lit(JAN).alias("event_time"), F.col("id").cast("string").alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("source"), F.lit("1").alias("seq"))
        for c in COLUMNS:
            if c not in made.columns:
                made = made.withColumn(c, F.lit(""))
        store.append(made.select(*COLUMNS), str(tmp_path / "s"), F.lit("1"))
        assert len(spark.read.parquet(str(tmp_path / "s")).inputFiles()) > 8
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
