import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from basalt.operators import metrics, store
from basalt.operators.contract import EVENT_TYPE
from basalt.operators.project import COLUMNS
from basalt.operators import merging
from basalt.sources import migrations
from basalt.sources.codec import decode, encode, publish, to_records
from basalt.streaming.counters import Totals
from basalt.streaming.pipelines import RECORD, limit_stream, quarantined, read_backbone, spend, start_analysis, start_writer
from test_contract import event, frame


def records(spark, events, broken=()):
    made = frame(spark, events).select(F.lit(b"agent").alias("key"), encode(F.col("event")).alias("value"), F.lit(3).alias("partition"), F.col("i").alias("offset"))
    odd = spark.createDataFrame([(bytearray(b"agent"), bytearray(v), 3, 100 + i) for i, v in enumerate(broken)], RECORD)
    return made.unionByName(odd)


def test_codec(spark):
    out = decode(records(spark, [event()], [b"this is not an event", b"", b"{}", b'{"event_id": "evt-00001", "unknown": 1}'])).orderBy("offset").collect()
    assert [r.undecodable for r in out] == [False, True, False, False, False]
    assert out[0].event.authentication.network.source.port == 54321 and out[2].event.event_id is None and out[4].event.event_id == "evt-00001"
    r = to_records(frame(spark, [event()])).first()
    assert r.key == b"web-01" and [h.key for h in r.headers] == ["content-type", "schema", "schema-version"]


def test_key_stays_in_one_partition(spark, tmp_path):
    events = [event(origin__agent_id=f"agent-{i % 5}") for i in range(40)]
    publish(to_records(frame(spark, events)), str(tmp_path / "topic"))
    files = spark.read.parquet(str(tmp_path / "topic")).select("key", F.input_file_name().alias("f")).distinct()
    assert files.groupBy("key").count().filter("count > 1").count() == 0


def test_writer_and_replay(spark, tmp_path):
    topic, db, bad = (str(tmp_path / x) for x in ("topic", "store", "quarantine"))
    first = [event(event_id=f"evt-{i:08d}") for i in range(6)] + [event(event_id=""), event(time__event_time=datetime(3000, 1, 1))]
    records(spark, first, [b"this is not an event"]).write.mode("append").parquet(topic)
    run = lambda: start_writer(read_backbone(spark, topic), db, bad, str(tmp_path / "cp")).awaitTermination()
    run()
    records(spark, first[:3]).write.mode("append").parquet(topic)
    run()
    raw = merging.open_store(spark, db).tail
    assert raw.count() == 9
    final = store.final(raw)
    assert final.columns == COLUMNS and final.count() == 6
    assert store.final_count(raw, "tenant_id").first()["events"] == 6
    assert {(r.reason, r.partition, r.offset) for r in quarantined(spark, bad).collect()} == {("contract_violation", 3, 6), ("unstorable", 3, 7), ("undecodable", 3, 100)}
    refused = quarantined(spark, bad).filter("reason = 'undecodable'").first()
    assert bytes(refused.value) == b"this is not an event" and refused.headers[0].value == b"undecodable"


def test_last_write_survives(spark):
    df = spark.createDataFrame([("t", datetime(2024, 1, 1), "e1", 1, "old"), ("t", datetime(2024, 1, 1), "e1", 2, "new"), ("u", datetime(2024, 1, 1), "e1", 1, "other")], "tenant_id string, event_time timestamp, event_id string, write_seq int, source string")
    for c in COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    assert {r.source for r in store.final(df).collect()} == {"new", "other"}


def test_analysis_stream(spark, tmp_path):
    topic, out = str(tmp_path / "topic"), str(tmp_path / "out")
    records(spark, [event(), event(event_class=4242), event(event_id="")], [b"nonsense"]).write.parquet(topic)
    totals = Totals()
    spark.streams.addListener(totals)
    try:
        assert start_analysis(read_backbone(spark, topic), out, str(tmp_path / "cp")).awaitTermination(60)
        for _ in range(100):
            if totals.totals:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(totals)
    assert totals.totals["analysis"] == {"records": 4, "outcome_analysed": 1, "outcome_contract_violation": 1, "outcome_undecodable": 1, "outcome_unrouted": 1}
    assert sorted(r.outcome for r in spark.read.parquet(out).collect()) == ["analysed", "contract_violation", "undecodable", "unrouted"]


def test_token_bucket():
    tokens, at, seen = 3.0, None, []
    for now in (0.0, 0.0, 0.0, 0.0, 1.0, 1.5):
        tokens, ok, at = spend(tokens, at, now, 1, 3)
        seen.append(ok)
    assert seen == [True, True, True, False, True, False]
    assert spend(0, None, 5.0, 0, 3)[1]


def test_token_bucket_stream(spark, tmp_path):
    spark.createDataFrame([("a", i, 0.0) for i in range(4)] + [("b", 9, 0.0)], "agent_id string, request_id long, at_seconds double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("agent_id string, request_id long, at_seconds double").parquet(str(tmp_path / "in"))
    q = limit_stream(stream, 1, 3, idle_ms=None).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {r.request_id: r.allowed for r in spark.table("limited").collect()}
    assert sorted(got.values()) == [False, True, True, True, True] and got[9]


def test_migrations(spark, tmp_path):
    folder = tmp_path / "schema"
    folder.mkdir()
    (folder / "0002_more.sql").write_text("-- a note\nCREATE TABLE IF NOT EXISTS more (x INT) USING parquet;\n")
    (folder / "0001_first.sql").write_text("CREATE TABLE IF NOT EXISTS first (x INT) USING parquet")
    assert migrations.apply(spark, folder, "ledger") == [1, 2]
    assert migrations.apply(spark, folder, "ledger") == []
    assert migrations.missing_columns(spark, "more", ["x", "y"]) == ["y"]
    (folder / "0003_again.sql").write_text("CREATE TABLE again (x INT)")
    with pytest.raises(ValueError, match="twice"):
        migrations.apply(spark, folder, "ledger")
    from pathlib import Path

    own = Path(migrations.__file__).parent / "schema"
    assert migrations.apply(spark, own, "own_ledger") == [1]
    assert migrations.missing_columns(spark, "security_events") == []


def test_metrics(spark):
    df = spark.createDataFrame([(0.01,), (0.3,), (7.0,), (None,)], "v double")
    got = {r["le"]: r["count"] for r in metrics.histogram(df, F.col("v"), (0.05, 1, 5)).collect()}
    assert got == {"0.05": 1, "1": 2, "5": 2, "+Inf": 3, "_count": 3, "_sum": 7.31}
    offsets = spark.createDataFrame([("t", 0, None, 5000), ("t", 1, 5000, 7500), ("t", 2, 9, 3)], "topic string, partition int, next_offset long, end_offset long")
    assert [r.lag for r in metrics.lag(offsets).orderBy("partition").collect()] == [5000, 2500, 0]
    two = spark.createDataFrame([(1,), (2,)], "v long")
    assert metrics.nearest_rank(two, "v").first().asDict() == {"p50": 2, "p95": 2, "p99": 2, "max": 2}


def test_filter_on_key_reaches_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([("t", datetime(2024, 1, 1), "e")], "tenant_id string, event_time timestamp, event_id string")
    for c in COLUMNS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(""))
    store.append(rows.select(*COLUMNS), str(tmp_path / "s"), F.lit("1"))
    plan = store.final(store.scan(spark, str(tmp_path / "s"))).filter("tenant_id = 't'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tenant_id,t)" in plan
    assert EVENT_TYPE.fieldNames()[0] == "event_id"


def test_retention_reaches_the_scan_and_drops_months(spark, tmp_path):
    rows = spark.createDataFrame([("t", datetime(2023, 11, 5), "a"), ("t", datetime(2024, 1, 15, 11, 59, 59, 500000), "b"), ("t", datetime(2024, 1, 15, 12, 0, 0, 500000), "c"), ("t", datetime(2024, 1, 15, 12, 0, 1), "d"), ("t", datetime(2024, 3, 1), "e")], "tenant_id string, event_time timestamp, event_id string")
    for c in COLUMNS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(""))
    path, now = str(tmp_path / "s"), F.lit("2025-01-14 12:00:00").cast("timestamp")
    store.append(rows.select(*COLUMNS), path, F.lit("1"))
    kept = store.retained(store.scan(spark, path), now)
    # by the rule itself: whole seconds of the event time, and 365 days more, lie after now
    rule = store.scan(spark, path).filter(F.date_trunc("second", "event_time") + F.expr("interval 365 days") > now)
    assert sorted(r.event_id for r in kept.collect()) == sorted(r.event_id for r in rule.collect()) == ["d", "e"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "event_month" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(event_time" in plan
    assert [tuple(r) for r in store.expired_months(store.scan(spark, path), now).collect()] == [(202311, 1)]
    assert store.drop_expired(spark, path, now) == [202311] and store.drop_expired(spark, path, now) == []
    assert store.scan(spark, path).count() == 4


def test_retry_doubles_to_a_ceiling():
    from basalt.streaming.pipelines import Retry

    waits, left = [], [6]

    def action():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("away")

    retry = Retry(first_seconds=1, ceiling_seconds=10, sleep=waits.append)
    retry.run(3, action)
    assert waits == [1, 2, 4, 8, 10, 10]
    assert [a[:3] for a in retry.attempts] == [(3, i, i == 7) for i in range(1, 8)]
    with pytest.raises(OSError):
        left[0] = 5
        Retry(most=2, sleep=waits.append).run(4, action)


def test_writer_tries_again(spark, tmp_path, monkeypatch):
    from basalt.streaming import pipelines

    fails = [2]
    write = pipelines.write_batch

    def flaky(*a):
        fails[0] -= 1
        if fails[0] >= 0:
            raise OSError("the store is away")
        write(*a)

    monkeypatch.setattr(pipelines, "write_batch", flaky)
    topic, db, bad = (str(tmp_path / x) for x in ("topic", "store", "quarantine"))
    records(spark, [event(event_id=f"evt-{i:08d}") for i in range(6)]).write.parquet(topic)
    retry = pipelines.Retry(first_seconds=0.01, sleep=lambda s: None)
    start_writer(read_backbone(spark, topic), db, bad, str(tmp_path / "cp"), retry).awaitTermination()
    assert merging.open_store(spark, db).tail.count() == 6 and [a[2] for a in retry.attempts] == [False, False, True]


def test_acknowledged_only_once_written(spark, tmp_path):
    from basalt.operators import admission
    from basalt.streaming.pipelines import deliver

    now = datetime(2026, 8, 17, 10, 31)
    rows = frame(spark, [event(event_id=f"evt-{i:08d}") for i in range(3)] + [event(event_id="")])
    made = rows.groupBy((F.col("i") == 3).alias("bad")).agg(F.collect_list("event").alias("events"))
    batches = made.select(F.when(F.col("bad"), "batch-bad").otherwise("batch-1").alias("batch_id"), F.lit(1).alias("protocol_version"), "events", F.lit("web-01").alias("agent_id"), F.lit("acme").alias("tenant_id"), F.lit(now).alias("received"))
    policy = admission.Policy(age_seconds=40 * 365 * 86400, skew_seconds=40 * 365 * 86400)
    out = str(tmp_path / "written")
    good = deliver(batches, lambda e: e.write.parquet(out), policy)
    assert [tuple(r) for r in admission.acknowledgements(good).collect()] == [("batch-1", True, True, 3)]
    assert spark.read.parquet(out).count() == 3
    lost = deliver(batches, lambda e: e.write.parquet(out), policy)  # the folder is there: the write fails
    assert admission.acknowledgements(lost).count() == 0
    codes = {r.batch_id: (r.code, r.status) for r in lost.withColumn("status", admission.status(F.col("code"))).collect()}
    assert codes == {"batch-1": ("backbone_unavailable", 503), "batch-bad": ("invalid_event", 422)}


def test_records_of_a_broker(spark):
    from basalt.streaming.pipelines import kafka_records

    raw = spark.createDataFrame([], "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int")
    assert kafka_records(raw).schema.simpleString() == spark.createDataFrame([], RECORD).schema.simpleString()


def test_start_on_a_table_that_is_behind(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS behind (event_id STRING) USING parquet")
    with pytest.raises(RuntimeError, match="tenant_id"):
        migrations.require(spark, "behind", ["event_id", "tenant_id"])
    migrations.require(spark, "behind", ["event_id"])


def test_lag_is_forgotten_on_revoke(spark):
    log = [("t", 0, 1, "end", 5000), ("t", 1, 1, "end", 10), ("t", 1, 2, "commit", 8), ("t", 1, 3, "commit", 6), ("t", 2, 1, "end", 9), ("t", 2, 2, "revoke", None), ("t", 3, 1, "commit", 7), ("t", 3, 2, "revoke", None), ("t", 3, 3, "end", 20)]
    df = spark.createDataFrame(log, "topic string, partition int, seq long, kind string, offset long")
    assert {r.partition: r.lag for r in metrics.lag_state(df).collect()} == {0: 5000, 1: 2, 3: 20}


def test_a_few_files_are_dealt_to_all_cores(spark, tmp_path):
    publish(to_records(frame(spark, [event(event_id=f"evt-{i:08d}") for i in range(60)])), str(tmp_path / "topic"))
    seen = []
    sink = lambda df, n: seen.append((df.count(), df.select(F.spark_partition_id()).distinct().count()))
    read_backbone(spark, str(tmp_path / "topic")).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [n for n, _ in seen] == [60] and seen[0][1] > 4  # all have one agent, so they are one file
