"""The capped limiter as a stream, against a plain one with a list in order of use."""

import random
import time
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from basalt.streaming import limiter
from basalt.streaming.pipelines import spend

SCHEMA = "agent_id string, request_id long, at_seconds double"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    limiter.keep_state_in_rocksdb(spark)
    yield spark
    spark.conf.set(name, before)


def run(spark, folder, calls, **options):
    """Answers to calls that arrive as files, one after another; the query starts anew for each."""
    options = {"idle_ms": None} | options
    source, out, checkpoint = (str(folder / x) for x in ("calls", "out", "checkpoint"))
    for batch in calls:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        limiter.limit(stream, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return {r.request_id: r.allowed for r in spark.read.parquet(out).collect()}, checkpoint


def plain(calls, rate, burst, capacity):
    held, answers = OrderedDict(), {}
    for agent, request, at in (c for batch in calls for c in sorted(batch, key=lambda c: (c[2], c[1]))):
        tokens, last = held.get(agent, (burst, None))
        tokens, answers[request], last = spend(tokens, last, at, rate, burst)
        held[agent] = (tokens, last)
        held.move_to_end(agent)
        if len(held) > capacity:
            held.popitem(last=False)
    return answers, set(held)


def test_burst_separate_agents_and_restart(rocks, tmp_path):
    calls = [[("web-01", i, 0.0) for i in range(3)] + [("web-02", 10, 0.0)], [("web-01", 4, 0.5), ("web-02", 11, 0.5)], [("web-01", 5, 2.0), (None, 6, 2.0)]]
    got, _ = run(rocks, tmp_path, calls, rate=1, burst=3, capacity=100)
    assert got == {0: True, 1: True, 2: True, 10: True, 4: False, 11: True, 5: True, 6: True}


def test_least_recently_used_bucket_makes_room(rocks, tmp_path):
    rng = random.Random(2)
    calls = [[(f"agent-{min(rng.randrange(16), rng.randrange(16))}", 100 * b + i, b + i / 50) for i in range(60)] for b in range(2)]
    want, held = plain(calls, 0.01, 2, 8)
    got, checkpoint = run(rocks, tmp_path, calls, rate=0.01, burst=2, capacity=8, shards=1)
    assert got == want and {True, False} == set(got.values())
    state = rocks.read.format("statestore").option("path", checkpoint).option("stateVarName", "buckets").load()
    assert len(held) == state.count() == 8
    assert {r.agent for r in limiter.tracked(rocks, checkpoint).collect()} == held


def test_tracked_agents_are_bounded(rocks, tmp_path):
    _, checkpoint = run(rocks, tmp_path, [[(f"agent-{i}", i, 0.0) for i in range(1000)]], rate=100, burst=100, capacity=8, shards=4)
    assert 0 < limiter.tracked(rocks, checkpoint).count() <= 8


def test_idle_buckets_expire(rocks, tmp_path):
    source = str(tmp_path / "calls")
    rocks.createDataFrame([("a", i, 0.0) for i in range(3)], SCHEMA).coalesce(1).write.parquet(source)
    stream = limiter.limit(rocks.readStream.schema(SCHEMA).parquet(source), rate=0.001, burst=2, capacity=4, shards=1, idle_ms=1)
    query = stream.writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()

    def until(n):
        end = time.time() + 60
        while rocks.table("expiring").count() < n and time.time() < end:
            time.sleep(0.2)

    try:
        until(3)
        time.sleep(0.5)
        rocks.createDataFrame([("a", 3, 0.0)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        until(4)
    finally:
        query.stop()
    assert {r.request_id: r.allowed for r in rocks.table("expiring").collect()} == {0: True, 1: True, 2: False, 3: True}


def test_rate_of_zero_keeps_nothing(spark):
    df = spark.createDataFrame([("a", 1, 0.0)] * 5, SCHEMA)
    out = limiter.limit(df, rate=0, burst=0, capacity=8)
    assert out.filter("allowed").count() == 5
    with pytest.raises(ValueError):
        limiter.limit(df, rate=1, burst=1, capacity=0)
    assert out.select(F.max("agent_id")).first()[0] == "a"
