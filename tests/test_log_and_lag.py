"""The log as a source with a cap on records, ordered publishing, and lag from the progress of queries."""

import time

import pytest
from pyspark.sql import functions as F

from basalt.operators import metrics
from basalt.sources.codec import publish
from basalt.sources.log import LogReader, read_log, shares
from basalt.streaming.lag import Lag, offsets_of


def send(spark, path, start, n, partitions=3):
    made = spark.range(start, start + n).select(F.concat(F.lit("agent-"), (F.col("id") % 7).cast("string")).cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"), F.array(F.struct(F.lit("k").alias("key"), F.lit(b"v").alias("value"))).alias("headers"), F.col("id").alias("at"))
    publish(made.repartition(4, F.rand(1)), path, partitions, order=("at",))


def run(spark, path, checkpoint, out, most, wanted, listener=None):
    """Read until as many records have come; (batch, records) of each batch that had some."""
    stream = read_log(spark, path, checkpoint, most)
    sizes = []

    def sink(df, n):
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        sizes.append((n, df.sparkSession.read.parquet(f"{out}/batch={n}").count()))

    if listener:
        spark.streams.addListener(listener)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds").start()
    try:
        end = time.time() + 100
        while sum(n for _, n in sizes) < wanted and time.time() < end and query.isActive:
            time.sleep(0.1)
        if listener:
            for _ in range(100):
                if wanted in [sum(r.next_offset for r in listener.rows(spark).collect())]:
                    break
                time.sleep(0.1)
            seen = metrics.lag(listener.rows(spark)).agg(F.sum("lag")).first()[0]
    finally:
        query.stop()
        if listener:
            spark.streams.removeListener(listener)
    if query.exception():
        raise query.exception()
    return (sizes, seen) if listener else sizes


def test_publish_keeps_the_order_of_each_key(spark, tmp_path):
    path = str(tmp_path / "log")
    send(spark, path, 0, 500)
    send(spark, path, 500, 200)
    back = spark.read.parquet(path).selectExpr("CAST(key AS string) AS key", "CAST(CAST(value AS string) AS long) AS n", "partition", "offset")
    rows = sorted((r.partition, r.offset, r.n, r.key) for r in back.collect())
    assert len(rows) == 700 and len({r[3] for r in rows}) == 7
    for p in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == p]
        assert [r[1] for r in mine] == list(range(len(mine))) and [r[2] for r in mine] == sorted(r[2] for r in mine)
    assert all(len({r[0] for r in rows if r[3] == k}) == 1 for k in {r[3] for r in rows})


def test_batches_are_capped_and_positions_survive(spark, tmp_path):
    path, checkpoint, out = (str(tmp_path / x) for x in ("log", "cp", "out"))
    send(spark, path, 0, 95)
    sizes = run(spark, path, checkpoint, out, 30, 95)
    assert sum(n for _, n in sizes) == 95 and max(n for _, n in sizes) <= 30 and len(sizes) >= 4
    send(spark, path, 95, 40)
    more = run(spark, path, checkpoint, out, 30, 40)
    assert sum(n for _, n in more) == 40 and max(n for _, n in more) <= 30 and min(b for b, _ in more) > max(b for b, _ in sizes)
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("partition", "offset").distinct().count() == 135
    assert sorted(int(bytes(r.value)) for r in rows.collect()) == list(range(135))


def test_lag_rises_and_falls(spark, tmp_path):
    path, checkpoint, out = (str(tmp_path / x) for x in ("log", "cp", "out"))
    send(spark, path, 0, 60)
    lag = Lag(ends=lambda topic: LogReader({"path": path}).ends())
    _, seen = run(spark, path, checkpoint, out, 1000, 60, lag)
    assert seen == 0
    reader = Lag(ends=lambda topic: LogReader({"path": path}).ends())
    reader.observe("q", [(None, {"events": {"0": 5}}, None)])
    before = {r.partition: r.lag for r in metrics.lag(reader.rows(spark)).collect()}
    assert sum(before.values()) == 60 - 5 or before[0] >= 0
    send(spark, path, 60, 30)
    reader.refresh()
    after = {r.partition: r.lag for r in metrics.lag(reader.rows(spark)).collect()}
    assert sum(after.values()) == sum(before.values()) + 30


def test_lag_of_a_broker_and_revoked_partitions(spark):
    lag = Lag()
    lag.observe("q", [(None, '{"t":{"0":0,"1":5000}}', '{"t":{"0":5000,"1":7500}}')])
    assert sorted((r.partition, r.lag) for r in metrics.lag(lag.rows(spark)).collect()) == [(0, 5000), (1, 2500)]
    lag.observe("q", [(None, '{"t":{"1":7500}}', '{"t":{"1":7500}}')])  # 0 was given to another
    assert [(r.partition, r.lag) for r in metrics.lag(lag.rows(spark)).collect()] == [(1, 0)]
    failing = Lag(ends=lambda topic: (_ for _ in ()).throw(OSError("away")))
    failing.observe("q", [(None, '{"t":{"1":3}}', None)])
    failing.refresh()
    assert failing.refresh_errors == 2 and [r.lag for r in metrics.lag(failing.rows(spark)).collect()] == [0]
    assert offsets_of('{"logOffset":3}') == {} and offsets_of(None) == {}


def test_shares_and_options(tmp_path):
    assert shares({0: 100, 1: 3, 2: 50}, 30) == {1: 3, 2: 13, 0: 14}
    assert shares({0: 2, 1: 1}, 30) == {0: 2, 1: 1} and shares({}, 5) == {}
    assert sum(shares({0: 9, 1: 9, 2: 9}, 2).values()) == 2
    assert LogReader({"path": str(tmp_path / "none")}).latestOffset() == {"events": {}}
    with pytest.raises(ValueError):
        LogReader({"path": "/x", "maxRecords": "0"})
    with pytest.raises(ValueError):
        LogReader({"path": "hdfs://x/y"})


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from basalt.sources import codec

    path = str(tmp_path / "log")
    send(spark, path, 0, 50)
    monkeypatch.setattr(codec, "PIECE_BYTES", 8_000)
    send(spark, path, 50, 2_000)  # seven keys in three partitions, 80 bytes a record
    back = spark.read.parquet(path)
    rows = sorted((r.partition, r.offset, int(bytes(r.value)), r.key) for r in back.collect())
    assert [r[2] for r in sorted(rows, key=lambda r: r[2])] == list(range(2_050))
    for p in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == p]
        assert [r[1] for r in mine] == list(range(len(mine))) and [r[2] for r in mine] == sorted(r[2] for r in mine)
    sizes = [r["count"] for r in back.filter("CAST(CAST(value AS string) AS long) >= 50").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 12 and max(sizes) <= 250
    assert [x.name for x in tmp_path.iterdir()] == ["log"]  # what was put beside it is gone


def test_a_partition_without_order_is_cut_too(spark, tmp_path, monkeypatch):
    from basalt.sources import codec

    monkeypatch.setattr(codec, "PIECE_BYTES", 4_000)
    codec.publish(spark.range(500).select(F.when(F.col("id") < 0, F.lit(b"k")).alias("key"), F.col("id").cast("string").cast("binary").alias("value")), str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(r.offset for r in back.collect()) == list(range(500)) and back.select("partition").distinct().count() == 1
    assert back.groupBy(F.input_file_name()).count().count() > 4


def test_order_is_compared_across_chunks(spark, monkeypatch):
    from basalt.sources import codec

    rows = [(k, o % 2, o, None if o % 11 == 0 else (o * 7919) % 101 // 3) for k in ("a", "b", None) for o in range(-40, 200) if o % 5]
    df = spark.createDataFrame(rows, "key string, partition int, offset long, sequence long")
    whole = sorted(map(tuple, codec.delivery(df).collect()), key=repr)
    want = []
    for k in ("a", "b", None):
        below = same = 0
        for p in (0, 1):
            mine = [s for key, part, o, s in sorted((r for r in rows if r[0] == k and r[1] == p), key=lambda r: r[2])]
            pairs = [(a, b) for a, b in zip(mine, mine[1:], strict=False) if a is not None and b is not None]
            below, same = below + sum(b < a for a, b in pairs), same + sum(b == a for a, b in pairs)
        want.append((k, len([r for r in rows if r[0] == k]), 2, below, same))
    assert whole == sorted(want, key=repr)
    monkeypatch.setattr(codec, "CHUNK", 7)
    assert sorted(map(tuple, codec.delivery(df).collect()), key=repr) == whole


def test_capped_batches_are_planned_at_once(spark, tmp_path, monkeypatch):
    from basalt.sources import codec
    from basalt.sources.log import Batch, Range, cut, groups

    assert cut([Range(0, 5, 12, ["f"]), Range(1, 0, 4, ["g"])], 3) == [Batch(0, [Range(0, 5, 8, ["f"])]), Batch(1, [Range(0, 8, 11, ["f"])]), Batch(2, [Range(0, 11, 12, ["f"]), Range(1, 0, 2, ["g"])]), Batch(3, [Range(1, 2, 4, ["g"])])]
    path, checkpoint, out = (str(tmp_path / x) for x in ("log", "cp", "out"))
    monkeypatch.setattr(codec, "PIECE_BYTES", 4_000)
    monkeypatch.setattr(codec, "GROUP_BYTES", 4_000)
    send(spark, path, 0, 950)
    stream, seen = read_log(spark, path, checkpoint, 30, batches=12), []

    def sink(df, n):
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        seen.append(n)

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.read.parquet(out)
    assert len(seen) == 3 and sorted(int(bytes(r.value)) for r in rows.collect()) == list(range(950))
    sizes = sorted(r["count"] for r in rows.groupBy("batch", "part").count().collect())
    assert sizes == [20] + [30] * 31
    import pyarrow.parquet as pq

    file = next((tmp_path / "log").glob("partition=*/*.parquet"))
    meta = pq.ParquetFile(file).metadata
    first = pq.read_table(file, columns=["offset"])["offset"].to_pylist()[0]
    assert groups(meta, first, first + 1) == [0] and groups(meta, 10**9, 10**9 + 1) == []
    with pytest.raises(ValueError):
        LogReader({"path": "/x", "batches": "-1"})


def test_batches_read_at_once_are_measured_one_by_one(spark, tmp_path):
    from basalt.streaming.pipelines import start_writer

    at = str(tmp_path)
    send(spark, f"{at}/log", 0, 95)
    query = start_writer(read_log(spark, f"{at}/log", f"{at}/cp", 30, batches=8), f"{at}/store", f"{at}/refused", f"{at}/cp", measures=f"{at}/measures", every="0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    told = spark.read.parquet(f"{at}/measures")
    assert sorted((r.part, r.events + r.quarantined, r.stored) for r in told.collect()) == [(0, 30, True), (1, 30, True), (2, 30, True), (3, 5, True)]
    assert [(r.label, r["value"]) for r in metrics.writer_counters(told).collect()] == [("stored", 4)] and told.select("batch").distinct().count() == 1
