"""The two consumers of the backbone as Structured Streaming queries, and a limiter by agent.

Each has its own checkpoint. A micro-batch is delivered at least once: one that is tried again replaces the folder that
it wrote, and records that were published twice meet in the store's key and the quarantine's position.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import admission, merging
from ..operators.project import project
from ..operators.route import analyse, classify_for_store
from ..sources import migrations
from ..sources.codec import decode, quarantine
from ..sources.package import ship
from .counters import observe

_log = logging.getLogger(__name__)
RECORD = "key binary, value binary, partition int, offset long"


def read_backbone(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Records from the earliest on. A Kafka source with the same columns can take this one's place.

    Records are small in files and large once decoded, so those of a few files are dealt to all cores.
    """
    found = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return found.repartition(2 * spark.sparkContext.defaultParallelism, "partition", "offset")


def kafka_records(raw: DataFrame) -> DataFrame:
    """The columns of RECORD from a Kafka source's."""
    return raw.select("key", "value", F.col("partition").cast("int").alias("partition"), F.col("offset").cast("long").alias("offset"))


def read_kafka(spark: SparkSession, servers: str, topic: str, records_per_trigger: int = 1_000_000, **options: str) -> DataFrame:
    """The same from a broker, from the earliest offset on; offsets are kept in the query's checkpoint, once a batch is written."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    source = source.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", records_per_trigger)
    return kafka_records(source.options(**options).load())


@dataclass
class Retry:
    """Tries an action until it succeeds, waiting twice as long after each failure up to a ceiling.

    attempts has (batch, attempt, stored, seconds) of each try. Errors are kept to the last: with `most` tries used up the last one
    is raised, and the batch is delivered again when the query is next started.
    """

    first_seconds: float = 0.5
    ceiling_seconds: float = 30.0
    most: int | None = None
    sleep: Callable[[float], None] = time.sleep
    attempts: list[tuple[int, int, bool, float]] = field(default_factory=list)

    def delay(self, failures: int) -> float:
        """Seconds to wait after so many failures in a row."""
        return min(self.ceiling_seconds, self.first_seconds * 2.0 ** min(failures - 1, 60))

    def run(self, batch: int, action: Callable[[], None]) -> None:
        failures = 0
        while True:
            began = time.monotonic()
            try:
                action()
            except Exception:
                failures += 1
                self.attempts.append((batch, failures, False, time.monotonic() - began))
                if failures == self.most:
                    raise
                self.sleep(self.delay(failures))
            else:
                self.attempts.append((batch, failures + 1, True, time.monotonic() - began))
                return


def drop_replays(records: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Records without those whose key and value came before, no longer ago than `within`.

    The time is that of arrival, so no record is too late for the watermark: a replay that comes later than that
    is passed on, and left to the store's key. Records of one key whose values differ are all kept.
    """
    mark = F.struct(F.md5(F.coalesce("key", F.lit(b""))).alias("k"), F.md5(F.coalesce("value", F.lit(b""))).alias("v"), F.col("key").isNull().alias("n"), F.col("value").isNull().alias("m"))
    timed = records.withColumn("_came", F.current_timestamp()).withColumn("_mark", mark).withWatermark("_came", within)
    return timed.dropDuplicatesWithinWatermark(["_mark"]).drop("_came", "_mark")


def deliver(batches: DataFrame, write: Callable[[DataFrame], None], policy: admission.Policy = admission.Policy()) -> DataFrame:
    """Admit batches, write the events of accepted ones, and only then say what became of each batch.

    Returns admission's rows as settle() leaves them: acknowledgements() and rejections() of these are the answers. Where
    the write fails its cause is logged, no batch is acknowledged, and all that were accepted are refused with
    backbone_unavailable.
    """
    admitted = admission.admit(batches, policy)
    events = admitted.filter("accepted").select(F.explode("events").alias("event"))
    try:
        write(events)
        durable = True
    except Exception:
        _log.exception("accepted batches couldn't be written")
        durable = False
    return admission.settle(admitted, F.lit(durable))


def write_batch(records: DataFrame, batch: int, store: str, refused: str, epoch: int = 0) -> dict[tuple[int, str], int]:
    """One micro-batch: rows first, then the quarantine, each into the batch's own folder; returns how many had each part and outcome.

    Records without a column part, which numbers batches that are read at once, are part 0.
    A failure leaves the batch to be delivered again, which replaces what it had left. epoch says which writer came
    first where their batches' numbers are the same.
    """
    decoded = classify_for_store(decode(records), undecodable=F.col("undecodable")).persist()
    name = f"{epoch:015d}-{batch:020d}"
    try:
        seq = F.format_string(f"{name}-%010d-%020d", "partition", "offset")
        rows = project(decoded.filter("outcome = 'row'"), keep=("partition", "offset"))
        merging.write_batch(rows.withColumn("write_seq", seq).drop("partition", "offset"), store, name, F.col("write_seq"))
        quarantine(decoded).write.mode("overwrite").parquet(f"{refused}/batch={name}")
        part = F.col("part") if "part" in records.columns else F.lit(0)
        return {(r[0], r[1]): r[2] for r in decoded.groupBy(part.alias("part"), "outcome").count().collect()}  # a row for each batch and outcome
    finally:
        decoded.unpersist()


MEASURES = "batch long, part int, attempt int, stored boolean, events long, quarantined long, seconds double"


def _epoch(spark: SparkSession, checkpoint: str) -> int:
    """When a query with this checkpoint was first started, in milliseconds; kept beside it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}.epoch")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    known = [int(f.getPath().getName()) for f in fs.listStatus(at)] if fs.exists(at) else []
    if not known:
        known = [time.time_ns() // 1_000_000]
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(at, str(known[0])))
    return min(known)


def start_writer(
    records: DataFrame, store: str, refused: str, checkpoint: str, retry: Retry | None = None, measures: str | None = None, table: str | None = None, every: str | None = None
) -> StreamingQuery:
    """The writer as a query; a batch that fails is tried again until it succeeds or the query is stopped, and holds back those after it.

    `retry` may say otherwise. Each batch's attempts are written to a folder of their own under measures, which a batch that is
    delivered again replaces; batches that are read at once are written at once, so they have a row each where that succeeds,
    and one for all where it fails. A table that readers use, and that lacks columns, keeps the query from starting. The query ends
    with what there is to read, or looks again `every` so often, as a source with a cap on records needs it.
    """
    spark, retry = records.sparkSession, retry or Retry()
    if table is not None:
        migrations.require(spark, table)
    epoch = _epoch(spark, checkpoint)

    def sink(df: DataFrame, n: int) -> None:
        found: dict[tuple[int, str], int] = {}

        def attempt() -> None:
            found.update(write_batch(df, n, store, refused, epoch) or {})

        before = len(retry.attempts)
        try:
            retry.run(n, attempt)
        finally:
            if measures is not None:
                parts: dict[int, list[int]] = {}
                for (part, outcome), count in found.items():
                    parts.setdefault(part, [0, 0])[outcome != "row"] += count
                rows = [(b, p, i, ok, *counts, s) for b, i, ok, s in retry.attempts[before:] for p, counts in (sorted(parts.items()) or [(0, [0, 0])] if ok else [(0, [0, 0])])]
                df.sparkSession.createDataFrame(rows, MEASURES).coalesce(1).write.mode("overwrite").parquet(f"{measures}/batch_of={epoch:015d}-{n:020d}")
                del retry.attempts[before:]

    query = records.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if every is None else query.trigger(processingTime=every)).start()


def start_analysis(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Outcome, route and canonical event of every record; stateless, so no watermark is needed."""
    found = observe(analyse(decode(records), undecodable=F.col("undecodable")), "analysis")
    found = found.select("partition", "offset", "outcome", "class", "route", "rewritten", F.struct("violation.field", "violation.reason").alias("violation"), "canonical")
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """Refused records, each position once however often its batch was delivered."""
    return spark.read.parquet(path).dropDuplicates(["partition", "offset"])


def spend(tokens: float, at: float | None, now: float, rate: float, burst: float) -> tuple[float, bool, float]:
    """One call: tokens left, whether it is allowed, and the time to count from; a rate of 0 or less disables."""
    if rate <= 0:
        return tokens, True, now
    if at is not None:
        tokens = min(burst, tokens + max(0.0, now - at) * rate)
    return (tokens - 1, True, now) if tokens >= 1 else (tokens, False, now)


def limit_stream(requests: DataFrame, rate: float, burst: float, key: str = "agent_id", idle_ms: int | None = 600_000) -> DataFrame:
    """requests(key, request_id, at_seconds) with allowed.

    Each key may spend `burst` tokens at once and earns `rate` a second; a new key's bucket is full. The state
    of a key is its tokens and the time they were counted at; one unused for idle_ms is forgotten, after which
    it is as good as full where burst / rate is no longer than that. With idle_ms the query checks the time
    again and again, so it has to run under a processing-time trigger; None keeps all keys.
    """
    ship(requests.sparkSession)

    def run(name: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, at = state.get if state.exists else (burst, None)
        for pdf in rows:
            pdf = pdf.sort_values(["at_seconds", "request_id"])
            allowed = []
            for t in pdf["at_seconds"]:
                tokens, ok, at = spend(tokens, at, float(t), rate, burst)
                allowed.append(ok)
            yield pd.DataFrame({key: name[0], "request_id": pdf["request_id"].to_numpy(), "allowed": allowed})
        state.update((tokens, at))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return requests.groupBy(key).applyInPandasWithState(run, f"{key} string, request_id long, allowed boolean", "tokens double, at double", "append", timeout)


def limit_batch(requests: DataFrame, rate: float, burst: float, key: str = "agent_id") -> DataFrame:
    """The same over a finished table. A key's rows are streamed in order of time, in batches, not gathered.

    Each decision depends on the one before, so one task walks through all rows of a key, however many these are: it holds
    one Arrow batch, spills its sort, and takes time in proportion to the busiest key.
    """
    ship(requests.sparkSession)
    ordered = requests.repartition(key).sortWithinPartitions(key, "at_seconds", "request_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_key, tokens, at = None, burst, None
        for pdf in batches:
            allowed = []
            for k, t in zip(pdf[key], pdf["at_seconds"], strict=True):
                if k != now_key:
                    now_key, tokens, at = k, burst, None
                tokens, ok, at = spend(tokens, at, float(t), rate, burst)
                allowed.append(ok)
            yield pd.DataFrame({key: pdf[key], "request_id": pdf["request_id"], "allowed": allowed})

    return ordered.select(key, "request_id", "at_seconds").mapInPandas(run, f"{key} string, request_id long, allowed boolean")
