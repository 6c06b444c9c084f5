"""A limiter by agent whose buckets are capped in number: the least recently used one makes room.

State is a map of buckets for each shard of agents, kept by transformWithState in RocksDB: it outlives restarts, expires
where it isn't used, and can be read back as a table.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.package import ship
from .pipelines import spend

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """What a session needs before a query with such state is started in it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class Buckets(StatefulProcessor):
    """Decides on the calls of one shard's agents, in order of their time."""

    def __init__(self, rate: float, burst: float, capacity: int, ttl_ms: int | None) -> None:
        self.rate, self.burst, self.capacity, self.ttl_ms = float(rate), float(burst), capacity, ttl_ms  # state takes no int for a double

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("buckets", "agent string", "tokens double, at double, used long", self.ttl_ms)
        self.calls = handle.getValueState("calls", "n long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = {k[0]: tuple(v) for k, v in self.kept.iterator()}
        now = OrderedDict(sorted(before.items(), key=lambda x: x[1][2]))
        seen = self.calls.get()
        n = seen[0] if seen else 0
        for pdf in rows:
            pdf = pdf.sort_values(["at_seconds", "request_id"])
            allowed = []
            for agent, at in zip(pdf["agent"], pdf["at_seconds"], strict=True):
                tokens, last, _ = now.get(agent, (self.burst, None, 0))
                tokens, ok, last = spend(tokens, last, float(at), self.rate, self.burst)
                n += 1
                now[agent] = (tokens, last, n)
                now.move_to_end(agent)
                if len(now) > self.capacity:
                    now.popitem(last=False)
                allowed.append(ok)
            yield pd.DataFrame({"agent": pdf["agent"].to_numpy(), "request_id": pdf["request_id"].to_numpy(), "allowed": allowed})
        for agent in before.keys() - now.keys():
            self.kept.removeKey((agent,))
        for agent, bucket in now.items():
            if before.get(agent) != bucket:
                self.kept.updateValue((agent,), bucket)
        self.calls.update((n,))

    def close(self) -> None:
        pass


def limit(requests: DataFrame, rate: float, burst: float, capacity: int, shards: int = 64, idle_ms: int | None = 600_000, key: str = "agent_id") -> DataFrame:
    """requests(key, request_id, at_seconds) with allowed, as a stream.

    An agent may spend `burst` tokens at once and earns `rate` a second; a rate of 0 or less allows everything and keeps no
    state. At most `capacity` buckets are kept in all: each of the shards, into which agents fall by hash, keeps its
    part (one at least), and drops the one that wasn't used for longest when a new agent comes. A bucket that is dropped, or
    not used for idle_ms, is full when its agent is next seen. Calls of a micro-batch are decided in order of time, a null agent
    counts as the empty name, and the state that a task holds is a shard's. keep_state_in_rocksdb() comes first. With idle_ms
    the query looks at the clock again and again, so it needs a processing-time trigger; None keeps buckets until they make room.
    """
    if rate <= 0:
        return requests.select(F.coalesce(key, F.lit("")).alias(key), "request_id", F.lit(True).alias("allowed"))
    if capacity < 1:
        raise ValueError("a limiter needs room for one bucket")
    ship(requests.sparkSession)
    shards = min(shards, capacity)
    rows = requests.select(F.coalesce(key, F.lit("")).alias("agent"), "request_id", "at_seconds")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("agent"), F.lit(shards)))
    out = rows.groupBy("shard").transformWithStateInPandas(
        Buckets(rate, burst, capacity // shards, idle_ms), "agent string, request_id long, allowed boolean", "append", "None" if idle_ms is None else "processingTime"
    )
    return out.withColumnRenamed("agent", key)


def tracked(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(shard, agent, tokens, at, used) of the buckets that a query's state holds, as its last batch left them."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "buckets").load()
    return state.select(F.col("key.shard").alias("shard"), F.col("user_map_key.agent").alias("agent"), "user_map_value.*")
