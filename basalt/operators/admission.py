"""Admission: a batch of events is accepted as a whole or refused for its first fault."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import AGENT_ID, BATCH_ID, BATCH_ID_BYTES, MAX_AGE_SECONDS, MAX_SKEW_SECONDS, PROTOCOL_VERSIONS, SCHEMA_VERSIONS, outside_window, violation

#: Status of each rejection code.
STATUS = {
    "unauthenticated_agent": 403,
    "rate_limited": 429,
    "unsupported_media_type": 415,
    "body_too_large": 413,
    "malformed_payload": 400,
    "empty_batch": 422,
    "batch_too_large": 422,
    "malformed_batch_id": 422,
    "invalid_event": 422,
    "unsupported_protocol_version": 426,
    "backbone_unavailable": 503,
}
MEDIA_TYPES = ("application/x-protobuf", "application/protobuf")


@dataclass(frozen=True)
class Policy:
    gateway: str = "gateway-a"
    max_events: int = 1000
    max_body_bytes: int = 8 << 20
    skew_seconds: int = MAX_SKEW_SECONDS
    age_seconds: int = MAX_AGE_SECONDS


def stamp(event: Column, agent_id: Column, tenant_id: Column, received: Column, gateway: Column, batch_id: Column) -> Column:
    """What the platform knows replaces what the agent claims: identity, tenant and reception."""
    host = event["origin"]["host"]
    event = event.withField("origin", F.struct(tenant_id.alias("tenant_id"), agent_id.alias("agent_id"), host.alias("host")))
    return event.withField("reception", F.struct(received.alias("ingest_time"), gateway.alias("gateway"), batch_id.alias("batch_id")))


def admit(batches: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """batches(batch_id, protocol_version, events, agent_id, tenant_id, received) with a verdict on each.

    Adds accepted, code, field, event_index (-1 where no event is at fault), detail, events (stamped) and
    n_valid, the events before the first fault. A batch is one row, so nothing is shuffled.
    """
    stamped = F.transform("events", lambda e: stamp(e, F.col("agent_id"), F.col("tenant_id"), F.col("received"), F.lit(policy.gateway), F.col("batch_id")))
    batches = batches.withColumn("events", stamped)

    def check(e: Column) -> Column:
        return F.coalesce(violation(e), outside_window(e, F.col("received"), policy.skew_seconds, policy.age_seconds))

    found = F.transform("events", lambda e, i: F.struct(i.alias("i"), check(e).alias("v")))
    n = F.coalesce(F.size("events"), F.lit(0))
    low, high = PROTOCOL_VERSIONS
    batch_id = F.coalesce("batch_id", F.lit(""))
    code = (
        F.when(n <= 0, "empty_batch")
        .when(n > policy.max_events, "batch_too_large")
        .when(~F.coalesce("protocol_version", F.lit(0)).between(low, high), "unsupported_protocol_version")
        .when((batch_id == "") | (F.octet_length(batch_id) > BATCH_ID_BYTES) | ~batch_id.rlike(BATCH_ID), "malformed_batch_id")
    )
    out = batches.withColumn("_batch_code", code).withColumn("_found", F.when(F.col("_batch_code").isNull(), F.filter(found, lambda x: x["v"].isNotNull())))
    first = F.get("_found", F.lit(0))
    return (
        out.withColumn("_first", first)
        .withColumn("code", F.coalesce("_batch_code", F.when(F.col("_first").isNotNull(), "invalid_event")))
        .withColumn("accepted", F.col("code").isNull())
        .withColumn("field", F.col("_first.v.field"))
        .withColumn("detail", F.col("_first.v.reason"))
        .withColumn("event_index", F.when(F.col("_first").isNotNull(), F.col("_first.i")).when(F.col("code").isNotNull(), -1))
        .withColumn("n_valid", F.when(F.col("_batch_code").isNotNull(), 0).otherwise(F.coalesce("_first.i", n)))
        .drop("_batch_code", "_found", "_first")
    )


def gate(requests: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The transport's checks before admission, in order: adds refusal (a code, or null).

    Reads identity, allowed (by the rate limit), media_type, body_bytes, readable and decoded.
    """
    media = F.lower(F.trim(F.split("media_type", ";")[0]))
    refusal = (
        F.when(~F.coalesce(F.col("identity").rlike(AGENT_ID), F.lit(False)), "unauthenticated_agent")
        .when(~F.col("allowed"), "rate_limited")
        .when(~F.coalesce(media.isin(*MEDIA_TYPES), F.lit(False)), "unsupported_media_type")
        .when(F.col("body_bytes") > policy.max_body_bytes, "body_too_large")
        .when(~F.col("readable") | ~F.col("decoded"), "malformed_payload")
    )
    return requests.withColumn("refusal", refusal)


def status(code: Column) -> Column:
    """HTTP status of a rejection code; 200 for none."""
    out = F.when(code.isNull(), 200)
    for name, number in STATUS.items():
        out = out.when(code == name, number)
    return out.otherwise(500)


def status_class(number: Column) -> Column:
    return F.when(number.between(200, 599), F.concat(F.floor(number / 100).cast("string"), F.lit("xx"))).otherwise("unknown")


def settle(admitted: DataFrame, durable: Column) -> DataFrame:
    """What admission decided, once the write is over: a batch that was accepted and isn't durable is refused as backbone_unavailable."""
    lost = F.col("accepted") & ~F.coalesce(durable, F.lit(False))
    return (
        admitted.withColumn("code", F.when(lost, "backbone_unavailable").otherwise(F.col("code")))
        .withColumn("event_index", F.when(lost, -1).otherwise(F.col("event_index")))
        .withColumn("accepted", F.col("accepted") & ~lost)
    )


def acknowledgements(settled: DataFrame) -> DataFrame:
    """(batch_id, accepted, durable, received) of accepted batches; settle() has to come first, so that these are written."""
    return settled.filter("accepted").select("batch_id", F.lit(True).alias("accepted"), F.lit(True).alias("durable"), F.size("events").cast("long").alias("received"))


def rejections(admitted: DataFrame) -> DataFrame:
    """(batch_id, code, detail, field, event_index) of refused batches."""
    return admitted.filter("NOT accepted").select("batch_id", "code", "detail", "field", "event_index")


def descriptor(df_of_one_row: DataFrame) -> DataFrame:
    """What the platform speaks: ranges of protocol and schema versions."""
    names = ("protocol_min", "protocol_max", "schema_min", "schema_max")
    return df_of_one_row.select(*[F.lit(v).cast("int").alias(n) for n, v in zip(names, (*PROTOCOL_VERSIONS, *SCHEMA_VERSIONS), strict=True)])
