"""The event contract: schema, enums, limits, and the first violation of each event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.address import is_address

# The enums' members that are known, by number.
ENUMS = {
    "event_class": {0: "unspecified", 1: "authentication"},
    "authentication.activity": {0: "unspecified", 1: "logon"},
    "authentication.outcome": {0: "unspecified", 1: "success", 2: "failure"},
    "authentication.network.transport": {0: "unspecified", 1: "tcp"},
}

# Limits of the contract, in bytes where they are lengths.
LIMITS = {
    "origin.tenant_id": 64,
    "origin.host.hostname": 255,
    "origin.host.ip": 45,
    "origin.host.os": 128,
    "origin.host.architecture": 32,
    "collection.collector": 64,
    "collection.source": 512,
    "authentication.outcome_reason": 64,
    "authentication.method": 32,
    "authentication.user.name": 256,
    "authentication.user.domain": 255,
    "authentication.user.uid": 64,
    "authentication.service.name": 64,
    "authentication.service.protocol": 32,
    "authentication.raw_record": 4096,
}
IP_BYTES, EVENT_ID_LEAST, BATCH_ID_BYTES = 45, 8, 64
SCHEMA_VERSIONS = PROTOCOL_VERSIONS = (1, 1)
EVENT_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,63}\z"
AGENT_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}\z"
BATCH_ID = EVENT_ID
STORE_FROM, STORE_TO = "1900-01-01 00:00:00", "2262-04-11 23:47:16"
MAX_SKEW_SECONDS, MAX_AGE_SECONDS = 5 * 60, 168 * 3600

_TEXT, _INT, _LONG, _TIME = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_ENDPOINT = _struct(ip=_TEXT, port=_LONG)
EVENT_TYPE = _struct(
    event_id=_TEXT,
    schema_version=_LONG,
    event_class=_INT,
    time=_struct(event_time=_TIME, observed_time=_TIME),
    origin=_struct(tenant_id=_TEXT, agent_id=_TEXT, host=_struct(hostname=_TEXT, ip=_TEXT, os=_TEXT, architecture=_TEXT)),
    collection=_struct(collector=_TEXT, source=_TEXT, sequence=T.DecimalType(20, 0)),
    reception=_struct(ingest_time=_TIME, gateway=_TEXT, batch_id=_TEXT),
    authentication=_struct(
        activity=_INT,
        outcome=_INT,
        outcome_reason=_TEXT,
        method=_TEXT,
        user=_struct(name=_TEXT, domain=_TEXT, uid=_TEXT),
        service=_struct(name=_TEXT, protocol=_TEXT),
        network=_struct(source=_ENDPOINT, destination=_ENDPOINT, transport=_INT),
        raw_record=_TEXT,
    ),
)


def leaves(schema: T.StructType = EVENT_TYPE, above: str = "") -> dict[str, T.DataType]:
    """Path -> type of every leaf, in order."""
    out: dict[str, T.DataType] = {}
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out |= leaves(f.dataType, f"{above}{f.name}.")
        else:
            out[above + f.name] = f.dataType
    return out


def get(event: Column, path: str) -> Column:
    for part in path.split("."):
        event = event[part]
    return event


def enum_name(c: Column, path: str, zero: str = "", undeclared: str | None = None) -> Column:
    """Short name of an enum's number; `zero` for 0 and null; an undeclared number as text, or as `undeclared`."""
    out = F.when(F.coalesce(c, F.lit(0)) == 0, zero)
    for number, name in ENUMS[path].items():
        if number:
            out = out.when(c == number, name)
    return out.otherwise(c.cast("string") if undeclared is None else F.lit(undeclared))


@dataclass(frozen=True)
class _Checks:
    """Collects (condition, field, reason) in the order in which they are to be reported."""

    event: Column
    found: list

    def add(self, bad: Column, field: str, reason: str) -> None:
        self.found.append(F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"))))

    def missing(self, path: str) -> None:
        self.add(get(self.event, path).isNull(), path, "is missing")

    def text(self, path: str, required: bool = False) -> None:
        c = get(self.event, path)
        if required:
            self.add(F.coalesce(c, F.lit("")) == "", path, "is required")
        self.add(F.octet_length(c) > LIMITS[path], path, f"is longer than {LIMITS[path]} bytes")

    def ip(self, path: str) -> None:
        c = get(self.event, path)
        self.add(F.octet_length(c) > IP_BYTES, path, f"is longer than {IP_BYTES} bytes")
        self.add((c != "") & ~is_address(c), path, "is not an IP address")


def violation(event: Column) -> Column:
    """struct(field, reason) of the first rule that an event breaks, null if it keeps the contract."""
    c = _Checks(event, [])
    c.add(event.isNull(), "event", "is missing")
    event_id = F.coalesce(event["event_id"], F.lit(""))
    c.add(F.octet_length(event_id) < EVENT_ID_LEAST, "event_id", f"is shorter than {EVENT_ID_LEAST} characters")
    c.add(~event_id.rlike(EVENT_ID), "event_id", "is malformed")
    low, high = SCHEMA_VERSIONS
    c.add(~F.coalesce(event["schema_version"], F.lit(0)).between(low, high), "schema_version", f"must be between {low} and {high}")
    c.missing("time")
    c.missing("time.event_time")
    c.missing("time.observed_time")
    c.missing("origin")
    c.add(~F.coalesce(get(event, "origin.agent_id"), F.lit("")).rlike(AGENT_ID), "origin.agent_id", "is missing or malformed")
    c.text("origin.tenant_id", required=True)
    c.text("origin.host.hostname")
    c.ip("origin.host.ip")
    c.text("origin.host.os")
    c.text("origin.host.architecture")
    c.missing("collection")
    c.text("collection.collector", required=True)
    c.text("collection.source")
    number = F.coalesce(event["event_class"], F.lit(0))
    c.add((number == 1) & event["authentication"].isNull(), "authentication", "is required for this event class")
    c.add(number != 1, "event_class", "is unspecified or unknown")
    c.add(F.coalesce(get(event, "authentication.activity"), F.lit(0)) == 0, "authentication.activity", "is unspecified")
    c.add(F.coalesce(get(event, "authentication.outcome"), F.lit(0)) == 0, "authentication.outcome", "is unspecified")
    for path in ("outcome_reason", "method", "user.name", "user.domain", "user.uid", "service.name", "service.protocol"):
        c.text(f"authentication.{path}")
    for end in ("source", "destination"):
        c.ip(f"authentication.network.{end}.ip")
        port = get(event, f"authentication.network.{end}.port")
        c.add((port < 0) | (port > 65535), f"authentication.network.{end}.port", "is outside 0..65535")
    c.text("authentication.raw_record")
    return F.coalesce(*c.found)


def outside_window(event: Column, now: Column, skew_seconds: int = MAX_SKEW_SECONDS, age_seconds: int = MAX_AGE_SECONDS) -> Column:
    """Admission's window, which replays don't apply: struct(field, reason) or null."""
    found = []
    for path in ("time.event_time", "time.observed_time"):
        t = get(event, path)
        ahead = f"is more than {_duration(skew_seconds)} ahead of the platform clock"
        old = f"is older than the {_duration(age_seconds)} admission window"
        for bad, reason in ((t > now + F.expr(f"interval {skew_seconds} seconds"), ahead), (t < now - F.expr(f"interval {age_seconds} seconds"), old)):
            found.append(F.when(bad, F.struct(F.lit(path).alias("field"), F.lit(reason).alias("reason"))))
    return F.coalesce(*found)


def _duration(seconds: int) -> str:
    hours, rest = divmod(seconds, 3600)
    minutes, left = divmod(rest, 60)
    return f"{hours}h" * (hours > 0) + f"{minutes}m" * (hours > 0 or minutes > 0) + f"{left}s"


def unstorable(event: Column) -> Column:
    """Why the store can't hold an event's times, or null."""
    found = []
    for path in ("time.event_time", "time.observed_time", "reception.ingest_time"):
        t = get(event, path)
        out = (t < F.lit(STORE_FROM).cast("timestamp")) | (t > F.lit(STORE_TO).cast("timestamp"))
        found.append(F.when(out, F.lit(f"{path} is outside the 1900-01-01..2262-04-11 the store can hold")))
    return F.coalesce(*found)
