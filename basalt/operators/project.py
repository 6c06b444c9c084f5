"""From the nested event to the store's flat row; absence is the zero value, no column is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import enum_name, get

TEXT = {
    "tenant_id": "origin.tenant_id",
    "agent_id": "origin.agent_id",
    "host_hostname": "origin.host.hostname",
    "host_ip": "origin.host.ip",
    "host_os": "origin.host.os",
    "host_architecture": "origin.host.architecture",
    "collector": "collection.collector",
    "source": "collection.source",
    "gateway": "reception.gateway",
    "batch_id": "reception.batch_id",
    "auth_outcome_reason": "authentication.outcome_reason",
    "auth_method": "authentication.method",
    "auth_user_name": "authentication.user.name",
    "auth_user_domain": "authentication.user.domain",
    "auth_user_uid": "authentication.user.uid",
    "auth_service_name": "authentication.service.name",
    "auth_service_protocol": "authentication.service.protocol",
    "auth_source_ip": "authentication.network.source.ip",
    "auth_destination_ip": "authentication.network.destination.ip",
    "auth_raw_record": "authentication.raw_record",
}
ENUM = {
    "event_class": "event_class",
    "auth_activity": "authentication.activity",
    "auth_outcome": "authentication.outcome",
    "auth_transport": "authentication.network.transport",
}
TIME = {"event_time": "time.event_time", "observed_time": "time.observed_time", "ingest_time": "reception.ingest_time"}
PORT = {"auth_source_port": "authentication.network.source.port", "auth_destination_port": "authentication.network.destination.port"}

# The store's columns, in its order.
COLUMNS = (
    "event_id schema_version event_class event_time observed_time ingest_time tenant_id agent_id host_hostname host_ip host_os host_architecture "
    "collector source sequence gateway batch_id auth_activity auth_outcome auth_outcome_reason auth_method auth_user_name auth_user_domain auth_user_uid "
    "auth_service_name auth_service_protocol auth_source_ip auth_source_port auth_destination_ip auth_destination_port auth_transport auth_raw_record"
).split()


def instant(c: Column) -> Column:
    """Cut to milliseconds; an absent time is the epoch."""
    return F.date_trunc("millisecond", F.coalesce(c, F.timestamp_seconds(F.lit(0))))


def port(c: Column) -> Column:
    """A number that no port can have is 0, as is an absent one."""
    return F.when(c.between(0, 65535), c).otherwise(0).cast("int")


def row(event: Column) -> dict[str, Column]:
    """The 32 columns of an event."""
    out = {"event_id": F.coalesce(event["event_id"], F.lit("")), "schema_version": F.coalesce(event["schema_version"], F.lit(0))}
    out |= {name: F.coalesce(get(event, path), F.lit("")) for name, path in TEXT.items()}
    out |= {name: enum_name(get(event, path), path) for name, path in ENUM.items()}
    out |= {name: instant(get(event, path)) for name, path in TIME.items()}
    out |= {name: port(get(event, path)) for name, path in PORT.items()}
    out["sequence"] = F.coalesce(get(event, "collection.sequence"), F.lit(0).cast("decimal(20,0)"))
    return out


def project(df: DataFrame, event: str = "event", keep: tuple[str, ...] = ()) -> DataFrame:
    """The store's columns, and those of df to keep, which come last."""
    made = row(F.col(event))
    return df.select(*[made[c].alias(c) for c in COLUMNS], *keep)
