import copy
import ipaddress
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt.functions.address import canonical, is_address
from basalt.functions.text import fold, hostname, trim
from basalt.operators.admission import Policy, acknowledgements, admit, rejections, status
from basalt.operators.contract import EVENT_TYPE, leaves, outside_window, unstorable, violation
from basalt.operators.project import COLUMNS, ENUM, PORT, TEXT, TIME, project
from basalt.operators.route import TREATMENT, analyse, classify_for_analysis, classify_for_store

NOW = datetime(2026, 8, 16, 12, tzinfo=timezone.utc)


def event(**changes):
    """A full event; changes name leaves or parts by path, with __ for a dot."""
    e = {
        "event_id": "11111111-2222-4333-8444-555555555555",
        "schema_version": 1,
        "event_class": 1,
        "time": {"event_time": NOW, "observed_time": NOW},
        "origin": {"tenant_id": "acme", "agent_id": "web-01", "host": {"hostname": "web-01.acme.example", "ip": "198.51.100.7", "os": "linux", "architecture": "amd64"}},
        "collection": {"collector": "ssh.authlog", "source": "/var/log/auth.log", "sequence": Decimal(42)},
        "reception": {"ingest_time": NOW, "gateway": "gateway-a", "batch_id": "batch-1"},
        "authentication": {
            "activity": 1,
            "outcome": 2,
            "outcome_reason": "failed_password",
            "method": "password",
            "user": {"name": "root", "domain": "acme", "uid": "0"},
            "service": {"name": "sshd", "protocol": "ssh"},
            "network": {"source": {"ip": "203.0.113.10", "port": 54321}, "destination": {"ip": "198.51.100.5", "port": 22}, "transport": 1},
            "raw_record": "Failed password for root",
        },
    }
    for path, value in changes.items():
        at = e
        *parts, last = path.split("__")
        for p in parts:
            at = at[p]
        at[last] = value
    return e


def frame(spark, events):
    from pyspark.sql.types import LongType, StructField, StructType

    return spark.createDataFrame([(i, e) for i, e in enumerate(events)], StructType([StructField("i", LongType()), StructField("event", EVENT_TYPE)]))


BROKEN = [
    ({"event_id": ""}, "event_id", "shorter"),
    ({"event_id": "abc"}, "event_id", "shorter"),
    ({"event_id": "id with spaces and $ signs"}, "event_id", "malformed"),
    ({"event_id": "evt-00001\n"}, "event_id", "malformed"),
    ({"schema_version": 2}, "schema_version", "between 1 and 1"),
    ({"schema_version": None}, "schema_version", "between"),
    ({"time": None}, "time", "missing"),
    ({"time__event_time": None}, "time.event_time", "missing"),
    ({"time__observed_time": None}, "time.observed_time", "missing"),
    ({"origin": None}, "origin", "missing"),
    ({"origin__agent_id": "../../etc/passwd"}, "origin.agent_id", "malformed"),
    ({"origin__agent_id": "a:b"}, "origin.agent_id", "malformed"),
    ({"origin__tenant_id": ""}, "origin.tenant_id", "required"),
    ({"origin__tenant_id": "é" * 33}, "origin.tenant_id", "longer than 64"),
    ({"origin__host__ip": "not-an-address"}, "origin.host.ip", "not an IP"),
    ({"origin__host__ip": " 1.2.3.4"}, "origin.host.ip", "not an IP"),
    ({"origin__host__os": "o" * 129}, "origin.host.os", "longer"),
    ({"collection": None}, "collection", "missing"),
    ({"collection__collector": ""}, "collection.collector", "required"),
    ({"authentication": None}, "authentication", "required"),
    ({"event_class": 0}, "event_class", "unspecified"),
    ({"event_class": 4242}, "event_class", "unspecified"),
    ({"authentication__activity": 0}, "authentication.activity", "unspecified"),
    ({"authentication__outcome": 0}, "authentication.outcome", "unspecified"),
    ({"authentication__method": "m" * 33}, "authentication.method", "longer"),
    ({"authentication__user__uid": "u" * 65}, "authentication.user.uid", "longer"),
    ({"authentication__network__source__ip": "::1%"}, "authentication.network.source.ip", "not an IP"),
    ({"authentication__network__source__ip": "1" * 46}, "authentication.network.source.ip", "longer than 45"),
    ({"authentication__network__destination__port": 65536}, "authentication.network.destination.port", "outside"),
    ({"authentication__raw_record": "r" * 4097}, "authentication.raw_record", "longer"),
]


def test_first_violation(spark):
    events = [event(**c) for c, *_ in BROKEN] + [None, event(), event(authentication__raw_record="r" * 4096), event(authentication__network=None, authentication__user=None)]
    got = [r["v"] for r in frame(spark, events).select("i", violation(F.col("event")).alias("v")).orderBy("i").collect()]
    for v, (change, field, reason) in zip(got, BROKEN, strict=False):
        assert v is not None, change
        assert v["field"] == field and reason in v["reason"], (change, v)
    assert got[len(BROKEN)]["field"] == "event"
    assert got[len(BROKEN) + 1 :] == [None, None, None]


def test_order_of_violations(spark):
    v = frame(spark, [event(event_id="x", schema_version=2, origin=None, event_class=0)]).select(violation(F.col("event")).alias("v")).first()["v"]
    assert v["field"] == "event_id"


@pytest.mark.parametrize(("delta", "bad"), [(timedelta(minutes=5), None), (timedelta(minutes=6), "ahead"), (-timedelta(hours=48), None), (-timedelta(hours=168), None), (-timedelta(hours=169), "older")])
def test_window(spark, delta, bad):
    v = frame(spark, [event(time__event_time=NOW + delta)]).select(outside_window(F.col("event"), F.lit(NOW)).alias("v")).first()["v"]
    assert (v is None) if bad is None else (v["field"] == "time.event_time" and bad in v["reason"])


def test_storable(spark):
    events = [event(), event(time__event_time=datetime(3000, 1, 1)), event(time__observed_time=datetime(1600, 1, 1))]
    got = [r[0] for r in frame(spark, events).orderBy("i").select(unstorable(F.col("event"))).collect()]
    assert got[0] is None and got[1].startswith("time.event_time") and got[2].startswith("time.observed_time")


def test_every_leaf_is_stored_and_decided():
    assert set(TEXT.values()) | set(ENUM.values()) | set(TIME.values()) | set(PORT.values()) | {"event_id", "schema_version", "collection.sequence"} == set(leaves())
    assert len(COLUMNS) == len(leaves()) == 32
    assert set(TREATMENT) <= set(leaves())


def test_projection(spark):
    full, empty, odd = project(frame(spark, [event(), dict.fromkeys(EVENT_TYPE.fieldNames()), event(authentication__network__source__port=1048576, authentication__network__transport=7)]), keep=("i",)).orderBy("i").collect()
    assert (full.auth_activity, full.auth_outcome, full.auth_transport, full.auth_source_port, full.auth_destination_port, int(full.sequence)) == ("logon", "failure", "tcp", 54321, 22, 42)
    assert (empty.auth_activity, empty.event_class, empty.host_ip, empty.auth_source_port) == ("", "", "", 0)
    assert empty.ingest_time == datetime(1970, 1, 1)
    assert all(empty[c] is not None for c in COLUMNS)
    assert (odd.auth_source_port, odd.auth_transport) == (0, "7")


def test_two_consumers_differ(spark):
    df = frame(spark, [event(event_class=4242), event(event_class=0), event(), event(time__event_time=datetime(3000, 1, 1))])
    assert [r.outcome for r in classify_for_store(df).orderBy("i").collect()] == ["contract_violation", "contract_violation", "row", "unstorable"]
    got = classify_for_analysis(df).orderBy("i").collect()
    assert [r.outcome for r in got] == ["unrouted", "contract_violation", "analysed", "analysed"]
    assert [r["class"] for r in got] == ["unknown", "unspecified", "authentication", "authentication"]


def test_canonical_form(spark):
    changed = event(origin__host__hostname="WEB-01.", authentication__network__source__ip="::ffff:203.0.113.10", authentication__method="PASSWORD")
    a, b, c = analyse(frame(spark, [changed, event(), event(authentication__user=None)])).orderBy("i").collect()
    assert (a.rewritten, b.rewritten, c.rewritten) == (True, False, False)
    assert a.canonical.origin.host.hostname == "web-01" and a.canonical.authentication.network.source.ip == "203.0.113.10"
    assert a.canonical.authentication.method == "password" and c.canonical.authentication.user is None


TEXTS = [("  MiXeD-Case  ", "mixed-case", "MiXeD-Case"), ("  WEB-01.  ", "web-01.", "WEB-01."), (" a ", "a", "a"), ("", "", "")]


def test_text(spark):
    for raw, folded, trimmed in TEXTS:
        r = spark.createDataFrame([(raw,)], "x string").select(fold(F.col("x")), trim(F.col("x")), hostname(F.col("x"))).first()
        assert (r[0], r[1]) == (folded, trimmed)
        assert r[2] == folded.removesuffix(".")
    assert spark.createDataFrame([("web-01..",)], "x string").select(hostname(F.col("x"))).first()[0] == "web-01."


@settings(max_examples=3, deadline=None)
@given(st.lists(st.one_of(st.ip_addresses(), st.integers(0, 2**64).map(lambda n: ipaddress.IPv6Address(n << 48)), st.text("0123456789abcdef:.%", max_size=20)), min_size=80, max_size=120))
def test_addresses_as_in_ipaddress(spark, some):
    texts = [x if isinstance(x, str) else y for x in some for y in ([x] if isinstance(x, str) else [str(x), x.exploded.upper()])]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", is_address(F.col("x")).alias("ok"), canonical(F.col("x")).alias("c")).collect()
    for r in rows:
        try:
            ip = ipaddress.ip_address(r.x)
        except ValueError:
            assert not r.ok and r.c == r.x
            continue
        assert r.ok
        assert r.c == str(getattr(ip, "ipv4_mapped", None) or ip)


def batches(spark, rows):
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType, TimestampType

    schema = StructType([
        StructField("batch_id", StringType()), StructField("protocol_version", LongType()), StructField("events", ArrayType(EVENT_TYPE)),
        StructField("agent_id", StringType()), StructField("tenant_id", StringType()), StructField("received", TimestampType()),
    ])
    return spark.createDataFrame([(b, v, e, "web-01", "acme", NOW) for b, v, e in rows], schema)


def test_admission(spark):
    bad_ip = event(authentication__network__source__ip="definitely-not-an-ip")
    rows = [("b-ok", 1, [event(origin=None), event(origin__agent_id="domain-controller"), event()]), ("b-bad", 1, [event(), bad_ip, event(event_id="")]), ("b-none", 1, []), ("b-null", 1, None), ("b-many", 1, [event()] * 11), ("b-old", 2, [event()]), ("batch id; drop table", 1, [event()]), ("b" * 65, 1, [event()]), (None, 1, [event()])]
    out = admit(batches(spark, rows), Policy(max_events=10)).collect()
    by = {r.batch_id: r for r in out}
    ok = by["b-ok"]
    assert ok.accepted and {e.origin.agent_id for e in ok.events} == {"web-01"} and {e.reception.batch_id for e in ok.events} == {"b-ok"}
    bad = by["b-bad"]
    assert (bad.code, bad.event_index, bad.field, bad.n_valid) == ("invalid_event", 1, "authentication.network.source.ip", 1)
    assert [by[k].code for k in ("b-none", "b-null", "b-many", "b-old", "batch id; drop table", "b" * 65, None)] == ["empty_batch", "empty_batch", "batch_too_large", "unsupported_protocol_version"] + ["malformed_batch_id"] * 3
    admitted = admit(batches(spark, rows), Policy(max_events=10))
    assert [(r.batch_id, r.received) for r in acknowledgements(admitted).collect()] == [("b-ok", 3)]
    assert rejections(admitted).count() == len(rows) - 1
    assert admitted.filter("code = 'unsupported_protocol_version'").select(status(F.col("code"))).first()[0] == 426


def test_event_helper_makes_copies():
    assert event() == copy.deepcopy(event())


def test_trimming_and_hostnames_as_their_patterns(spark):
    import re

    space = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    ends = [*space, "", "\x1c", "᠎", "​", "é", ".", "..", ". ", " ."]
    texts = [f"{a}A b{b}" for a in ends for b in ends] + [" ", space, ".", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("t", trim(F.col("t")).alias("a"), hostname(F.col("t")).alias("h"), F.regexp_replace("t", r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+\z", "").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] == [None if t is None else re.sub(f"^[{space}]+|[{space}]+\\Z", "", t) for t in texts]
    assert [r.h for r in rows] == [r.b if r.b is None else re.sub(r"\.\Z", "", r.b.lower()) for r in rows]


def test_functions_of_arrays_are_left_to_texts_with_a_colon(spark):
    from conftest import SF

    from basalt.plans.queries import normalized_events

    # generated code has no functions of arrays: what holds one for every row is interpreted for every row
    plan = normalized_events(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN Contains(") >= 3
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
