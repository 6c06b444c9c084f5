from dataclasses import replace

import pytest

from basalt.operators.rules import All, Any, Not, Predicate, Rule, Technique, choices, matches, violation, vocabulary
from test_contract import event, frame

GOOD = Rule(
    "login.refused_for_service_account",
    Any((All((Predicate("authentication.outcome", "one_of", ("failure", "unspecified")), Predicate("authentication.user.name", "starts_with", ("root",)), Not(Predicate("authentication.network.source.ip", "starts_with", ("10.",))))), Predicate("authentication.user.uid", "equals", ("-1",)))),
    technique=Technique("initial_access", "T1078", "Valid accounts"),
)


def nested(depth):
    term = Predicate("event_id", "present")
    for _ in range(depth):
        term = Not(term)
    return term


BROKEN = [
    ({"id": ""}, "id"), ({"id": "Upper"}, "id"), ({"id": "a.b.v2"}, "id"), ({"id": "a" * 121}, "id"), ({"revision": 0}, "revision"), ({"name": " "}, "name"),
    ({"name": "n" * 201}, "name"), ({"description": ""}, "description"), ({"false_positives": "f" * 2001}, "false_positives"), ({"severity": "urgent"}, "severity"),
    ({"status": "on"}, "status"), ({"technique": Technique("credential_access")}, "technique"), ({"technique": Technique("guessing", "T1110", "x")}, "technique.tactic"),
    ({"technique": Technique("impact", "T11", "x")}, "technique.id"), ({"event_class": 0}, "class"), ({"event_class": 9}, "class"), ({"match": None}, "match"),
    ({"match": All(())}, "match.all"), ({"match": Any((Not(All(())),))}, "match.any[0].not.all"), ({"match": "text"}, "match"), ({"match": nested(17)}, "match" + ".not" * 17),
    ({"match": Predicate("no.such", "present")}, "match.no.such"), ({"match": Predicate("event_id", "like", ("a",))}, "match.event_id"),
    ({"match": Predicate("event_id", "above", (1,))}, "match.event_id"), ({"match": Predicate("event_id", "equals")}, "match.event_id"),
    ({"match": Predicate("event_id", "equals", ("a", "b"))}, "match.event_id"), ({"match": Predicate("event_id", "equals", (1,))}, "match.event_id"),
    ({"match": Predicate("event_id", "equals", (" ",))}, "match.event_id"), ({"match": Predicate("event_id", "present", ("a",))}, "match.event_id"),
    ({"match": Predicate("authentication.outcome", "equals", ("maybe",))}, "match.authentication.outcome"),
    ({"match": Predicate("schema_version", "one_of", tuple(range(4097)))}, "match.schema_version"), ({"match": Predicate("time.event_time", "present")}, "match.time.event_time"),
]


def test_good_rule():
    assert violation(GOOD) is None
    assert violation(replace(GOOD, match=nested(16))) is None


@pytest.mark.parametrize(("change", "part"), BROKEN)
def test_broken_rule(change, part):
    assert violation(replace(GOOD, **change))[0] == part


def test_vocabulary():
    kinds = list(vocabulary().values())
    assert (len(kinds), kinds.count("text"), kinds.count("number"), kinds.count("choice")) == (29, 21, 4, 4)
    assert choices("authentication.outcome") == ["unspecified", "success", "failure"]


def test_evaluation(spark):
    df = frame(spark, [event(), event(authentication__network__source__ip="10.0.0.1"), event(authentication__network=None), event(event_class=0)])
    rules = [
        GOOD,
        Rule("port.high", Predicate("authentication.network.source.port", "above", (50000,))),
        Rule("port.none", Not(Predicate("authentication.network.source.port", "present"))),
        Rule("any.of", Any((Predicate("origin.host.hostname", "ends_with", (".example",)), Predicate("event_id", "contains", ("zzz",))))),
        Rule("off", Predicate("event_id", "present"), status="disabled"),
    ]
    got = {(r.i, r.rule_id) for r in matches(df, rules).collect()}
    assert got == {(0, GOOD.id), (2, GOOD.id), (0, "port.high"), (1, "port.high"), (2, "port.none"), (0, "any.of"), (1, "any.of"), (2, "any.of")}
    assert matches(df, []).count() == 0
    with pytest.raises(ValueError, match="revision"):
        matches(df, [replace(GOOD, revision=0)])


def test_five_hundred_rules(spark):
    df = frame(spark, [event(), event(authentication__network__source__port=7)])
    rules = [Rule(f"port.r{i}", Predicate("authentication.network.source.port", "equals", (i,))) for i in range(500)] + [GOOD]
    got = {(r.i, r.rule_id) for r in matches(df, rules).collect()}
    assert got == {(1, "port.r7"), (0, GOOD.id), (1, GOOD.id)}
