"""Rules as rows: validation by a walk of all trees, and matching through the index, against rules as objects."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pyspark.sql import functions as F

from basalt.operators import rule_index, rule_trees, rules, text_patterns
from basalt.operators.rules import All, Any, Not, Predicate, Rule
from basalt.plans import queries
from conftest import SF
from test_contract import event, frame
from test_rules import BROKEN, GOOD, nested


def test_walk_finds_what_violation_finds(spark):
    some = [replace(GOOD, **{"id": f"login.case{i}", **change}) for i, (change, _) in enumerate(BROKEN)]
    some += [replace(GOOD, id="good.one"), replace(GOOD, id="good.deep", match=nested(16)), replace(GOOD, id="deep.group", match=All((nested(3), Any((nested(15),)))))]
    some += [replace(GOOD, id="two.faults", match=All((GOOD.match, Any(()), Predicate("no.such", "present"))))]
    want = {(r.id, *bad) for r in some if (bad := rules.violation(r))}
    got = {tuple(r) for r in rule_trees.faults(*rule_trees.tables(spark, some)).collect()}
    # a term that isn't one may be of any kind, and None has no node
    assert got == {(i, p, "not a term of the language" if p == "match" and "text" in r else r) for i, p, r in want}
    assert len(got) == len(BROKEN) + 2


def test_written_trees_that_no_object_can_be(spark):
    headers, _ = rule_trees.to_rows([replace(GOOD, id=f"odd.r{i}") for i in range(6)])
    leaf = ("predicate", "event_id", "present", [])
    nodes = [
        ("odd.r0", 1, None, 0, *leaf), ("odd.r0", 2, None, 1, *leaf),
        ("odd.r1", 1, None, 0, "not", None, None, None), ("odd.r1", 2, 1, 0, *leaf), ("odd.r1", 3, 1, 1, *leaf),
        ("odd.r2", 1, None, 0, "not", None, None, None),
        ("odd.r3", 1, None, 0, *leaf), ("odd.r3", 5, 6, 0, "not", None, None, None), ("odd.r3", 6, 5, 0, "not", None, None, None),
        ("odd.r4", 1, None, 0, "all", None, None, None), ("odd.r4", 2, 1, 9, *leaf), ("odd.r4", 3, 1, 4, "predicate", None, None, None),
        ("ghost.r", 1, None, 0, *leaf),
    ]
    got = {r.rule_id: (r.part, r.reason) for r in rule_trees.faults(spark.createDataFrame(headers, rule_trees.HEADERS), spark.createDataFrame(nodes, rule_trees.NODES)).collect()}
    assert got == {
        "odd.r0": ("match", "not a term of the language"), "odd.r1": ("match.not", "takes one term"), "odd.r2": ("match.not", "no term"),
        "odd.r3": ("match", "has terms that are not below its top"), "odd.r4": ("match.all[0].", "no such field"), "odd.r5": ("match", "no term"), "ghost.r": ("id", "has no header"),
    }
    empty = rule_trees.faults(spark.createDataFrame([], rule_trees.HEADERS), spark.createDataFrame([], rule_trees.NODES))
    assert empty.collect() == []


def some_rules(n, seed=3):
    rng = random.Random(seed)
    texts = {"origin.host.hostname": ["host-1", "web", "example", "ap"], "authentication.user.name": ["root", "deploy", "oo"], "authentication.network.source.ip": ["203.0.113.10", "10.", "113"], "event_id": ["11111111", "-", "x"]}

    def predicate():
        kind = rng.randrange(6)
        if kind == 0:
            return Predicate("authentication.network.source.port", rng.choice(["above", "at_least", "below", "at_most", "equals"]), (rng.choice([7, 22, 54321, 60000]),))
        if kind == 1:
            return Predicate("authentication.outcome", "one_of", tuple(rng.sample(["unspecified", "success", "failure"], 2)))
        f = rng.choice(list(texts))
        if kind == 2:
            return Predicate(f, "present")
        if kind == 3:
            return Predicate(f, "one_of", tuple(rng.sample(texts[f], 2)))
        return Predicate(f, rng.choice(["contains", "starts_with", "ends_with", "equals"]), (rng.choice(texts[f]),))

    def term(depth):
        kind = rng.randrange(5) if depth else 4
        if kind < 3:
            return (All, Any)[kind % 2](tuple(term(depth - 1) for _ in range(rng.randint(1, 3))))
        return Not(term(depth - 1)) if kind == 3 else predicate()

    return [Rule(f"made.r{i}", term(4), severity=rng.choice(rules.SEVERITIES), status=rng.choice(["active"] * 5 + ["draft"])) for i in range(n)]


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_index_matches_as_expressions_do(spark, broadcast, tmp_path):
    events = [event(), event(authentication__network__source__ip="10.0.0.1"), event(authentication__network=None), event(event_class=0), event(origin__host__hostname="host-1", authentication__user__name="deploy"), event(), event(authentication=None)]
    df = frame(spark, events)
    some = [*some_rules(120), GOOD, Rule("twice.hit", Any((Predicate("origin.host.hostname", "contains", ("e",)), Predicate("event_id", "contains", ("1",)), Predicate("authentication.outcome", "equals", ("failure",)))))]
    want = sorted((r.i, r.rule_id, r.severity) for r in rules.matches(df, some).collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        index = rule_index.build(*rule_trees.tables(spark, some), str(tmp_path / "index"))
        assert 0 < index.postings.filter(F.col("key") == rule_index.ALWAYS).count() < 100
        got = rule_index.matches(df, index)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange hashpartitioning" in plan) == (broadcast == "-1")
        assert sorted((r.i, r.rule_id, r.severity) for r in got.collect()) == want and len(want) > 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_index_refuses_and_is_empty(spark, tmp_path):
    with pytest.raises(ValueError, match="revision"):
        rule_index.build(*rule_trees.tables(spark, [replace(GOOD, revision=0)]), str(tmp_path / "a"))
    with pytest.raises(ValueError, match="one id"):
        headers, nodes = rule_trees.tables(spark, [GOOD])
        rule_index.build(headers.union(headers), nodes, str(tmp_path / "b"))
    assert rule_index.matches(frame(spark, [event()]), rule_index.build(*rule_trees.tables(spark, []), str(tmp_path / "c"))).count() == 0


def test_thousands_of_rules_with_thousands_of_values(spark, tmp_path):
    df = frame(spark, [event(origin__host__hostname="host-4095"), event()])
    names = tuple(f"host-{i}" for i in range(4096))
    many = [Rule(f"many.r{i}", All((Predicate("origin.host.hostname", "one_of", names[i:] + names[:i] if i < 2 else (f"host-{i}",)), Predicate("authentication.outcome", "equals", ("failure",))))) for i in range(5000)]
    index = rule_index.build(*rule_trees.tables(spark, many), str(tmp_path / "index"))
    assert index.fields == ["origin.host.hostname"]  # all of them need the outcome as well, so it tells little
    assert {(r.i, r.rule_id) for r in rule_index.matches(df, index).collect()} == {(0, "many.r0"), (0, "many.r1"), (0, "many.r4095")}


def test_literals_against_plain_search(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["", None]
    literals = [("t", o, "".join(rng.choice("ab é") for _ in range(rng.randint(0, 3)))) for o in text_patterns.OPERATORS for _ in range(40)] + [("u", "contains", "a"), ("u", "ends_with", "b")]
    df = spark.createDataFrame([(i, t, None if t is None else t[::-1]) for i, t in enumerate(texts)], "i int, t string, u string")
    test = {"contains": lambda t, x: x in t, "starts_with": str.startswith, "ends_with": str.endswith}
    want = {(i, f, o, x) for i, t in enumerate(texts) for f, o, x in literals if t is not None and test[o](t if f == "t" else t[::-1], x)}
    for size in (text_patterns.BLOCK_BYTES, 200):
        monkeypatch.setattr(text_patterns, "BLOCK_BYTES", size)
        got = [(r.i, r.field, r.operator, r.literal) for r in text_patterns.hits(df, ["t", "u"], literals).collect()]
        assert set(got) == want and len(got) == len(want)
    with pytest.raises(ValueError):
        text_patterns.hits(df, ["t"], [("t", "like", "a")])


@pytest.mark.parametrize("name", ["rule_matches_indexed", "rule_index_hits", "literal_hits", "rule_tree_faults"])
def test_queries_as_their_sql(same_rows, spark, name):
    same_rows(queries.QUERIES[name], queries.ORACLES[name])
    assert queries.QUERIES[name](spark, SF).limit(1).count() == 1
