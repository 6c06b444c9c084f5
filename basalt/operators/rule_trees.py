"""Rules as rows: a header for each rule, and its match as nodes that name their parents.

Validation is a recursive query over the nodes: it walks all trees at once, a level a round, and knows the path, the
depth and the place in order of each node it meets; the first fault in order is a rule's answer, as violation() has it
for a rule that is written as an object.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contract import ENUMS
from .rules import MAX_DEPTH, OPERATORS, SEVERITIES, STATUSES, TACTICS, All, Any, Not, Predicate, Rule, choices, vocabulary
from .rules import _RULE_ID, _TECHNIQUE_ID, _VERSIONED

HEADERS = (
    "rule_id string, revision long, name string, description string, false_positives string, response string, severity string, status string, "
    "tactic string, technique_id string, technique_name string, event_class int"
)
#: kind is predicate, all, any or not; a value's kind is text, number or truth; the topmost node has no parent.
NODES = "rule_id string, node long, parent long, ordinal int, kind string, field string, operator string, values array<struct<kind: string, value: string>>"


def value_of(v: object) -> tuple[str, str]:
    return ("truth", str(v).lower()) if isinstance(v, bool) else ("number", repr(float(v))) if isinstance(v, int | float) else ("text", v)


def to_rows(rules: Iterable[Rule]) -> tuple[list[tuple], list[tuple]]:
    """(headers, nodes) of rules that are written as objects."""
    headers, nodes = [], []
    for r in rules:
        t = r.technique
        headers.append((r.id, r.revision, r.name, r.description, r.false_positives, r.response, r.severity, r.status, t.tactic, t.id, t.name, r.event_class))
        number = count()
        todo = [(r.match, None, 0)]
        while todo:
            term, parent, ordinal = todo.pop()
            if term is None:
                continue
            node = next(number)
            if isinstance(term, Predicate):
                nodes.append((r.id, node, parent, ordinal, "predicate", term.field, term.operator, [value_of(v) for v in term.values]))
                continue
            below = (term.term,) if isinstance(term, Not) else term.terms if isinstance(term, All | Any) else ()
            nodes.append((r.id, node, parent, ordinal, type(term).__name__.lower(), None, None, None))
            todo += [(x, node, i) for i, x in enumerate(below)]
    return headers, nodes


def tables(spark: SparkSession, rules: Iterable[Rule]) -> tuple[DataFrame, DataFrame]:
    headers, nodes = to_rows(rules)
    return spark.createDataFrame(headers, HEADERS), spark.createDataFrame(nodes, NODES)


def _fault(*checks: tuple[Column, Column | str, str]) -> Column:
    """(part, reason) of the first check that holds, or null."""
    part = lambda p: F.lit(p) if isinstance(p, str) else p
    return F.coalesce(*[F.when(wrong, F.struct(part(p).alias("part"), F.lit(reason).alias("reason"))) for wrong, p, reason in checks])


def _header_fault() -> Column:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    blank = lambda c: F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "") == ""
    over = lambda c, n: F.octet_length(text(c)) > n
    given = (text("tactic") != "") | (text("technique_id") != "") | (text("technique_name") != "")
    whole = (text("tactic") != "") & (text("technique_id") != "") & (text("technique_name") != "")
    classes = [c for c in ENUMS["event_class"] if c]
    return _fault(
        (~text("rule_id").rlike(rf"^(?:{_RULE_ID})\z") | (F.char_length(text("rule_id")) > 120), "id", "is no dotted lower-case name of up to 120 characters"),
        (text("rule_id").rlike(rf"^(?:{_VERSIONED})\z"), "id", "names a version; revision counts those"),
        (F.coalesce("revision", F.lit(0)) < 1, "revision", "counts from 1"),
        (blank("name"), "name", "can't be blank"),
        (over("name", 200), "name", "takes 200 bytes at most"),
        (blank("description"), "description", "can't be blank"),
        *[(over(c, 2000), c, "takes 2000 bytes at most") for c in ("description", "false_positives", "response")],
        (~text("severity").isin(*SEVERITIES), "severity", f"has one of the values {SEVERITIES}"),
        (~text("status").isin(*STATUSES), "status", f"has one of the values {STATUSES}"),
        (given & ~whole, "technique", "is given in full or left out"),
        (given & ~text("tactic").isin(*TACTICS), "technique.tactic", "is outside the list of tactics"),
        (given & ~text("technique_id").rlike(rf"^(?:{_TECHNIQUE_ID})\z"), "technique.id", "is a T with four digits, and three more after a dot for a part of it"),
        (given & blank("technique_name"), "technique.name", "can't be blank"),
        (over("technique_name", 200), "technique.name", "takes 200 bytes at most"),
        (~F.coalesce("event_class", F.lit(0)).isin(*classes), "class", "is outside the contract's classes of events"),
    )


def _mapped(pairs: dict) -> Column:
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), lit(v))])


def _node_fault() -> Column:
    """What is wrong with one node that the walk has met, given its path and depth and the number of terms below it."""
    kinds, body = vocabulary(), {name: number for number, name in ENUMS["event_class"].items() if number}
    field, operator, values = F.coalesce("field", F.lit("")), F.coalesce("operator", F.lit("")), F.coalesce("values", F.array().cast("array<struct<kind: string, value: string>>"))
    kind = F.try_element_at(_mapped(kinds), field)
    owner = F.try_element_at(_mapped(body), F.element_at(F.split(field, r"\."), 1))
    asked = F.try_element_at(_mapped({k: sorted(v[0]) for k, v in OPERATORS.items()}), operator)
    least, most = (F.try_element_at(_mapped({k: v[i] for k, v in OPERATORS.items()}), operator) for i in (1, 2))
    allowed = F.try_element_at(_mapped({f: choices(f) for f, k in kinds.items() if k == "choice"}), field)
    literal = F.when(kind.isin("text", "choice"), "text").otherwise(kind)
    predicate = F.col("kind") == "predicate"
    at = F.concat("path", F.lit("."), field)
    group = F.col("kind").isin("all", "any")
    return _fault(
        (F.col("depth") > MAX_DEPTH, F.col("path"), f"lies more than {MAX_DEPTH} deep"),
        (predicate & kind.isNull(), at, "no such field"),
        (predicate & owner.isNotNull() & (owner != F.col("event_class")), at, "field of another event class"),
        (predicate & asked.isNull(), at, "no such operator"),
        (predicate & ~F.array_contains(asked, kind), at, "operator does not apply to this kind of field"),
        (predicate & ((F.size(values) < least) | (F.size(values) > most)), at, "wrong number of values"),
        (predicate & F.exists(values, lambda v: ~v["kind"].eqNullSafe(literal)), at, "value of another kind than the field"),
        (predicate & F.exists(values, lambda v: (v["kind"] == "text") & F.coalesce(v["value"], F.lit("")).rlike(r"(?U)^\s*\z")), at, "blank value"),
        (predicate & allowed.isNotNull() & F.exists(values, lambda v: ~F.array_contains(allowed, v["value"])), at, "value outside the field's choices"),
        (group & (F.col("below") == 0), F.concat("path", F.lit("."), F.col("kind")), "combines nothing"),
        ((F.col("kind") == "not") & (F.col("below") == 0), F.concat("path", F.lit(".not")), "no term"),
        ((F.col("kind") == "not") & (F.col("below") > 1), F.concat("path", F.lit(".not")), "takes one term"),
        (~F.coalesce(predicate | group | (F.col("kind") == "not"), F.lit(False)), F.col("path"), "not a term of the language"),
    )


#: A round is a level of all trees. ranks holds the place of a node among its siblings on each level, so it sorts as a walk does.
_WALK = f"""
WITH RECURSIVE walked(rule_id, node, path, depth, ranks) AS (
  SELECT rule_id, node, CAST('match' AS STRING), 0, CAST(array(place) AS ARRAY<INT>) FROM {{nodes}} WHERE parent IS NULL
  UNION ALL
  SELECT n.rule_id, n.node, CAST(concat(w.path, '.', n.parent_kind, CASE WHEN n.parent_kind = 'not' THEN '' ELSE concat('[', n.place, ']') END) AS STRING), w.depth + 1, CAST(concat(w.ranks, array(n.place)) AS ARRAY<INT>)
  FROM walked w JOIN {{nodes}} n ON n.rule_id = w.rule_id AND n.parent = w.node
  WHERE w.depth <= {MAX_DEPTH}
)
SELECT * FROM walked
"""


def walk(nodes: DataFrame) -> DataFrame:
    """(rule_id, node, path, depth, ranks) of each node that is reached from the top, down to one level below the deepest that is allowed."""
    spark = nodes.sparkSession
    above = nodes.select("rule_id", F.col("node").alias("parent"), F.col("kind").alias("parent_kind"))
    # from 0 in order, whatever the ordinals are
    numbered = nodes.select("rule_id", "node", "parent", F.expr("CAST(row_number() OVER (PARTITION BY rule_id, parent ORDER BY ordinal, node) - 1 AS INT)").alias("place"))
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # rows grow with the rules
    try:
        return spark.sql(_WALK, nodes=numbered.join(above, ["rule_id", "parent"], "left"))
    finally:
        spark.conf.set(limit, before)


def faults(headers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rule_id, part, reason) of the first thing wrong with each rule that is wrong: in its header, else in the order in which its tree is walked.

    headers has the columns of HEADERS, one row a rule, and nodes those of NODES; more columns are ignored. A null counts as
    empty, or 0. A rule without a topmost node has no term; one with several has "not a term of the language". Nodes of
    rules without a header, and nodes that no path from the top reaches, are wrong as well. Nothing is collected; a rule's nodes
    meet in the joins of the walk, and only a row a rule and level is left of them after it.
    """
    known = headers.select("rule_id", "event_class", _header_fault().alias("head"))
    below = nodes.filter("parent IS NOT NULL").groupBy("rule_id", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("below"))
    met = walk(nodes).join(nodes.select("rule_id", "node", "kind", "field", "operator", "values"), ["rule_id", "node"])
    met = met.join(below, ["rule_id", "node"], "left").withColumn("below", F.coalesce("below", F.lit(0))).join(known.select("rule_id", "event_class"), "rule_id")
    told = met.select("rule_id", "depth", "ranks", _node_fault().alias("bad"))
    first = told.groupBy("rule_id").agg(
        F.min(F.when(F.col("bad").isNotNull(), F.struct("ranks", "bad"))).alias("first"), F.count(F.lit(1)).alias("met"), F.count(F.when(F.col("depth") == 0, 1)).alias("tops"), F.max("depth").alias("deepest")
    )
    all_nodes = nodes.groupBy("rule_id").agg(F.count(F.lit(1)).alias("nodes"))
    out = known.join(first, "rule_id", "left").join(all_nodes, "rule_id", "full")
    lost = (F.col("deepest") <= MAX_DEPTH) & (F.col("nodes") > F.col("met"))
    whole = _fault(
        (F.col("event_class").isNull() & F.col("head").isNull(), "id", "has no header"),
        (F.coalesce("tops", F.lit(0)) == 0, "match", "no term"),
        (F.col("tops") > 1, "match", "not a term of the language"),
    )
    bad = F.coalesce("head", whole, F.col("first.bad"), _fault((lost, "match", "has terms that are not below its top")))
    return out.select("rule_id", bad.alias("bad")).filter("bad IS NOT NULL").select("rule_id", "bad.part", "bad.reason")
