"""Rules in numbers: an inverted index over what their matches ask of an event.

A rule needs some of its terms to hold: each of those under `all`, one of those under `any`. The needed choice that
fewest rules share (by field and value) is the rule's access; it is posted under its values, and an event looks up its own
fields' values and the literals that its texts hold. So an event meets only rules of which something already holds, and
the rest of these is evaluated from the rule's row, a postfix program, by one expression that doesn't depend on the rules.
Rules that need no value or literal (bounds on numbers, presence, negations) are met by every event.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.package import ship
from . import rule_trees, text_patterns
from .rules import All, Any, Not, Predicate, operand, vocabulary

#: Under this key stand rules that any event may match.
ALWAYS = "*"
_ATOM = "struct<op: string, n: int, at: int, texts: array<string>, numbers: array<double>>"
_CHOICE = f"struct<atoms: array<{_ATOM}>, keys: array<struct<place: int, field: string, operator: string, text: string, number: double>>>"
_COMPILED = f"rule_id string, severity string, event_class int, program array<{_ATOM}>, choices array<{_CHOICE}>"
_ARROW_ATOMS = pa.list_(pa.struct({"op": pa.string(), "n": pa.int32(), "at": pa.int32(), "texts": pa.list_(pa.string()), "numbers": pa.list_(pa.float64())}))
_ARROW_KEYS = pa.list_(pa.struct({"place": pa.int32(), "field": pa.string(), "operator": pa.string(), "text": pa.string(), "number": pa.float64()}))
_ARROW_CHOICES = pa.list_(pa.struct({"atoms": _ARROW_ATOMS, "keys": _ARROW_KEYS}))
_INDEXED = {"equals", "one_of", *text_patterns.OPERATORS}


def _places() -> tuple[dict[str, int], dict[str, int]]:
    """Where fields stand among the texts and among the numbers of an event."""
    kinds = vocabulary()
    return {f: i for i, f in enumerate(f for f, k in kinds.items() if k != "number")}, {f: i for i, f in enumerate(f for f, k in kinds.items() if k == "number")}


def _text(v: object) -> str:
    return str(v).lower() if isinstance(v, bool) else v


def atom(p: Predicate) -> tuple:
    texts, numbers = _places()
    if p.field in numbers:
        op = {"equals": "number_of", "one_of": "number_of", "present": "number_given"}.get(p.operator, p.operator)
        return (op, 0, numbers[p.field], [], [float(v) + 0.0 for v in p.values])
    zero = {"choice": "unspecified", "truth": "false"}.get(vocabulary()[p.field], "")
    op = {"equals": "text_of", "one_of": "text_of", "present": "text_given"}.get(p.operator, p.operator)
    return (op, 0, texts[p.field], [zero] if p.operator == "present" else [_text(v) for v in p.values], [])


def program(term: object) -> list[tuple]:
    """A term in postfix order: predicates, then what combines the last n of them."""
    if isinstance(term, Predicate):
        return [atom(term)]
    below = [term.term] if isinstance(term, Not) else list(term.terms)
    return [x for t in below for x in program(t)] + [(type(term).__name__.lower(), len(below), 0, [], [])]


def needed(term: object) -> list[list[Predicate]]:
    """Choices of predicates, of each of which one has to hold where the term does."""
    if isinstance(term, Predicate):
        return [[term]] if term.operator in _INDEXED else []
    if isinstance(term, All):
        return [choice for t in term.terms for choice in needed(t)]
    if isinstance(term, Any):
        below = [needed(t) for t in term.terms]
        return [[p for choices in below for p in min(choices, key=lambda c: sum(len(p.values) for p in c))]] if all(below) else []
    return needed(term.term.term) if isinstance(term.term, Not) else []


def _term(nodes: list[dict]) -> object:
    """The match that a valid rule's nodes are."""
    below: dict[int | None, list[dict]] = {}
    for n in sorted(nodes, key=lambda n: (n["ordinal"], n["node"])):
        below.setdefault(n["parent"], []).append(n)

    def made(n: dict) -> object:
        if n["kind"] == "predicate":
            typed = {"number": float, "truth": lambda v: v == "true", "text": str}
            return Predicate(n["field"], n["operator"], tuple(typed[v["kind"]](v["value"]) for v in n["values"] or ()))
        terms = tuple(made(x) for x in below.get(n["node"], ()))
        return Not(terms[0]) if n["kind"] == "not" else (All if n["kind"] == "all" else Any)(terms)

    return made(below[None][0])


def _posted(choice: list[Predicate]) -> dict:
    """A choice as a row: its predicates, and what each is posted under; a number is kept as one, for Spark to write it."""
    keys = [
        {"place": i, "field": p.field, "operator": "=" if p.operator in ("equals", "one_of") else p.operator} | ({"number": v + 0.0} if isinstance(v, float) else {"text": _text(v)})
        for i, p in enumerate(choice)
        for v in dict.fromkeys(p.values)
    ]
    return {"atoms": [_row(atom(p)) for p in choice], "keys": keys}


def _row(a: tuple) -> dict:
    return dict(zip(("op", "n", "at", "texts", "numbers"), a, strict=True))


def compiled(headers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rule_id, severity, event_class, program, choices) of active rules, a row each."""
    ship(nodes.sparkSession)
    trees = nodes.groupBy("rule_id").agg(F.collect_list(F.struct("node", "parent", "ordinal", "kind", "field", "operator", "values")).alias("nodes"))
    rows = headers.filter("status = 'active'").select("rule_id", "severity", "event_class").join(trees, "rule_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [_term(nodes) for nodes in b.column("nodes").to_pylist()]
            columns = [pa.array([[_row(a) for a in program(t)] for t in terms], _ARROW_ATOMS), pa.array([[_posted(c) for c in needed(t)] for t in terms], _ARROW_CHOICES)]
            yield pa.RecordBatch.from_arrays([*b.select(["rule_id", "severity", "event_class"]).columns, *columns], ["rule_id", "severity", "event_class", "program", "choices"])

    return rows.mapInArrow(run, _COMPILED)


@dataclass
class RuleIndex:
    """postings: key, rule, place of the predicate in its access; programs: a row a rule; fields and literals: what events are asked for."""

    postings: DataFrame
    programs: DataFrame
    fields: list[str]
    literals: list[tuple[str, str, str, str]]


def build(headers: DataFrame, nodes: DataFrame, path: str) -> RuleIndex:
    """Index of the active ones of valid written rules, as tables in a folder, from which Spark knows their sizes.

    A rule that breaks the language is refused, as are two rules of one id. The driver holds the literals that texts are
    searched for, as every task does.
    """
    spark = headers.sparkSession
    if twice := headers.groupBy("rule_id").count().filter("count > 1").first():
        raise ValueError(f"two rules have one id, {twice['rule_id']!r}")
    if bad := rule_trees.faults(headers, nodes).first():
        raise ValueError(f"rule {bad['rule_id']!r}: {bad['part']} {bad['reason']}")
    compiled(headers, nodes).write.mode("overwrite").parquet(f"{path}/compiled")
    rules = spark.read.parquet(f"{path}/compiled")
    k = F.col("k")
    value = F.coalesce(k["text"], k["number"].cast("string"))
    each = rules.select("rule_id", F.posexplode("choices").alias("choice", "c")).select("rule_id", "choice", F.explode("c.keys").alias("k"))
    each = each.select("rule_id", "choice", k["place"].alias("place"), k["field"].alias("field"), k["operator"].alias("operator"), k["text"].alias("literal"), F.concat_ws("\0", k["field"], k["operator"], value).alias("key"))
    # a rule is posted under the choice beside which the fewest others stand
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("shared"))
    most = each.join(shared, "key").groupBy("rule_id", "choice", "place").agg(F.max("shared").alias("most"))  # a field has one value
    weights = most.groupBy("rule_id", "choice").agg(F.sum("most").alias("weight"))
    access = weights.groupBy("rule_id").agg(F.min_by("choice", F.struct("weight", "choice")).alias("choice"))
    always = rules.filter(F.size("choices") == 0).select(F.lit(ALWAYS).alias("key"), "rule_id", F.lit(0).alias("place"))
    chosen = each.join(access, ["rule_id", "choice"])
    chosen.select("key", "rule_id", "place").unionByName(always).write.mode("overwrite").parquet(f"{path}/postings")
    own = F.get(F.col("choices.atoms"), F.coalesce("choice", F.lit(-1)))
    rules.join(access, "rule_id", "left").select("rule_id", "severity", "event_class", "program", own.alias("access")).write.mode("overwrite").parquet(f"{path}/programs")
    fields = [r[0] for r in chosen.filter("operator = '='").select("field").distinct().collect()]  # as many as the contract has
    literals = [tuple(r) for r in chosen.filter("operator <> '='").select("field", "operator", "literal", "key").distinct().collect()]
    return RuleIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/programs"), sorted(fields), literals)


def _holds(x: Column, texts: Column, numbers: Column) -> Column:
    """Whether one predicate of a program holds."""
    text, number, value, bound = F.get(texts, x["at"]), F.get(numbers, x["at"]), F.get(x["texts"], F.lit(0)), F.get(x["numbers"], F.lit(0))
    cases = {
        "text_of": F.array_contains(x["texts"], text), "number_of": F.array_contains(x["numbers"], number), "text_given": text != value, "number_given": number != 0,
        "contains": F.contains(text, value), "starts_with": F.startswith(text, value), "ends_with": F.endswith(text, value),
        "above": number > bound, "at_least": number >= bound, "below": number < bound, "at_most": number <= bound,
    }
    first, *rest = cases.items()
    out = F.when(x["op"] == first[0], first[1])
    for op, c in rest:
        out = out.when(x["op"] == op, c)
    return out


def _true(program: Column, texts: Column, numbers: Column) -> Column:
    """The value of a postfix program; what is on the stack is one boolean for each term that is done."""

    def step(stack: Column, x: Column) -> Column:
        under = F.slice(stack, F.lit(1), F.size(stack) - x["n"])
        top = F.slice(stack, F.size(stack) - x["n"] + 1, x["n"])
        done = F.when(x["op"] == "all", F.forall(top, lambda v: v)).when(x["op"] == "any", F.exists(top, lambda v: v)).when(x["op"] == "not", ~F.get(top, F.lit(0)))
        return F.when(x["n"] > 0, F.concat(under, F.array(done))).otherwise(F.concat(stack, F.array(_holds(x, texts, numbers))))

    return F.get(F.aggregate(program, F.array().cast("array<boolean>"), step), F.lit(0))


def matches(events: DataFrame, index: RuleIndex, event: str = "event") -> DataFrame:
    """events with the id and severity of each active rule that matches, a row each; as rules.matches() has them.

    An event's values and the literals found in its texts are looked up in the postings. Where Spark knows these to be small
    they are broadcast, and events are not shuffled; else events and postings meet by key, and a value that many events
    have is split by adaptive execution. A rule that several of an event's values lead to is taken at the first of
    them. Repeated events are all answered; a null event has the zero value in every field.
    """
    e, (texts, numbers) = F.col(event), _places()
    kinds = vocabulary()
    shown = lambda f: operand(e, f).cast("string") if kinds[f] == "truth" else operand(e, f)
    named = events.withColumn("_texts", F.array(*map(shown, texts))).withColumn("_numbers", F.array(*[operand(e, f) + 0.0 for f in numbers]))
    value = lambda f: F.get("_numbers", F.lit(numbers[f])).cast("string") if f in numbers else F.get("_texts", F.lit(texts[f]))
    search = text_patterns.matcher(events.sparkSession, index.literals)
    own = [F.concat(F.lit(f"{f}\0=\0"), value(f)) for f in index.fields]
    looked_up = F.concat(F.array(F.lit(ALWAYS), *own), search({f: F.get("_texts", F.lit(texts[f])) for f in {x[0] for x in index.literals}}))
    met = named.withColumn("_key", F.explode(looked_up)).join(index.postings.withColumnsRenamed({"key": "_key", "rule_id": "_rule", "place": "_place"}), "_key")
    met = met.join(index.programs.withColumnsRenamed({"rule_id": "_rule", "severity": "_severity", "event_class": "_class", "program": "_program", "access": "_access"}), "_rule")
    t, n = F.col("_texts"), F.col("_numbers")
    earlier = F.coalesce(F.exists(F.slice("_access", F.lit(1), F.col("_place")), lambda x: _holds(x, t, n)), F.lit(False))
    hit = met.filter((F.coalesce(e["event_class"], F.lit(0)) == F.col("_class")) & ~earlier & _true(F.col("_program"), t, n))
    return hit.select(*[F.col(f"`{c}`") for c in events.columns], F.col("_rule").alias("rule_id"), F.col("_severity").alias("severity"))
