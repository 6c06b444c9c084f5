"""Many literals against many texts: containing, starting or ending with any of them, found in one pass over a text.

Literals of `contains` are one Aho-Corasick automaton a field; those of `starts_with` and `ends_with` are looked up by the
lengths that occur. So the time grows with the text and what is found in it, not with the number of literals.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.package import ship

OPERATORS = ("contains", "starts_with", "ends_with")
#: Literals of one automaton; more are several, each of which reads the texts.
BLOCK_BYTES = 32 << 20
_MEMO = 50_000
_built: dict[str, list[Searcher]] = {}


class Searcher:
    """Finds the labels of the literals of one field that a text matches."""

    def __init__(self, literals: Iterable[tuple[str, str, str]]) -> None:
        """literals: (operator, literal, label); an empty literal matches every text."""
        self.automaton, self.always, self.memo = None, [], {}
        self.edges: dict[str, dict[str, list[str]]] = {"starts_with": {}, "ends_with": {}}
        inside: dict[str, list[str]] = {}
        for operator, literal, number in literals:
            if not literal:
                self.always.append(number)
            else:
                (inside if operator == "contains" else self.edges[operator]).setdefault(literal, []).append(number)
        self.lengths = {o: sorted({len(x) for x in known}) for o, known in self.edges.items()}
        if inside:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for literal, numbers in inside.items():
                self.automaton.add_word(literal, tuple(numbers))
            self.automaton.make_automaton()

    def find(self, text: str) -> list[str]:
        found = {n for _, numbers in self.automaton.iter(text) for n in numbers} if self.automaton else set()
        for operator, known in self.edges.items():
            for n in self.lengths[operator]:
                if n > len(text):
                    break
                found.update(known.get(text[:n] if operator == "starts_with" else text[-n:], ()))
        return sorted([*found, *self.always])

    def find_all(self, texts: pa.Array) -> list[list[str]]:
        """Of each text; null matches nothing. Equal texts are searched once."""
        if len(self.memo) > _MEMO:
            self.memo.clear()
        coded = texts.dictionary_encode()
        each = []
        for text in coded.dictionary.to_pylist():
            if text not in self.memo:
                self.memo[text] = self.find(text)
            each.append(self.memo[text])
        return [[] if i is None else each[i] for i in coded.indices.to_pylist()]


def _blocks(literals: Sequence[tuple[str, str, str, str]]) -> list[list[tuple[str, str, str, str]]]:
    out, size = [[]], 0
    for x in literals:
        n = len(x[2].encode()) + 64
        if size + n > BLOCK_BYTES and out[-1]:
            out.append([])
            size = 0
        out[-1].append(x)
        size += n
    return out


def _searching(fields: list[str], sent: Broadcast) -> Callable[..., pa.Array]:
    name = uuid.uuid4().hex

    def search(*texts: pa.Array) -> pa.Array:
        if name not in _built:
            _built.clear()
            _built[name] = [Searcher((o, literal, label) for f, o, literal, label in sent.value if f == field) for field in fields]
        found = [s.find_all(t) for s, t in zip(_built[name], texts, strict=True)]
        return pa.array([[x for part in row for x in part] for row in zip(*found, strict=True)], pa.list_(pa.string()))

    return search


def matcher(spark: SparkSession, literals: Sequence[tuple[str, str, str, str]]) -> Callable[[dict[str, Column]], Column]:
    """A function of the columns of fields that gives the labels of the literals found, an array<string>.

    literals: (field, operator, literal, label). They are sent to tasks in blocks of at most BLOCK_BYTES.
    """
    ship(spark)
    made = []
    for block in _blocks(literals) if literals else []:
        fields = sorted({x[0] for x in block})
        made.append((fields, F.arrow_udf(_searching(fields, spark.sparkContext.broadcast(block)), "array<string>")))
    if not made:
        return lambda columns: F.array().cast("array<string>")
    return lambda columns: F.concat(*[call(*[columns[f] for f in fields]) for fields, call in made])


def hits(df: DataFrame, fields: Sequence[str], literals: Sequence[tuple[str, str, str]]) -> DataFrame:
    """df with field, operator and literal of each literal that its text in a column of that name matches, a row for each.

    A null text matches nothing, an empty literal everything else; repeated literals count once; rows that match none are left out.
    """
    known = sorted(set(literals))
    if wrong := [x for x in known if x[0] not in fields or x[1] not in OPERATORS]:
        raise ValueError(f"no such field or operator: {wrong[0]}")
    spark = df.sparkSession
    search = matcher(spark, [(*x, str(i)) for i, x in enumerate(known)])
    names = spark.createDataFrame([(str(i), *x) for i, x in enumerate(known)], "_number string, field string, operator string, literal string")
    found = df.withColumn("_number", F.explode(search({f: F.col(f) for f in fields})))
    return found.join(names, "_number").drop("_number")
