"""Document fingerprints: a Merkle tree of word spans, paragraphs and sections.

Built-in functions only. Equal texts have equal roots. Where roots differ, sections are compared by their hashes,
then the paragraphs of the sections that only one text has, then the spans of the paragraphs that only one has; so
an edit is met in its own branch, wherever it shifts what follows. A paragraph is a line; a section ends with a
paragraph whose hash starts with one of two digits of sixteen, so a line put in changes no section but its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LEAST = -(2**63)
_SHORT, _COUNT = 16, 10  # digits of a hash in keys, and of a number of spans
#: Hashes of sections and of paragraphs that a fingerprint holds at most.
SECTIONS, PARAGRAPHS = 16, 32
_NODE = r"\w{%d}" % (64 + _COUNT - 1)
_SECTION = f"(?:[^08]{_NODE})*+[08]{_NODE}|(?:[^08]{_NODE})++"


def _let(value: Column, then) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _lines(text: Column, span_words: int) -> Column:
    """(hash, id, spans) of each line as it stands, white space included; spans of up to so many words start anew in each line."""
    spans = lambda p: F.regexp_extract_all(p, F.lit(r"\S+(?:\s+\S+){0,%d}" % (span_words - 1)), F.lit(0))
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda p: F.struct(F.sha2(p, 256).alias("hash"), F.xxhash64(p).alias("id"), F.transform(spans(p), lambda s: F.shiftright(F.xxhash64(s), 32).cast("int")).alias("spans")),
    )


def _weight(key: Column) -> Column:
    """The number of spans at the end of a key."""
    return F.conv(F.substring(key, -_COUNT, _COUNT), 16, 10).cast("long")


def tree(text: Column, span_words: int = 4) -> Column:
    """Struct (root, sections, paragraphs, spans, lines) of a text; a null text is an empty one.

    The keys of sections, in order, are the start of the hash and the number of spans below; those of paragraphs have
    their section's hash before them, those of spans the low half of their line's id above. lines has what
    they are made of. The time is linear in the text.
    """

    def counted(n: Column) -> Column:
        return F.lpad(F.hex(n.cast("long")), _COUNT, "0")

    def closed(lines: Column) -> Column:
        nodes = F.array_join(F.transform(lines, lambda x: F.concat(x["hash"], counted(F.size(x["spans"])))), "")
        found = F.regexp_extract_all(nodes, F.lit(_SECTION), F.lit(0))
        return F.transform(found, lambda x: F.struct(F.sha2(x, 256).alias("hash"), F.regexp_extract_all(x, F.lit(r"\w{%d}" % (64 + _COUNT)), F.lit(0)).alias("nodes")))

    def keyed(t: Column) -> Column:
        total = lambda nodes: F.aggregate(nodes, F.lit(0).cast("long"), lambda acc, n: acc + _weight(n))
        start = lambda h: F.substring(h, 1, _SHORT)
        below = lambda x: F.transform(x["spans"], lambda s: F.shiftleft(x["id"], 32).bitwiseOR(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
        return F.struct(
            F.sha2(F.array_join(F.transform(t["sections"], lambda x: x["hash"]), ""), 256).alias("root"),
            F.transform(t["sections"], lambda x: F.concat(start(x["hash"]), counted(total(x["nodes"])))).alias("sections"),
            F.flatten(F.transform(t["sections"], lambda x: F.transform(x["nodes"], lambda n: F.concat(start(x["hash"]), start(n), F.substring(n, -_COUNT, _COUNT))))).alias("paragraphs"),
            F.flatten(F.transform(t["lines"], below)).alias("spans"),
            t["lines"].alias("lines"),
        )

    return _let(_lines(text, span_words), lambda lines: _let(F.struct(lines.alias("lines"), closed(lines).alias("sections")), keyed))


def fingerprint(t: Column) -> Column:
    """A tree in less than 1,000 characters: root, number of spans, and the least hashes of its sections and paragraphs.

    Trees of equal texts have equal ones, and others differ by their roots. likeness() goes by the whole trees; estimated_likeness()
    by what fingerprints hold.
    """
    spans = F.aggregate(t["sections"], F.lit(0).cast("long"), lambda acc, k: acc + _weight(k))
    least = lambda hashes, n: F.array_join(F.slice(F.array_sort(F.array_distinct(hashes)), 1, n), ".")
    start = lambda k: F.substring(k, 1, _SHORT)
    return F.concat_ws(":", t["root"], spans.cast("string"), least(F.transform(t["sections"], start), SECTIONS), least(F.transform(t["lines"], lambda x: start(x["hash"])), PARAGRAPHS))


def estimated_likeness(a: Column, b: Column) -> Column:
    """The share of paragraphs that two texts have in common, of all they have, by the least hashes of both fingerprints; exact for short texts."""
    part = lambda c: F.split(F.element_at(F.split(c, ":"), -1), r"\.")

    def share(v: Column) -> Column:
        both = F.slice(F.array_sort(F.array_union(v["a"], v["b"])), 1, PARAGRAPHS)
        return F.size(F.array_intersect(both, F.array_intersect(v["a"], v["b"]))) / F.size(both)

    return _let(F.struct(part(a).alias("a"), part(b).alias("b")), share)


def _own_paragraphs(a: Column, b: Column) -> Column:
    """Hashes, with numbers of spans, of the paragraphs in sections that only a has."""
    return F.transform(F.array_except(a["paragraphs"], b["paragraphs"]), lambda k: F.substring(k, _SHORT + 1, _SHORT + _COUNT))


def likeness(a: Column, b: Column) -> Column:
    """How much of two trees is the same, 0 to 1: 1 for equal roots.

    What sections have in common counts with the spans below it, then what the paragraphs of other sections have, then what
    the spans of other paragraphs have; all over that and the spans that only one has. 1 where neither has a span.
    """
    weights = lambda keys: F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc + _weight(k))
    own = lambda x, y: F.transform(F.array_except(x["spans"], y["spans"]), lambda s: s.bitwiseAND(F.lit(0xFFFFFFFF)))

    def share(v: Column) -> Column:
        whole = v["same"] + F.size(F.array_union(v["x"], v["y"]))
        return F.when(whole == 0, F.lit(1.0)).otherwise((v["same"] + F.size(F.array_intersect(v["x"], v["y"]))) / whole)

    def compared(t: Column) -> Column:
        a, b = t["a"], t["b"]
        same = weights(F.array_intersect(a["sections"], b["sections"])) + weights(F.array_intersect(_own_paragraphs(a, b), _own_paragraphs(b, a)))
        return _let(F.struct(same.alias("same"), own(a, b).alias("x"), own(b, a).alias("y")), share)

    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(_let(F.struct(a.alias("a"), b.alias("b")), compared))


def n_differing(a: Column, b: Column) -> Column:
    """How many different paragraphs, of sections that only a has, are in no section that only b has; in linear time."""
    return F.when(a["root"] == b["root"], F.lit(0)).otherwise(F.size(F.array_except(_own_paragraphs(a, b), _own_paragraphs(b, a)))).cast("long")


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Indices of those paragraphs of a, in order; the time grows with a's paragraphs times those found."""

    def places(t: Column) -> Column:
        a, b = t["a"], t["b"]
        gone = F.array_except(_own_paragraphs(a, b), _own_paragraphs(b, a))
        keys = F.array_except(a["paragraphs"], b["paragraphs"])

        def among(v: Column) -> Column:
            hit = lambda k: F.array_contains(v["keys"], k) & F.array_contains(v["gone"], F.substring(k, _SHORT + 1, _SHORT + _COUNT))
            return F.filter(F.transform(v["all"], lambda k, i: F.when(hit(k), i)), lambda i: i.isNotNull())

        return _let(F.struct(gone.alias("gone"), keys.alias("keys"), a["paragraphs"].alias("all")), among)

    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(_let(F.struct(a.alias("a"), b.alias("b")), places))


def with_tree(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the whole tree of a text as a column."""
    return df.withColumn(name, tree(text))


def _rank(points: list[int], value: Column, holds) -> Column:
    """How many of the ascending points are before a value, as holds(point, value) says, by halving."""
    array, steps = F.array(*map(F.lit, points)).cast("array<bigint>"), [1 << k for k in reversed(range(len(points).bit_length()))]

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(points)) & F.coalesce(holds(F.get(array, at + step - 1), value), F.lit(False)), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)).cast("array<int>"), F.lit(0), further)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text): next is the following document by descending id; the first follows the last.

    Ids are cut at quantiles into ranges; a range is one window partition, and the head of the range below
    is copied to its end, so no task sees more than a range and texts are shuffled once. An id that many rows have, or
    no id, makes as many ranges as quantiles, by a hash of the text. A null text is empty. A null id comes last.
    Documents of equal ids are ordered by that hash; only rows with the same id and text are never parted.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.withColumn("sid", F.coalesce("doc_id", F.lit(_LEAST)))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(rows.agg(F.percentile_approx("sid", [i / n for i in range(1, n)], 10 * n)).first()[0] or [])
    most = max((cuts.count(c) for c in set(cuts)), default=0) + 1
    below, before = _rank(cuts, F.col("sid"), lambda c, v: c <= v), _rank(cuts, F.col("sid"), lambda c, v: c < v)
    same = below - before
    part = F.when(same > 1, F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * same), same - 1)).otherwise(most)
    rows = rows.withColumn("bucket", (below * (most + 1) + part).cast("long") if cuts else F.lit(0).cast("long"))
    # as many rows as ranges
    heads = [(r[0], r[1], r[2]) for r in rows.groupBy("bucket").agg(F.max(F.struct("sid", "h")).alias("m")).select("bucket", "m.sid", "m.h").orderBy("bucket").collect()]
    to = [(sid, h, heads[(i + 1) % len(heads)][0]) for i, (_, sid, h) in enumerate(heads)]
    targets = spark.createDataFrame(to, "head_sid long, head_h long, to_bucket long")
    placed = rows.join(F.broadcast(targets), (F.col("sid") == F.col("head_sid")) & (F.col("h") == F.col("head_h")), "left").withColumn(
        "place",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copied")),
                    F.struct(F.col("to_bucket").alias("bucket"), F.lit(True).alias("copied")),
                ),
                lambda p: p["bucket"].isNotNull(),
            )
        ),
    )
    w = Window.partitionBy("bucket").orderBy("copied", F.desc("sid"), F.desc("h"))
    return (
        placed.select("doc_id", "sid", "h", "text", F.col("place.bucket").alias("bucket"), F.col("place.copied").alias("copied"))
        .withColumn("next_text", F.lead("text").over(w))
        .filter(~F.col("copied"))
        .select("doc_id", "text", "next_text")
    )


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every document, its edited text and the next document; see with_next() for odd rows.

    The edited text has its last third (rounded down, in code points) replaced by the first as many code
    points of the next document, or by all of them.
    """
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = (
        with_next(docs, id_col, text_col)
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn(
            "edited",
            F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third)),
        )
    )
    for text, name in (("text", "t"), ("edited", "e"), ("next_text", "x")):
        rows = with_tree(rows, F.col(text), name)
    t, e, x = F.col("t"), F.col("e"), F.col("x")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(t).alias("fingerprint"),
        fingerprint(e).alias("edited_fingerprint"),
        likeness(t, e).alias("near_edited"),
        likeness(t, x).alias("near_next"),
        n_differing(t, e).alias("n_edited_paragraphs"),
    )
