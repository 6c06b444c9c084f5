"""MinHash near-duplicates by an inverted join of signature coordinates.

Documents of equal shingle sets are one class. A class has a signature of K coordinates, each the combination
of ROWS MinHash values. Classes are posted under each coordinate-value pair. Pairs of at least the wanted
similarity agree in MATCHES or more coordinates but for odds under one in ten million; so each class may skip
its MATCHES - 1 longest posting lists when candidates are gathered (the prefix), and those lists are only
looked at when a candidate's matches are counted. Candidates with enough matches are confirmed on full sets.

Inside a list, a class is first tried against the list's most popular member only, which is linear in the
list. What is linked is merged into components; only classes of different components are tried further. Where
two of them were tried against the same member, their differences from it tell how alike they are: what two
sets differ in is what just one of their differences holds. If one of the two is not linked with that member,
the differences of a pair that is alike must share (1 - c) / 2 of the smaller one's elements or more, with c =
(1 - similarity) / (1 + similarity); so they are joined on the rarest elements of one (a prefix) and all of the
other, and just the pairs that are alike come out. Other pairs that share a list of up to PAIRED classes are
confirmed on full sets one by one; classes of longer lists, such as of documents that have a passage in common and
nothing else, are joined in the same way on the rarest elements of their whole sets, which such documents don't
share. So no link between different components is lost, and no list's members are all paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import drop, materialize, ship
from .graph import components

K, ROWS, MATCHES = 32, 3, 3
#: Documents whose keys may be sent to every task when sets are computed again: 16 MB of them.
BROADCAST_DOCS = 500_000
#: Classes of a list that are paired with one another; those of longer lists are joined on their rarest elements.
PAIRED = 64
_CHUNK = 1 << 16
_SEEDS = np.random.default_rng(7).integers(0, 1 << 63, (2, K * ROWS), dtype=np.int64).astype(np.uint64)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K keys for each set that isn't empty; equal keys stand for the same coordinate and value."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    x = np.concatenate(sets)
    mins = np.empty((K * ROWS, len(sets)), np.uint64)
    for i in range(K * ROWS):
        mins[i] = np.minimum.reduceat((x ^ _SEEDS[0, i]) * (_SEEDS[1, i] | np.uint64(1)), starts)
    key = np.arange(K, dtype=np.uint64)[:, None] + np.zeros(len(sets), np.uint64)
    for r in range(ROWS):
        key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + mins[r::ROWS])
    return key.T.view(np.int64)


def sign(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, class, keys) of every row; class is a 128-bit hash of the set, null for an empty one."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, name, keys = [], [], []
            chunk: list[np.ndarray] = []

            def flush(chunk=chunk, keys=keys):
                full = [s for s in chunk if len(s)]
                made = iter(_signatures(full)) if full else iter(())
                keys.extend(next(made) if len(s) else None for s in chunk)
                chunk.clear()

            size = 0
            for text in b.column(2):
                seq = words.split(text.as_py())
                s = words.whole_or_shingles(words.hashes(seq, len(seq)), width)
                n.append(len(s))
                name.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                chunk.append(s)
                size += len(s)
                if size > _CHUNK:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "class", "keys"],
            )

    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, class binary, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(class, hashes) with the full set of one document of each wanted (class, doc_id, text_hash)."""
    if wanted.count() <= BROADCAST_DOCS:
        wanted = F.broadcast(wanted)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = rows.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))).select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1):
                seq = words.split(text.as_py())
                out.append(words.whole_or_shingles(words.hashes(seq, len(seq)), width).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["class", "hashes"])

    # a row that is repeated is computed again but counts once
    return rows.mapInArrow(run, "class binary, hashes binary").groupBy("class").agg(F.first("hashes").alias("hashes"))


def _compare(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, linked, difference) of candidate pairs (a, b) that match in enough coordinates.

    linked is decided on full sets. difference has the hashes that one of the two sets lacks, or is null where
    these are more than the larger set has.
    """
    a = classes.select(F.col("class").alias("a"), F.col("keys").alias("ka"))
    b = classes.select(F.col("class").alias("b"), F.col("keys").alias("kb"))
    matches = F.size(F.filter(F.zip_with("ka", "kb", lambda x, y: x == y), lambda m: m))
    pairs = materialize(pairs.join(a, "a").join(b, "b").filter(matches >= MATCHES).select("a", "b"))
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = materialize(wanted.join(classes, "class").select("class", "one.*"))
    sets = materialize(_sets(docs, wanted, width, id_col, text_col))
    with_a = pairs.join(sets.select(F.col("class").alias("a"), F.col("hashes").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("class").alias("b"), F.col("hashes").alias("sb")), "b").select("a", "b", "sa", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            linked, difference = [], []
            for p, q in zip(x.column(2), x.column(3), strict=True):
                s, t = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                d = np.setxor1d(s, t, assume_unique=True)
                both = (len(s) + len(t) - len(d)) // 2
                linked.append(100 * both >= percent * (len(s) + len(t) - both))
                difference.append(d.view(np.int64) if len(d) <= max(len(s), len(t)) else None)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(linked, pa.bool_()), pa.array(difference, pa.list_(pa.int64()))], ["a", "b", "linked", "difference"])

    out = materialize(with_b.mapInArrow(check, "a binary, b binary, linked boolean, difference array<bigint>"))
    drop(pairs, wanted, sets)
    return out


def _anchored_links(anchored: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of different components that have an anchor in common.

    anchored: (anchor, class, n, component, linked, difference), linked meaning with the anchor. Elements of a
    difference are put in order, rarest first. At the first element that two differences share, what follows
    it in either must suffice for the overlap that the pair needs; only such pairs leave the join, and they are
    decided exactly.
    """
    c = (100 - percent) / (100 + percent)
    heads = anchored.withColumn("size", F.size("difference")).select("anchor", "class", "n", "component", "linked", "size")
    elements = anchored.select("anchor", "class", "component", "linked", F.explode("difference").alias("e"))
    known = elements.groupBy("anchor", "e").agg(F.count(F.lit(1)).alias("f"), F.sum((~F.col("linked")).cast("int")).alias("loose"), (F.min("component") != F.max("component")).alias("mixed"))
    # an element that just one class or component has, or none that is not linked, can't decide; such count as the rarest
    known = known.filter("f > 1 AND loose > 0 AND mixed").select("anchor", "e", "f")
    ranked = elements.select("anchor", "class", "e").join(known, ["anchor", "e"]).groupBy("anchor", "class").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("known"))
    ranked = ranked.join(heads, ["anchor", "class"]).withColumn("unknown", F.col("size") - F.size("known"))
    placed = ranked.select("anchor", "class", "n", "component", "linked", "size", "unknown", F.posexplode("known").alias("i", "k"))
    placed = materialize(placed.select("anchor", "class", "n", "component", "linked", "size", (F.col("unknown") + F.col("i") + 1).alias("pos"), F.col("k.e").alias("e")))

    def side(df: DataFrame, k: str) -> DataFrame:
        return df.select("anchor", "e", F.col("class").alias(k), *[F.col(x).alias(f"{x}_{k}") for x in ("n", "component", "size", "pos")])

    # what a class's difference shares with that of any one alike, whose set is at most 100 / percent as large
    need = F.greatest(F.col("size") * ((1 - c) / 2), F.col("size") - F.col("n") * (c * (1 + 100 / percent)))
    first = placed.filter(F.col("pos") <= F.col("size") - F.ceil(need - 1e-9) + 1)
    x, y = side(first.filter("NOT linked"), "a"), side(first, "b")
    overlap = F.ceil((F.col("size_a") + F.col("size_b") - c * (F.col("n_a") + F.col("n_b"))) / 2 - 1e-9)
    enough = 1 + F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) >= overlap
    pairs = x.join(y, ["anchor", "e"]).filter((F.col("component_a") != F.col("component_b")) & enough).select("anchor", "a", "b").distinct()
    whole = lambda k: anchored.select("anchor", F.col("class").alias(k), F.col("n").alias(f"n_{k}"), F.col("difference").alias(f"d_{k}"))
    both = pairs.join(whole("a"), ["anchor", "a"]).join(whole("b"), ["anchor", "b"])
    n, apart = F.col("n_a") + F.col("n_b"), F.size("d_a") + F.size("d_b") - 2 * F.size(F.array_intersect("d_a", "d_b"))
    # the sets have (n - apart) / 2 in common and (n + apart) / 2 together
    out = materialize(both.filter(100 * (n - apart) >= percent * (n + apart)).select("a", "b").distinct())
    drop(placed)
    return out


def _as_arrays(sets: DataFrame) -> DataFrame:
    """(class, difference) of (class, hashes): the set as an array, which is its difference from the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(arrays, pa.list_(pa.int64()))], ["class", "difference"])

    return sets.mapInArrow(run, "class binary, difference array<bigint>")


def link(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, class, component): a row for each row of docs.

    component is a class of the group, null for a document without words, which is linked with nothing. Rows
    with the same set are in one group whatever their ids; a null id is no obstacle. An empty table gives no
    rows. Words are cut at ASCII white space, A-Z lower-cased; a text of fewer words than `width` is one
    shingle. Other columns are ignored. percent has to be 80 or more for the stated odds to hold. The result is a
    table in the shared folder.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent has to be from 80 to 100: below, pairs may agree in too few coordinates to be found")
    signed = materialize(sign(docs, width, id_col, text_col))
    named = signed.filter(F.col("class").isNotNull())
    one = F.struct("doc_id", "text_hash")
    classes = materialize(named.groupBy("class").agg(F.min(F.struct(one.alias("one"), F.col("n_shingles").alias("n"), "keys")).alias("m")).select("class", "m.one", "m.n", "m.keys"))

    posted = classes.select("class", "n", F.explode("keys").alias("key"))
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    live = materialize(posted.join(sizes, "key").select("key", "class", "n", "m"))
    # the longest lists of each class, by one order for all classes, are skipped
    order = F.struct((-F.col("m")).alias("m"), F.col("key").alias("key"))
    longest = live.groupBy("class").agg(F.slice(F.sort_array(F.collect_list(order)), 1, MATCHES - 1).alias("long"), F.sum("m").alias("pop"))
    longest = longest.select("class", "pop", F.transform("long", lambda x: x["key"]).alias("long"))
    prefix = materialize(live.join(longest, "class").filter(~F.array_contains(F.col("long"), F.col("key"))).select("key", "class", "n", "pop"))

    def near(x: str, y: str):
        return F.least(x, y) * 100 >= F.greatest(x, y) * percent

    heads = prefix.groupBy("key").agg(F.max(F.struct("pop", "class")).alias("h")).select("key", F.col("h.class").alias("b"))
    star = prefix.join(heads, "key").filter(F.col("class") != F.col("b")).select(F.col("class").alias("a"), "b").distinct()
    tried = _compare(star, classes, docs, width, percent, id_col, text_col)
    links = tried.filter("linked").select("a", "b")

    tied = components(links)
    merged = tied.withColumnRenamed("node", "class")
    anchor = tried.filter("difference IS NOT NULL").select(F.col("b").alias("anchor"), F.col("a").alias("class"), "linked", "difference")
    size = classes.select("class", "n").join(merged, "class", "left").select("class", "n", F.coalesce("component", "class").alias("component"))
    anchored = materialize(anchor.join(size, "class"))
    among = _anchored_links(anchored, percent)
    links = links.unionByName(among)

    own = anchor.select("class", "anchor").unionByName(anchor.select(F.col("anchor").alias("class"), "anchor")).groupBy("class").agg(F.collect_set("anchor").alias("anchors"))
    placed = prefix.join(merged, "class", "left").select("key", "class", "n", F.coalesce("component", "class").alias("component"))
    per_list = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"))
    mixed = per_list.groupBy("key").agg(F.max(F.struct("rows", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("m")).filter("parts > 1")
    placed = placed.join(mixed.select("key", "m", F.col("main.component").alias("main")), "key").join(own, "class", "left")
    placed = materialize(placed.withColumn("anchors", F.coalesce("anchors", F.array().cast("array<binary>"))))
    few = placed.filter(F.col("m") <= PAIRED)
    x = few.filter("component <> main").select("key", F.col("class").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("anchors").alias("aa"))
    y = few.select("key", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("anchors").alias("ab"))
    rest = x.join(y, "key").filter((F.col("ca") != F.col("cb")) & near("na", "nb") & ~F.arrays_overlap("aa", "ab"))
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
    # in longer lists two classes that have the head's difference were joined on it; so one of a pair that is left has not
    many = placed.filter(F.col("m") > PAIRED).join(heads.select("key", F.col("b").alias("head")), "key")
    crowd = many.withColumn("held", (F.col("class") == F.col("head")) | F.array_contains("anchors", F.col("head")))
    loose = crowd.groupBy("key").agg(F.max(~F.col("held")).alias("loose")).filter("loose").select("key")
    crowd = materialize(crowd.join(loose, "key").groupBy("class").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.min("held").alias("linked")))
    wanted = materialize(crowd.select("class").join(classes, "class").select("class", "one.*"))
    sets = materialize(_as_arrays(_sets(docs, wanted, width, id_col, text_col)))
    whole = materialize(crowd.join(sets, "class").withColumn("anchor", F.lit(b"")))
    crowded = _anchored_links(whole, percent)
    drop(crowd, wanted, sets, whole)
    others = _compare(rest, classes, docs, width, percent, id_col, text_col)
    links = links.unionByName(others.filter("linked").select("a", "b")).unionByName(crowded)
    grouped = components(links)
    out = signed.drop("keys").join(grouped.withColumnRenamed("node", "class"), "class", "left")
    out = materialize(out.select("doc_id", "text_hash", "n_shingles", "class", F.coalesce("component", "class").alias("component")))
    drop(signed, classes, live, prefix, tried, tied, anchored, among, placed, others, crowded, grouped)
    return out


def groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; see link() for odd rows.

    component_id is the least id of the group; kept says that the document bears it. Of a group without ids
    component_id is null, and all its rows are kept.
    """
    linked = link(docs, width, percent, id_col, text_col)
    # written by itself, so that the join can split the rows of a very large group
    least = materialize(linked.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("component_id")))
    out = linked.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, the one of least id (null last, then by a hash of the text), and all columns.

    Rows that are repeated count as copies. Rows without words all stay.
    """
    found = link(docs, width, percent, id_col, text_col)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    linked = found.filter(F.col("component").isNotNull()).select("component", rank.alias("rank"))
    best = materialize(linked.groupBy("component").agg(F.min("rank").alias("best")))
    losers = linked.join(best, "component").filter("rank <> best").select("rank.doc_id", "rank.text_hash").distinct()
    twice = linked.groupBy("rank").count().filter("count > 1").select("rank.doc_id", "rank.text_hash")
    losers, twice = materialize(losers), materialize(twice)
    drop(found, best)
    key = [F.col(id_col).cast("long").alias("_d"), F.xxhash64(F.col(text_col).cast("string")).alias("_h")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)

    def keyed(small: DataFrame) -> DataFrame:
        small = small.select(F.col("doc_id").alias("_d2"), F.col("text_hash").alias("_h2"))
        return F.broadcast(small) if small.count() <= BROADCAST_DOCS else small

    same = F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2"))
    rows = rows.join(keyed(losers), same, "left_anti")
    if twice.count():
        again = keyed(twice)
        once = rows.join(again, same, "left_semi").dropDuplicates(["_d", "_h"])
        rows = rows.join(again, same, "left_anti").unionByName(once)
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
