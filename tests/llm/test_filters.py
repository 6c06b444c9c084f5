import numpy as np
import oddrows
from pyspark.sql import functions as F

import corpus_pipeline
from basalt.llm import decontaminate, linededup, quality
from basalt.llm.queries import OP7_SQL, op3_quality, op7_line_dedup
from conftest import SF

ITEM = "the quick brown fox jumps over the lazy dog near the old stone bridge by the river"


def test_decontamination(spark, monkeypatch):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "Two words"), (3, ""), (4, None), (None, "x y z"), (5, "!!! ???")], "item_id long, text string")
    rows = [(1, "lead " * 5000 + ITEM.upper().replace(" ", ", ") + " tail" * 5000), (2, ITEM.replace("fox", "cat")), (3, "before two words, after"), (4, None), (5, ""), (6, "clean text of some length")]
    docs = oddrows.docs(spark, rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()}
    assert got == {(1, 1), (3, 2)}
    kept = decontaminate.clean(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6] and kept.columns == docs.columns
    monkeypatch.setattr(decontaminate, "ITEMS_PER_BLOCK", 2)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()} == got
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [2, 4, 5, 6]
    assert decontaminate.find(oddrows.docs(spark), items.limit(0)).count() == 0
    assert decontaminate.find(oddrows.docs(spark, []), items).count() == 0
    assert decontaminate.clean(oddrows.docs(spark), items).count() == len(oddrows.ROWS)


def test_blocks_of_items_are_bounded_by_bytes(spark, monkeypatch):
    rows = [(7, f"item {i} with some words of its own {i * i}") for i in range(40)] + [(i, f"another one {i} " * (1 + i % 9)) for i in range(40)] + [(99, "very long item " * 60)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = oddrows.docs(spark, [(i, f"before {t} after") for i, (_, t) in enumerate(rows)])
    want = sorted(decontaminate.find(docs, items).collect())
    kept = decontaminate.clean(docs, items).count()
    sizes, make = [], decontaminate.Index
    monkeypatch.setattr(decontaminate, "BYTES_PER_BLOCK", 800, raising=False)
    monkeypatch.setattr(decontaminate, "Index", lambda block, *a: sizes.append((len(block), sum(len(t) for _, t in block))) or make(block, *a))
    found = list(decontaminate._blocks(items, "item_id", "text", 5, 80))
    assert sum(n for n, _ in sizes) == len(rows) and 1 < len(found) == len(sizes)
    assert all(size <= 800 or n == 1 for n, size in sizes)
    few = items.filter("item_id = 7")
    monkeypatch.setattr(decontaminate, "Index", make)
    got = decontaminate.find(docs, few).collect()
    assert sorted(got) == [r for r in want if r.item_id == 7] and got
    assert decontaminate.clean(docs, few).count() + len({r.doc_id for r in got}) == len(rows) and kept == 0


def test_sketch_has_no_false_negatives():
    import random

    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(5, 60)
        words = [f"w{rng.randint(0, 500)}" for _ in range(n)]
        index = decontaminate.Index([(1, " ".join(words))], 5, 80)
        cut = list(words)
        for _ in range(rng.randint(0, 3)):
            cut[rng.randrange(n)] = "changed"
        exact = {tuple(words[i : i + 5]) for i in range(n - 4)}
        found = {tuple(cut[i : i + 5]) for i in range(n - 4)} & exact
        assert bool(index.search(" ".join(["x"] * 50 + cut + ["y"] * 50))) == (100 * len(found) >= 80 * len(exact))


def test_quality_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [(r.score, labels[r.doc_id]) for r in op3_quality(spark, SF).filter("held_out").collect() if r.doc_id in labels]
    good, bad = [s for s, y in got if y], [s for s, y in got if not y]
    assert good and bad
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_marginals_as_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    score, change = rng.normal(size=5), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for y in itertools.product((0, 1), repeat=5):
        p = np.exp(sum(score[i] * y[i] for i in range(5)) + sum(change[y[i], y[i + 1]] for i in range(4)))
        total += p
        good += p * np.array(y)
    assert np.allclose(quality.marginals(score, change, np.array([5])), good / total)


def test_quality_of_odd_rows(spark):
    docs = oddrows.docs(spark)
    labels = spark.createDataFrame([(1, 1, None), (6, 1, 0), (8, 0, 0), (9, 0, 0), (9, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(oddrows.ROWS) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(oddrows.ROWS)
    flat = quality.train(docs, labels.filter("quality = 1"))
    assert len({round(r.score, 12) for r in quality.score(docs, flat).collect()}) == 1
    assert quality.score(oddrows.docs(spark, []), quality.train(oddrows.docs(spark, []), labels.limit(0))).count() == 0


def test_line_dedup(spark):
    foot = "All rights reserved by nobody in particular."
    rows = [(i, f"Own text of document {i}, which is long enough to be its own.\n  {foot} \n\nlast {i}", f"site{i % 12}") for i in range(24)]
    rows += [(100, f"{foot}\nshort", "site1"), (101, None, "site1"), (102, "", None), (103, "\n\n", "site2"), (None, f"A text without an id, yet with a longer line than the other.\n{foot}", None)]
    rows += [(0, rows[0][1], "site0")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, `row` string, k string")
    out = linededup.remove_boilerplate(docs, min_sites=10)
    assert out.columns == [*docs.columns, "lines_removed"] and out.count() == len(rows)
    by = {r.doc_id: r for r in out.collect()}
    assert by[3].text == "Own text of document 3, which is long enough to be its own.\n\nlast 3" and by[3].lines_removed == 1
    assert by[0].lines_removed == 1 and foot not in by[None].text
    assert by[100].text == "short"  # mostly boilerplate, yet with a line of its own
    assert (by[101].text, by[102].text, by[103].text) == (None, "", "\n\n")
    assert linededup.remove_boilerplate(docs, min_sites=14).agg(F.sum("lines_removed")).first()[0] == 0
    assert linededup.boilerplate(docs, min_sites=13).first()["n_sites"] == 13
    assert linededup.remove_boilerplate(oddrows.docs(spark)).count() == len(oddrows.ROWS)
    assert linededup.remove_boilerplate(oddrows.docs(spark, [])).count() == 0


def test_line_dedup_whatever_the_share(spark):
    foot = "All rights reserved by nobody in particular."
    rows = [(i, f"Own text of document {i}, which is long enough to be its own.\n{foot}", f"site{i}") for i in range(12)]
    rows += [(100, f"{foot}\n \nshort", "site1"), (101, f"{foot}\n\n{foot}", "site1"), (102, f"{foot}\nb\n{foot}", None), (103, None, "site1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for out in (linededup.remove_boilerplate(docs, min_sites=10, max_share=None), corpus_pipeline.line_dedup(spark, docs, SF)):
        by = {r.doc_id: r.text for r in out.collect()}
        assert (by[100], by[101], by[102], by[103]) == (" \nshort", f"{foot}\n\n{foot}", "b", None)
        assert not any(foot in by[i] for i in range(12))


def test_line_dedup_by_share_as_sql(same_rows):
    whole = "bool_or(NOT gone AND norm <> '') AS act"
    assert whole in OP7_SQL
    same_rows(lambda spark, sf: op7_line_dedup(spark, sf, max_share=0.7), OP7_SQL.replace(whole, "sum(CASE WHEN gone THEN length(norm) ELSE 0 END) <= 0.7 * sum(length(norm)) AS act"))


def test_line_dedup_of_a_table_with_its_own_names(spark):
    foot = "All rights reserved by nobody in particular."
    rows = [(i, f"own {i}\n{foot}", f"site{i}", "a", "b", i) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lines_removed string, LINES_REMOVED_ string, n_chars int")
    out = linededup.remove_boilerplate(docs, min_sites=10)
    assert out.columns == [*docs.columns, "lines_removed__"]
    assert {(r.text, r.lines_removed, r.lines_removed__) for r in out.collect()} == {(f"own {i}", "a", 1) for i in range(12)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert {(r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()} == {(f"own {i}", len(f"own {i}")) for i in range(12)}


def test_line_dedup_far_above_the_threshold(spark):
    rows = [(i, f"shared line\nown line number {i} which is long", f"s{i}") for i in range(300)]
    out = linededup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=20)
    assert out.agg(F.sum("lines_removed")).first()[0] == 300


def test_line_dedup_of_a_million_lines(spark):
    shared = [f"shared line {i}" for i in range(10)]
    long = [x for i in range(500_000) for x in (shared[i % 10], f"own {i}")]
    rows = [(i, "\n".join([*shared, f"tail {i}"]), f"site-{i}") for i in range(12)] + [(99, "\n".join(long), "site-0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = {r.doc_id: r for r in linededup.remove_boilerplate(docs).collect()}
    assert out[99].lines_removed == 500_000 and out[99].text == "\n".join(long[1::2])
    assert out[3].text == "tail 3"


def test_fit_stops_where_the_enumerated_likelihood_is_highest():
    """At the fitted weights the penalised likelihood, summed over all labellings, has no slope: any error in the gradient would show."""
    import itertools

    rng = np.random.default_rng(12)
    per_doc = np.array([1, 2, 3, 4, 2, 3, 1, 4, 3, 2, 1, 4])
    label = np.array([0, 1, 0, 1, 1, 0, 1, 0, 1, 0, 0, 1])
    f = rng.normal(size=(per_doc.sum(), 3)) + np.repeat(label, per_doc)[:, None] * np.array([0.8, -0.3, 0.0])
    n, l2 = rng.integers(1, 9, per_doc.sum()), 0.05
    model = quality._fit(f, per_doc, n, label, np.ones(len(label)), 6000, l2)
    x = quality.with_neighbours((f - model.mean) / model.scale, per_doc)
    theta = np.concatenate([model.weight, model.change.ravel()])

    def objective(theta):
        score, change, total, at = x @ theta[:-4], theta[-4:].reshape(2, 2), 0.0, 0
        for k, y in zip(per_doc, label, strict=True):
            s = score[at : at + k]
            at += k
            weigh = lambda path: sum(v * b for v, b in zip(s, path, strict=True)) + sum(change[a, b] for a, b in itertools.pairwise(path))  # noqa: B023, E731
            total += weigh((y,) * k) - np.log(sum(np.exp(weigh(path)) for path in itertools.product((0, 1), repeat=int(k))))
        return total / len(per_doc) - l2 / 2 * (theta @ theta)

    slope = [(objective(theta + h) - objective(theta - h)) / 2e-5 for h in np.eye(len(theta)) * 1e-5]
    assert np.abs(slope).max() < 2e-3
    away = theta + rng.normal(0, 0.3, len(theta))
    assert objective(theta) > objective(away)
