"""Spelling variants against plain Python over whole texts."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basalt.llm import spelling
from basalt.llm.common import table
from basalt.llm.queries import QUERIES
from tests.conftest import SF

SCHEMA = "doc_id long, text string"


def plain_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def neighbours(words):
    """Near words of each, by all their deletions."""
    by = {}
    for w in words:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(v, set()).add(w)
    near = {w: set() for w in words}
    for group in by.values():
        for a in group:
            for b in group:
                if a < b and distance(a, b) == 1:
                    near[a].add(b)
                    near[b].add(a)
    return near


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain(docs):
    n = plain_words(docs)
    near = neighbours(n)
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda x: (-n[x], x))] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else -1) for w in n)


def rows_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def test_query_over_the_whole_table(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = plain(docs)
    assert rows_of(QUERIES["op13_spelling"](spark, SF)) == want
    assert sum(1 for r in want if r[1]) >= 10


@pytest.mark.parametrize(("block", "asking"), [(8192, 65536), (3, 2)])
def test_crowded_units_in_blocks(spark, monkeypatch, block, asking):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "ASKING", asking)
    rng = random.Random(4)
    some = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(160)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa"}
    docs = [(i, " ".join(w for w in sorted(some) for _ in range(1 + (hash_of(w) + i) % 40))) for i in range(6)]
    assert rows_of(spelling.variants(spark.createDataFrame(docs, SCHEMA).repartition(3))) == plain(docs)


def hash_of(w):
    return zlib.crc32(w.encode())


def test_odd_rows(spark):
    text = "Straße straße STRASSE naïve-Übergröße übergröße ×÷×÷×÷ colour color colours x " * 6 + "colourcolour" * 30_000
    docs = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "\0 \t\n"), (5, "中文" * 20), (-7, text.upper())]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    assert rows_of(spelling.variants(df)) == plain(docs)
    assert spelling.variants(df.limit(0)).collect() == []


def test_chains_of_forms_lead_to_the_last(spark):
    chain = ["abcdefghij", "abcdefghi", "abcdefgh", "abcdefg", "abcdef"]
    docs = [(i, " ".join(w for k, w in enumerate(chain) for _ in range(5 * 6**k))) for i in range(1)]
    got = rows_of(spelling.variants(spark.createDataFrame(docs, SCHEMA)))
    assert got == plain(docs)
    assert {r[2] for r in got if r[0] in chain} == {"abcdef"}


def test_merge_skip_counts_as_a_plain_count_does():
    rng = random.Random(9)
    for _ in range(400):
        lists = [sorted(rng.sample(range(25), rng.randint(0, 12))) for _ in range(rng.randint(0, 9))]
        least = rng.randint(1, 8)
        count = Counter(x for one in lists for x in one)
        assert spelling.merge_skip(lists, least) == sorted(x for x, k in count.items() if k >= least)


def test_one_edit():
    assert spelling.one_edit("abc", "abcd") and spelling.one_edit("abc", "xabc") and spelling.one_edit("abc", "axc")
    assert not spelling.one_edit("abc", "abc") and not spelling.one_edit("abc", "acb") and not spelling.one_edit("abc", "bcda")


def test_parameters_are_checked(spark):
    df = spark.createDataFrame([(1, "x")], SCHEMA)
    for wrong in ({"min_letters": 2}, {"ratio": 1}, {"typo_every": 0}):
        with pytest.raises(ValueError):
            spelling.variants(df, **wrong)
