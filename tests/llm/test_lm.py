import math
import zlib
from collections import Counter

import numpy as np
import oddrows
import pytest
from pyspark.sql import functions as F

from basalt.llm import lm
from basalt.llm.queries import op1_lm_score
from conftest import SF

END, START = "<end>", "<start>"


def tokens(text):
    import re

    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), END]


def brute(rows, held, deleted, order):
    """The model by plain counting, with unbinned expectation-maximisation."""
    seqs = [(i, tokens(t), held(i), deleted(i)) for i, t in rows]

    def counts(use):
        c = [Counter() for _ in range(order + 1)]
        for s in seqs:
            if use(s):
                for at in range(len(s[1])):
                    for k in range(1, order + 1):
                        c[k][tuple(([START] * order + s[1])[at + order - k + 1 : at + order + 1])] += 1
        return c, sum(c[1].values()), len(c[1]), sum(1 for s in seqs if use(s))

    def estimates(model, seq):
        c, n, v, documents = model
        out = []
        for at in range(len(seq)):
            padded = [START] * order + seq
            gram = lambda k, end: tuple(padded[end + order - k : end + order])
            p, bucket = [1 / (v + 1), c[1][gram(1, at + 1)] / max(n, 1)], 0
            for k in range(2, order + 1):
                h = documents if at == 0 else c[k - 1][gram(k - 1, at)]
                p.append(c[k][gram(k, at + 1)] / h if h else 0)
                if h:
                    bucket = 64 * (k - 1) + int(math.log2(h))
            out.append((bucket, p))
        return out

    main, full = counts(lambda s: not s[2] and not s[3]), counts(lambda s: not s[2])
    tuples = [e for s in seqs if not s[2] and s[3] for e in estimates(main, s[1])]
    learned = lm.learn_weights(np.array([b for b, _ in tuples], np.int64), np.array([p for _, p in tuples]).reshape(-1, order + 1).T, np.ones(len(tuples)))
    out = {}
    for i, seq, h, _ in seqs:
        e = estimates(full, seq)
        w = lm.weights_of(learned, np.array([b for b, _ in e]))
        c, n, v, _ = full
        base = sum(math.log10((c[1][(t,)] + 1) / (n + v + 1)) for t in seq)
        out[i] = (h, len(seq), sum(c[1][(t,)] > 0 for t in seq), n, base, float(np.log10((w * np.array([p for _, p in e]).T).sum(0)).sum()))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_as_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 20000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    gone = {i for i, _ in rows if i % 6 == 1}
    want = brute(rows, held.__contains__, gone.__contains__, order)
    got = lm.score(docs.repartition(3), F.col("doc_id").isin(*held), F.col("doc_id") % 6 == 1, order).collect()
    assert len(got) == len(rows)
    for r in got:
        h, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=0.01)  # estimates are binned while weights are learned


def test_query_as_brute_force_of_trigrams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    gone = {r.doc_id for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], lambda i: zlib.crc32(str(i).encode()) % 7 == 2, gone.__contains__, 3)
    got = {r.doc_id: r.score for r in op1_lm_score(spark, SF).collect()}
    assert got == {i: pytest.approx(w[5], rel=0.01) for i, w in want.items()}


def test_beats_its_base_on_held_out_text(spark):
    s = op1_lm_score(spark, SF).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1]


def test_odd_rows(spark):
    got = lm.score(oddrows.docs(spark), F.col("doc_id") == 5).collect()
    assert len(got) == len(oddrows.ROWS)
    assert all(r.n_tokens >= 1 and r.score <= 0 and math.isfinite(r.score) for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert lm.score(oddrows.docs(spark, []), F.lit(True)).count() == 0
    none = lm.score(oddrows.docs(spark), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.score == 0 and r.base_score == 0 for r in none)


def test_weights_as_plain_em():
    """One weight vector a bucket, by the textbook's steps over single tokens."""
    import random

    rng = random.Random(5)
    tuples = []
    for _ in range(300):
        b = rng.choice([0, 64, 65, 130])
        p = [0.001, rng.choice([0.0, 0.01, 0.2]), rng.choice([0.0, 0.1, 0.5]) if b >= 64 else 0.0, rng.choice([0.0, 0.9]) if b >= 128 else 0.0]
        tuples.append((b, p))
    got = lm.learn_weights(np.array([b for b, _ in tuples]), np.array([p for _, p in tuples]).T, np.ones(len(tuples)))
    for b in (0, 64, 65, 130):
        here = [p for x, p in tuples if x == b]
        n = 2 + b // 64  # orders that this context has
        w = [1 / n] * n
        for _ in range(40):
            got_by = [0.0] * n
            for p in here:
                whole = sum(x * y for x, y in zip(w, p, strict=False))
                for k in range(n):
                    got_by[k] += w[k] * p[k] / whole
            w = [(x + 0.1) / (len(here) + 0.1 * n) for x in got_by]
        assert got[b][:n].tolist() == pytest.approx(w, rel=1e-9) and not got[b][n:].any()


def test_all_continuations_sum_to_one(spark):
    """T(h, w) u(w) + s(h) = u(h), where u is a word's odds to come first, has a solution that sums to one with the empty text."""
    known = ["a", "b", "c", "never-seen"]
    rows = [(i, t) for i, t in enumerate(["a b c a b a", "b b a", "c a b", "a", "c c c b a", ""] * 9)]
    asked = [("", 1000)] + [(w, 1001 + i) for i, w in enumerate(known)] + [(f"{h} {w}", 2000 + 10 * i + j) for i, h in enumerate(known) for j, w in enumerate(known)]
    df = spark.createDataFrame(rows + [(i, t) for t, i in asked], "doc_id long, text string")
    got = {r.doc_id: 10**r.score for r in lm.score(df, F.col("doc_id") >= 1000, F.col("doc_id") % 5 == 1, order=2).collect()}
    s = np.array([got[1001 + i] for i in range(4)])
    t = np.array([[got[2000 + 10 * i + j] / s[j] for j in range(4)] for i in range(4)])
    u = np.linalg.solve(np.eye(4) - t, s)
    assert u.sum() + got[1000] == pytest.approx(1, rel=1e-9) and (u > 0).all()


def test_counts_beyond_32_bits():
    """Two blocks of three thousand million of one word."""
    key = np.array([7, 9], np.uint64)
    row = lambda asker, n: {"dest": 1 << 56, "asker": asker, "kind": 1, "part": 0, "gone": True, "a": lm._planes(np.array(n)), "b": lm._planes(np.array([0, 1])), "c": lm._pack_keys(key), "ids": None, "roles": None, "lens": None}
    import pyarrow as pa

    got = lm._answer(pa.Table.from_pylist([row(0, [3 * 10**9, 1]), row(1, [3 * 10**9, 2])], schema=lm._arrow("dest long, " + lm._ROW))).to_pylist()
    assert [lm._unplanes(r["a"]).tolist() for r in got if r["kind"] == 1] == [[6 * 10**9, 3]] * 2
    assert next(r["ids"] for r in got if r["kind"] == -1) == [6 * 10**9 + 3, 2, 6 * 10**9 + 1, 2]


def test_ranges_of_buckets(spark, monkeypatch):
    """Asking in two steps gives what asking directly does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3, "doc_id")
    monkeypatch.setattr(lm, "BUCKET_BYTES", 20000)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 20000)
    want = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") % 7 == 2).collect()}
    monkeypatch.setattr(lm, "DIRECT", 5)
    plan = lm.Plan(docs.agg(F.sum(F.octet_length("text"))).first()[0])
    assert not plan.direct and plan.within > 1 and plan.ranges * plan.within >= plan.buckets
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") % 7 == 2).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert tuple(r)[:5] == tuple(want[i])[:5] and r.base_score == pytest.approx(want[i].base_score, rel=1e-12) and r.score == pytest.approx(want[i].score, rel=1e-9)


@pytest.mark.parametrize("within", [2, 64, 1024])
def test_groups_of_blocks_are_even(within):
    numbers = [(part << 24) + k for part in range(5000) for k in range(15)]
    sizes = np.bincount([lm._group(n, within) for n in numbers], minlength=within)
    mean = len(numbers) / within
    assert len(sizes) == within and abs(sizes - mean).max() < 6 * mean**0.5
