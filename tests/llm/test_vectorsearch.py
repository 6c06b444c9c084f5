"""Nearest neighbours against brute force over whole tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import vectorsearch
from basalt.llm.common import table
from basalt.llm.queries import QUERIES
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=20, k=20):
    """query -> [(score, id)], best first."""
    kept = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, q in kept.items():
        if i % every == 0:
            all_of = [(-float(np.cumsum(v * q)[-1]), j) for j, v in kept.items() if j != i and len(v) == len(q)]
            if all_of:
                out[i] = [(-s, j) for s, j in sorted(all_of)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect()):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return out


def recall(got, want):
    return sum(len({j for _, j in got[q]} & {j for _, j in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_query_over_the_whole_table(spark):
    rows = [(r[0], r[1]) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    got, want = found(QUERIES["op12_neighbours"](spark, SF)), brute(rows)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    exact = {(i, j): s for i, w in brute(rows, k=len(rows)).items() for s, j in w}
    for i, best in got.items():
        assert len(best) == 20
        assert best == sorted(best, key=lambda x: (-x[0], x[1]))
        assert all(s == exact[i, j] for s, j in best)


def test_many_lists_shards_and_copies(spark, monkeypatch):
    monkeypatch.setattr(vectorsearch, "LIST_ROWS", 48)
    monkeypatch.setattr(vectorsearch, "SHARD_BYTES", 8 * 12 * 300)
    monkeypatch.setattr(vectorsearch, "SHARD_QUERIES", 10)
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(30, 12))
    rows = [(i, [float(x) for x in middle[i % 30] + rng.normal(0, 0.3, 12)]) for i in range(2000)] + [(5000 + i, [1.0] * 12) for i in range(600)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    got, want = found(vectorsearch.nearest(df)), brute(rows)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    copy = want[5020]  # 599 equal ones: the smallest ids
    assert got[5020] == copy == [(12.0, 5000 + i) for i in range(21) if i != 20]


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [math.nan, 1.0]), (7, [math.inf, 1.0]), (8, [None, 1.0]), (None, [9.0, 9.0]), (20, [-1.0, -0.0]), (40, [3.0, 4.0, 5.0]), (60, [1.0, 1.0, 1.0]), (80, [7.0]), (9, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumnRenamed("label", "rank").withColumn("score", F.lit(1))
    assert found(vectorsearch.nearest(df, k=3)) == brute(rows, k=3)
    assert vectorsearch.nearest(df.limit(0)).collect() == []


def test_huge_tiny_and_long_vectors_are_measured_whole(spark):
    rng = np.random.default_rng(2)
    big = [(i, [1e200 * (i % 7 - 3), 1e200]) for i in range(60)]
    assert found(vectorsearch.nearest(spark.createDataFrame([(i, v, 0) for i, v in big], SCHEMA), k=4)).keys() == brute(big, k=4).keys()
    small = [(i, [1e-180 * (i + 1), 1e-180]) for i in range(30)]
    assert len(found(vectorsearch.nearest(spark.createDataFrame([(i, v, 0) for i, v in small], SCHEMA), k=4))[0]) == 4
    long = [(i, [float(x) for x in rng.normal(size=vectorsearch.MOST_WIDE + 1)]) for i in range(25)]
    assert found(vectorsearch.nearest(spark.createDataFrame([(i, v, 0) for i, v in long], SCHEMA), k=4)) == brute(long, k=4)


def test_scan_drops_most_and_keeps_the_near():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 64))
    index = vectorsearch.fit(v, len(v), float(np.sqrt((v * v).sum(1).max())), 20, 0.97)
    shard = vectorsearch.Shard(index, index.lists(v), v, [[i] for i in range(len(v))])
    u = index.asked(v[:50])
    assert np.allclose(index.rotation @ index.rotation.T, np.eye(65))
    hit = 0
    for i in range(50):
        want = set(np.argsort(-(v @ v[i]))[:20].tolist())
        hit += len(want & {j for _, j in shard.search(v[i], u[i], index.near_lists(v[i : i + 1])[0].tolist(), 20)})
        far = vectorsearch._far(u[i : i + 1], index.stored(shard.v))[0]
        rows, _ = shard._scan(u[i], 0, len(v), float(np.sort(far)[19]))
        assert len(rows) <= 20  # the last block's test is exact
    assert hit / 1000 >= 0.9


def test_packing():
    p = vectorsearch.pack({(4, 0): 10, (4, 1): 20, (4, 2): 2_000_000, (4, 3): 5, (8, 0): 3}, {(4, 0): 40_000, (4, 2): 3})
    assert (p.first[4, 0], p.first[4, 1]) == (0, 0)
    assert p.first[4, 2] == 1 and p.shards[4, 2] == -(-2_000_000 // (vectorsearch.SHARD_BYTES // 32))
    assert p.first[4, 3] == 1 + p.shards[4, 2] and p.first[8, 0] == p.first[4, 3] + 1
    assert p.copies == {0: 3}


@pytest.mark.parametrize("zero", [0.0, -0.0])
def test_zeros_of_either_sign_are_equal(spark, zero):
    rows = [(0, [1.0, 1.0]), (1, [1.0, zero]), (2, [1.0, 0.0])]
    assert found(vectorsearch.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), k=2)) == {0: [(1.0, 1), (1.0, 2)]}
