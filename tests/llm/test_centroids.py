"""Centroid clustering against plain Python on whole small tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import centroids
from basalt.llm.common import table
from basalt.llm.queries import ORACLES, QUERIES
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, rounds, width=64):
    """The contract in Python's integers."""
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * float(x)))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    c = [q for _, q in starts[:k]]
    if not c:
        return []
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        mine = [[] for _ in c]
        for _, q in kept:
            mine[nearest(q)[1]].append(q)
        c = [[sum(col) // len(m) for col in zip(*m, strict=True)] if m else old for m, old in zip(mine, c, strict=True)]
    last = [(i, *nearest(q)) for i, q in kept]
    each = {j: sum(d for _, d, x in last if x == j) for _, _, j in last}
    return sorted((-1 if i is None else i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last)


def rows_of(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect())


def test_query_gives_what_its_sql_gives(same_rows):
    same_rows(QUERIES["op11_centroids"], ORACLES["op11_centroids"])


def test_whole_table_against_python(spark):
    df = table(spark, SF, "embeddings").limit(150)
    given = [(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()]
    made = spark.createDataFrame([(i, v, 0) for i, v in given], SCHEMA)
    assert rows_of(centroids.cluster(made, k=12, rounds=3)) == plain(given, 12, 3)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    some = [[float(x) for x in rng.normal(0, 0.1, 64)] for _ in range(12)]
    odd = [(100, None), (101, []), (102, some[0][:63]), (103, some[0] + [1.0]), (104, [None] + some[0][1:]), (105, [math.nan] + some[0][1:]), (106, [math.inf] + some[0][1:])]
    same = [(200 + i, some[0]) for i in range(40)] + [(7, some[7]), (7, some[7]), (None, some[3]), (300, [3e38] * 64), (301, [-3e38] * 64), (302, [0.0] * 64), (303, [-0.0] * 64)]
    given = odd + list(enumerate(some)) + same
    df = spark.createDataFrame([(i, v, 0) for i, v in given], SCHEMA).withColumnsRenamed({"label": "key"}).withColumn("cluster", F.lit(1)).repartition(7)
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in given]
    want = plain(f32, 5, 4)
    got = rows_of(centroids.cluster(df, k=5, rounds=4))
    assert [r[:3] + r[5:] for r in got] == [r[:3] + r[5:] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[3:5] == tuple(x if x < 1 << 63 else None for x in w[3:5])


def test_fewer_vectors_than_centroids_and_none(spark):
    one = spark.createDataFrame([(4, [0.5] * 64, 0), (9, [0.25] * 64, 0)], SCHEMA)
    assert [r[:3] for r in rows_of(centroids.cluster(one))] == [r[:3] for r in plain([(4, [0.5] * 64), (9, [0.25] * 64)], 40, 5)]
    assert centroids.cluster(one.limit(0)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(None, [0.5] * 64, 0)], SCHEMA)).collect() == []


def test_ties_go_to_the_smaller_number():
    q = np.array([[0], [4], [2]])
    assert centroids.assign(q, np.array([[4], [0], [4]]))[0].tolist() == [1, 0, 0]


def test_sums_are_exact_beyond_doubles():
    q, n = np.array([[centroids.LARGEST], [centroids.LARGEST - 1]]), np.array([1 << 40, (1 << 40) + 1])
    w, s = centroids.weighted_sums(q, n, np.array([0, 0]), 1)
    assert (w[0], s[0][0]) == ((1 << 41) + 1, (centroids.LARGEST << 40) + (centroids.LARGEST - 1) * ((1 << 40) + 1))
    big = np.array([[centroids.LARGEST] * 64, [-centroids.LARGEST] * 64])
    assert centroids.distances(big, big).tolist() == [[0, 64 * (2 * centroids.LARGEST) ** 2], [64 * (2 * centroids.LARGEST) ** 2, 0]]


@pytest.mark.parametrize("k", [0, -1, centroids.MAX_CENTROIDS + 1])
def test_bounds_of_k(spark, k):
    with pytest.raises(ValueError):
        centroids.cluster(table(spark, SF, "embeddings"), k=k)
