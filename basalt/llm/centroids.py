"""Centroid clustering of quantised vectors: equal vectors are one row with a multiplicity.

Vectors become integers, so every sum, mean and distance is exact and no order of rows can change a result. Lloyd's
rounds run over the distinct vectors with their multiplicities as weights; a task adds up what it has read and hands
on one row for each centroid and component. The assignments of distinct vectors are joined back to the ids, a join
of two tables in which a vector that a third of all rows share is a long run of one key on one side, of the kind that
adaptive execution splits, and a single row on the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, ship

#: Components are held to this in size, so that a squared distance over 64 of them fits 64 bits.
LARGEST = 1 << 27
MAX_CENTROIDS = 10_000
_EXACT = 1 << 53
_ROWS = "vec_id long, key binary, q array<int>"


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of an Arrow column of lists: numbers of the rows whose list has `width` components, all finite numbers."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    flat = column.take(pa.array(rows)).flatten()
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), width)
    fine = np.isfinite(values).all(axis=1)
    return rows[fine], values[fine]


def quantise(values: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype(np.int64)


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid, as 64-bit integers."""
    most = int(max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * most * most * q.shape[1] < _EXACT:  # all sums are whole numbers that doubles hold exactly
        a, b = q.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]
        return d.astype(np.int64)
    return np.stack([((q - c) ** 2).sum(1) for c in centroids], axis=1)


def assign(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of each vector: the nearest centroid, of equal ones the smallest number."""
    d = distances(q, centroids)
    cluster = d.argmin(axis=1)
    return cluster, d[np.arange(len(q)), cluster]


def weighted_sums(q: np.ndarray, n: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, sums) of each cluster as Python integers, which have no largest value."""
    weight, total = np.zeros(k, object), np.zeros((k, q.shape[1]), object)
    order = np.argsort(cluster, kind="stable")
    found, starts = np.unique(cluster[order], return_index=True)
    for c, rows in zip(found, np.split(order, starts[1:]), strict=True):
        w = int(n[rows].sum())
        narrow = int(np.abs(q[rows]).max(initial=0)) * w < 1 << 62
        weight[c], total[c] = w, (q[rows] * n[rows, None] if narrow else q[rows].astype(object) * n[rows, None].astype(object)).sum(0)
    return weight, total


def quantised(df: DataFrame, id_col: str, vector_col: str, width: int, scale: float) -> DataFrame:
    """(vec_id, key, q) of the vectors that take part; key is 128 bits of hash of the integers q."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, values = matrix(b.column(1), width)
            q = quantise(values, scale).astype("<i4")
            keys = pa.array([xxhash.xxh3_128_digest(x) for x in q], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * width, pa.int32()), pa.array(q.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), keys, lists], ["vec_id", "key", "q"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, _ROWS)


def _start(rows: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors of smallest SHA-256 of prefix and id; rows without an id are none of them, of repeated ids the least vector comes first."""
    h = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).cast("binary"), 256)
    # k rows at most
    first = rows.filter("vec_id IS NOT NULL").select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r["q"] for r in first], np.int64)


def _round(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the exact mean of each cluster's vectors; a cluster without any keeps its own."""
    k, width = centroids.shape
    sent = distinct.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros(k, object), np.zeros((k, width), object)
        for b in batches:
            q = b.column(0).flatten().to_numpy().reshape(-1, width).astype(np.int64)
            n = b.column(1).to_numpy()
            if len(q):
                w, s = weighted_sums(q, n, assign(q, sent.value)[0], k)
                weight, total = weight + w, total + s
        found = [c for c in range(k) if weight[c]]
        numbers = [Decimal(int(x)) for c in found for x in (weight[c], *total[c])]
        places = [(c, j) for c in found for j in range(-1, width)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[i] for p in places], pa.int32()) for i in range(2)] + [pa.array(numbers, pa.decimal128(38, 0))], ["cluster", "component", "total"]
        )

    parts = distinct.select("q", "n").mapInArrow(run, "cluster int, component int, total decimal(38,0)")
    # a row for each centroid and component; component -1 is the number of vectors
    sums = {(r[0], r[1]): int(r[2]) for r in parts.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect()}
    out = centroids.copy()
    for c in range(k):
        if n := sums.get((c, -1)):
            out[c] = [sums[c, j] // n for j in range(width)]
    return out


def cluster(
    df: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: float = 256.0, prefix: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors of exactly `width` components, none null or not finite, take part; a component x becomes floor(scale * x), held
    to LARGEST in size. The k vectors whose prefix and id have the smallest SHA-256 are the first centroids (as many as
    there are, if fewer). Rounds assign each vector to the nearest centroid, ties to the smaller number, and move each
    centroid that has vectors to the floor of their mean; vectors are assigned once more at the end. Repeated rows count
    as often as they stand there and are all returned; a null id is clustered but starts no cluster, and a table of which
    no row has an id gives no rows, nor does an empty one. A sum of distances beyond 64 bits is null. Other columns are
    not looked at. The driver holds the centroids, MAX_CENTROIDS at most, and their sums.
    """
    if not 0 < k <= MAX_CENTROIDS:
        raise ValueError(f"k is {k}; 1 to {MAX_CENTROIDS} centroids are possible")
    spark = df.sparkSession
    rows = quantised(df, id_col, vector_col, width, scale)
    distinct = materialize(rows.groupBy("key", "q").agg(F.count(F.lit(1)).alias("n")))
    centroids = _start(rows, k, prefix)
    if not len(centroids):
        drop(distinct)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = _round(distinct, centroids)
    sent = spark.sparkContext.broadcast(centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, d = assign(b.column(1).flatten().to_numpy().reshape(-1, width).astype(np.int64), sent.value) if len(b) else ([], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c, pa.int32()), pa.array(d, pa.int64()), b.column(2)], ["key", "cluster", "distance", "n"])

    found = materialize(distinct.select("key", "q", "n").mapInArrow(last, "key binary, cluster int, distance long, n long"))
    drop(distinct)
    d = F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    # a row for each centroid
    inertia = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(d).alias("x")).collect()}
    whole = sum(inertia.values())
    fits = lambda x: x if x < 1 << 63 else None
    told = [(c, fits(x), fits(whole), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, x in inertia.items()]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.select("vec_id", "key").join(found.select("key", "cluster", "distance"), "key").join(F.broadcast(about), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
