"""Nearest neighbours by inner product: inverted lists, scanned in blocks of rotated dimensions.

Largest inner product is least distance once each vector has one more component that brings all to the norm of the
longest, and queries are scaled to that norm. Lists are the cells of centroids fitted on a bounded sample; every vector
is put in one. Within a list a random rotation makes the distance over the first d of D dimensions an estimate of
the whole one, so a candidate is dropped once a test says that it is farther than the worst of the best found so far
(odds of a wrong drop fall with EPSILON); only those that pass all blocks are measured on their original components.

Lists are packed into shards of bounded size, and shards that many queries ask are copied, so the work of a task is
bounded whatever list is hot. Equal vectors are one candidate, with the k + 1 least of their ids: no query's answer
can hold more of them. They are one query, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, materialize, ship

#: Of one length of vectors: rows and bytes of the sample that lists are fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 64 << 20
#: Wanted vectors a list, and most lists.
LIST_ROWS, MOST_LISTS = 2_048, 4_096
#: Bytes of candidates, as doubles, and queries of one unit of work.
SHARD_BYTES, SHARD_QUERIES = 4 << 20, 16_384
#: Longer vectors are measured whole.
MOST_WIDE = 4_096
BLOCK, EPSILON, FIRST, SEGMENT = 16, 2.1, 128, 2_048
_UNIT = "width int, shard int, part int, side int, list int, lists array<int>, key binary, ids array<long>"


@dataclass
class Index:
    """What tasks know of the vectors of one length: with no centroids, they are one list that is measured whole."""

    width: int
    norm: float = 1.0
    rotation: np.ndarray | None = None
    centroids: np.ndarray | None = None
    probes: int = 1

    def stored(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (v * v).sum(1), 0.0))
        return np.concatenate([v, rest[:, None]], axis=1) @ self.rotation

    def asked(self, v: np.ndarray) -> np.ndarray:
        u = v * (self.norm / np.sqrt((v * v).sum(1)))[:, None]
        return np.concatenate([u, np.zeros((len(v), 1))], axis=1) @ self.rotation

    def lists(self, v: np.ndarray) -> np.ndarray:
        return np.zeros(len(v), np.int64) if self.centroids is None else _far(self.stored(v), self.centroids).argmin(1)

    def near_lists(self, v: np.ndarray) -> np.ndarray:
        """The lists to search for each query, nearest first."""
        if self.centroids is None:
            return np.zeros((len(v), 1), np.int64)
        return np.argsort(_far(self.asked(v), self.centroids), axis=1, kind="stable")[:, : self.probes]


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


def inner(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in doubles, added component after component, so that equal vectors always have equal ones."""
    return np.cumsum(v * q, axis=1)[:, -1]


def fit(sample: np.ndarray, rows: int, norm: float, k: int, recall: float, seed: int = 11, rounds: int = 8) -> Index:
    """An index from a sample of `rows` vectors of one length.

    As many lists are searched as hold `recall` of the k nearest of the sample's own vectors. Those of all rows are nearer,
    and so share a list no less often.
    """
    width = sample.shape[1]
    usable = width <= MOST_WIDE and len(sample) > 1 and np.isfinite(norm * norm * width) and norm > 1e-140
    if not usable:
        return Index(width)
    rng = np.random.default_rng(seed)
    q, r = np.linalg.qr(rng.standard_normal((width + 1, width + 1)))
    index = Index(width, norm, q * np.sign(np.diag(r)))
    x = index.stored(sample)
    n_lists = max(1, min(MOST_LISTS, round(rows / LIST_ROWS), len(x) // 16))
    c = x[rng.choice(len(x), n_lists, replace=False)]
    parts = range(0, len(x), 4096)
    for _ in range(rounds if n_lists > 1 else 1):
        mine = np.concatenate([_far(x[i : i + 4096], c).argmin(1) for i in parts])
        n = np.bincount(mine, minlength=n_lists)
        total = np.zeros_like(c)
        np.add.at(total, mine, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    index.centroids = c[np.argsort(c[:, 0], kind="stable")]
    tried = sample[rng.choice(len(x), min(len(x), 256), replace=False)]
    mine = np.concatenate([index.lists(sample[i : i + 4096]) for i in parts])
    order = np.argsort(_far(index.asked(tried), index.centroids), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n_lists)[None, :], axis=1)
    best = np.argsort(-(tried @ sample.T), axis=1)[:, 1 : k + 1]
    needed = np.sort(np.take_along_axis(place, mine[best], axis=1).ravel())
    index.probes = int(needed[min(len(needed) - 1, int(recall * len(needed)))]) + 1 if len(needed) else n_lists
    return index


class Shard:
    """Candidates of one unit, by list, as blocks of rotated dimensions."""

    def __init__(self, index: Index, lists: np.ndarray, v: np.ndarray, ids: list[list[int]]) -> None:
        order = np.argsort(lists, kind="stable")
        self.index, self.v, self.ids = index, v[order], [ids[i] for i in order]
        found, starts = np.unique(lists[order], return_index=True)
        self.spans = dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(v)], strict=True), strict=True))
        if index.centroids is not None:
            x = index.stored(self.v)
            wide = x.shape[1]
            self.cuts = [(a, min(a + BLOCK, wide)) for a in range(0, wide, BLOCK)]
            self.blocks = [np.ascontiguousarray(x[:, a:b]) for a, b in self.cuts]
            self.noise = 1e-12 * index.norm**2
            # a distance over b of the dimensions that is larger than this share of the worst is too large
            self.share = [b / wide * (1 + EPSILON / b**0.5) ** 2 for _, b in self.cuts[:-1]] + [1 + 1e-9]

    def _scan(self, u: np.ndarray, a: int, b: int, worst: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of those from a to b that pass the test after each block."""
        rows, far = np.arange(a, b), np.zeros(b - a)
        for (i, j), block, share in zip(self.cuts, self.blocks, self.share, strict=True):
            t = (block[a:b] if len(rows) == b - a else block[rows]) - u[i:j]
            far = far + np.einsum("ij,ij->i", t, t)
            near = far <= worst * share + self.noise
            if not near.all():
                rows, far = rows[near], far[near]
            if not len(rows):
                break
        return rows, far

    def search(self, q: np.ndarray, u: np.ndarray | None, lists: list[int], k: int) -> list[tuple[float, int]]:
        """(score, id) of the k best in these lists, best first, ties to the smaller id."""
        if u is None:
            rows = np.concatenate([np.arange(*self.spans[x]) for x in lists if x in self.spans] or [np.empty(0, np.int64)])
        else:
            rows, far, worst = np.empty(0, np.int64), np.empty(0), np.inf
            for x in lists:
                a, end = self.spans.get(x, (0, 0))
                while a < end:
                    b = min(end, a + (SEGMENT if np.isfinite(worst) else FIRST))
                    r, d = self._scan(u, a, b, worst)
                    rows, far, a = np.concatenate([rows, r]), np.concatenate([far, d]), b
                    if len(far) > k:
                        worst = np.partition(far, k - 1)[k - 1]
                        near = far <= worst * (1 + 1e-9) + self.noise
                        rows, far = rows[near], far[near]
        score = np.nan_to_num(inner(self.v[rows], q), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        if len(rows) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[keep], score[keep]
        found = sorted((-s, i) for r, s in zip(rows.tolist(), score.tolist(), strict=True) for i in self.ids[r])
        return [(-s, i) for s, i in found[:k]]


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _by_width(b: pa.RecordBatch, widths: str, vectors: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, vectors as doubles) for each length in a batch."""
    w = b.column(widths).to_numpy()
    for width in np.unique(w).tolist():
        at = np.flatnonzero(w == width)
        yield width, at, _rows_of(b.column(vectors).take(pa.array(at)), width)


def taking_part(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, key, width, size, v): rows with an id and a vector that isn't null, zero, or holds what is no number; size is its squared norm."""
    ship(df.sparkSession)
    double = df.schema[vector_col].dataType != T.ArrayType(T.FloatType(), df.schema[vector_col].dataType.containsNull)
    kind, arrow = ("double", pa.float64()) if double else ("float", pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for width in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero((size == width) & b.column(0).is_valid().to_numpy(zero_copy_only=False))
                x = v.take(pa.array(at)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width)
                fine = np.isfinite(x).all(1) & (x != 0).any(1)
                at, x = at[fine], x[fine] + 0.0  # no negative zeros
                with np.errstate(over="ignore"):
                    norms = (x.astype(np.float64) ** 2).sum(1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel(), arrow))
                keys = pa.array([xxhash.xxh3_128_digest(np.ascontiguousarray(r)) for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), keys, pa.array(np.full(len(x), width), pa.int32()), pa.array(norms), lists], ["vec_id", "key", "width", "size", "v"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    return rows.mapInArrow(run, f"vec_id long, key binary, width int, size double, v array<{kind}>")


def fit_all(classes: DataFrame, k: int, recall: float) -> dict[int, Index]:
    """An index for each length of vectors, from a sample of at most SAMPLE_ROWS and SAMPLE_BYTES of it, taken by hash."""
    spark = classes.sparkSession
    # a row for each length
    known = {r[0]: (r[1], r[2] ** 0.5) for r in classes.groupBy("width").agg(F.count(F.lit(1)), F.max("size")).collect()}
    most = {w: max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * w)) // len(known)) for w in known}
    if not known:
        return {}
    shares = spark.createDataFrame([(w, min(1.0, most[w] / n)) for w, (n, _) in known.items() if w <= MOST_WIDE] or [(0, 0.0)], "width int, share double")
    taken = F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    rows = classes.join(F.broadcast(shares), "width").filter(taken).select("width", "v").limit(2 * SAMPLE_ROWS).toArrow()
    samples: dict[int, np.ndarray] = {}
    for b in rows.combine_chunks().to_batches():
        for width, _, x in _by_width(b, "width", "v"):
            samples[width] = np.concatenate([samples[width], x]) if width in samples else x
    return {w: fit(samples.get(w, np.empty((0, w))), n, norm, k, recall) for w, (n, norm) in known.items()}


@dataclass
class Packing:
    """Which shards the vectors of a list are in, and in how many copies: first shard, shards, copies of each list."""

    first: dict[tuple[int, int], int]
    shards: dict[tuple[int, int], int]
    copies: dict[int, int]


def pack(candidates: dict[tuple[int, int], int], queries: dict[tuple[int, int], int]) -> Packing:
    """Short lists share a shard, long ones have several; shards asked by many queries are copied."""
    first, shards, asked, shard, held, last = {}, {}, {}, -1, 0, None
    for (width, x), n in sorted(candidates.items()):
        room = max(256, SHARD_BYTES // (8 * width))
        need = -(-n // room)
        if need > 1 or last != width or held + n > room:
            shard, held = shard + 1, 0
        first[width, x], shards[width, x], last, held = shard, need, width, held + n
        shard, held = (shard + need - 1, room) if need > 1 else (shard, held)
        for s in range(first[width, x], first[width, x] + need):
            asked[s] = asked.get(s, 0) + queries.get((width, x), 0)
    return Packing(first, shards, {s: -(-n // SHARD_QUERIES) for s, n in asked.items() if n > SHARD_QUERIES})


def nearest(
    df: DataFrame, every: int = 20, k: int = 20, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id `every` divides, its k nearest of all other rows found.

    Nearest is the largest inner product of the original vectors, in doubles; ties go to the smaller id. Rows without
    an id, and vectors that are null, empty, zero or hold a null or a number that isn't finite, take no part. Vectors of
    different lengths have no inner product: each length is searched by itself. Rows that bear the query's own id are none of
    its candidates; a row that is repeated stands for one. A query with fewer candidates has all of them, one without
    any, and an empty table, give no rows. Other columns are not looked at.

    Lists are fitted on a sample of SAMPLE_ROWS and SAMPLE_BYTES at most of a length; every vector is in a list, and so
    many lists are searched as hold `recall` of the sample's nearest. Beyond MOST_LISTS * LIST_ROWS vectors lists grow, and
    with them the work of each query.
    """
    spark = df.sparkSession
    rows = taking_part(df, id_col, vector_col)
    vector = rows.schema["v"].dataType.simpleString()
    number = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = rows.distinct().withColumn("i", number).filter(F.col("i") <= k + 1)
    classes = materialize(few.groupBy("key", "width", "size", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    queries = materialize(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "key").distinct())
    told = spark.sparkContext.broadcast(fit_all(classes, k, recall))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = np.zeros(len(b), np.int32)
            for width, at, v in _by_width(b, "width", "v"):
                lists[at] = told.value[width].lists(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.int32())], [*b.schema.names, "list"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists: list[list[int]] = [[] for _ in range(len(b))]
            for width, at, v in _by_width(b, "width", "v"):
                for i, x in zip(at.tolist(), told.value[width].near_lists(v).tolist(), strict=True):
                    lists[i] = x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32()))], ["key", "width", "v", "lists"])

    placed = materialize(classes.select("key", "width", "v", "ids").mapInArrow(place, f"key binary, width int, v {vector}, ids array<long>, list int"))
    asking = classes.select("key", "width", "v").join(queries.select("key").distinct(), "key", "left_semi")
    asking = materialize(asking.mapInArrow(ask, f"key binary, width int, v {vector}, lists array<int>"))
    drop(classes)
    # rows for each list
    per_list = lambda t, x: {(r[0], r[1]): r[2] for r in t.select("width", x).groupBy("width", "list").count().collect()}
    packing = spark.sparkContext.broadcast(pack(per_list(placed, F.col("list")), per_list(asking, F.explode("lists").alias("list"))))

    def units(b: pa.RecordBatch, side: int) -> Iterator[tuple]:
        """(row, shard, part, list, lists) of each unit that a row belongs to."""
        p = packing.value
        keys, widths = b.column("key").to_pylist(), b.column("width").to_pylist()
        for i, (key, width, lists) in enumerate(zip(keys, widths, b.column("lists" if side else "list").to_pylist(), strict=True)):
            h = xxhash.xxh3_64_intdigest(key)
            if not side:
                shard = p.first[width, lists] + h % p.shards[width, lists]
                for part in range(p.copies.get(shard, 1)):
                    yield i, shard, part, lists, None
                continue
            by: dict[int, list[int]] = {}
            for x in lists:
                for shard in range(p.first.get((width, x), 0), p.first.get((width, x), 0) + p.shards.get((width, x), 0)):
                    by.setdefault(shard, []).append(x)
            for shard, some in by.items():
                yield i, shard, h % p.copies.get(shard, 1), -1, some

    def dealt(side: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), 256):  # a query may be in many units
                    b = whole.slice(at, 256)
                    made = list(units(b, side))
                    row = pa.array([m[0] for m in made], pa.int32())
                    ids = b.column("ids").take(row) if not side else pa.nulls(len(made), pa.list_(pa.int64()))
                    columns = [pa.array([m[j] for m in made], pa.int32()) for j in (1, 2, 3)]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("width").take(row), columns[0], columns[1], pa.array([side] * len(made), pa.int32()), columns[2], pa.array([m[4] for m in made], pa.list_(pa.int32())), b.column("key").take(row), ids, b.column("v").take(row)],
                        "width shard part side list lists key ids v".split(),
                    )

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, shard = None, [], None
        for whole in batches:
            places = list(zip(*[whole.column(c).to_pylist() for c in ("width", "shard", "part", "side")], strict=True))
            cuts = [0, *[i for i in range(1, len(places)) if places[i] != places[i - 1]], len(places)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part, (width, *_, side) = whole.slice(a, b - a), places[a]
                index = told.value[width]
                if places[a][:3] != unit:
                    unit, held, shard = places[a][:3], [], None
                if not side:
                    held.append((part.column("list").to_numpy(), _rows_of(part.column("v"), width), part.column("ids").to_pylist()))
                    continue
                if not held:
                    continue
                if shard is None:
                    shard = Shard(index, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [x for h in held for x in h[2]])
                q = _rows_of(part.column("v"), width)
                u = index.asked(q) if index.centroids is not None else [None] * len(q)
                best = [shard.search(q[i], u[i], lists, k + 1) for i, lists in enumerate(part.column("lists").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array([[x[1] for x in r] for r in best], pa.list_(pa.int64())), pa.array([[x[0] for x in r] for r in best], pa.list_(pa.float64()))], ["key", "ids", "scores"]
                )

    schema = f"{_UNIT}, v {vector}"
    work = placed.mapInArrow(dealt(0), schema).unionByName(asking.mapInArrow(dealt(1), schema))
    # a number keeps small partitions apart, each of which is much work
    work = work.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "width", "shard", "part").sortWithinPartitions("width", "shard", "part", "side")
    found = work.mapInArrow(search, "key binary, ids array<long>, scores array<double>")
    pairs = found.select("key", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("key", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    best = materialize(best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best")))
    drop(placed, asking)
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return queries.join(best, "key").select("query_id", F.posexplode(others).alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
