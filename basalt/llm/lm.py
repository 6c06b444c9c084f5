"""LM scoring by deleted interpolation.

Counts of n-grams come from training documents. A tenth of these is "deleted": the mixture weights of the
orders, one set for each bucket of context frequency, are learned by expectation-maximisation on its counts
against maximum-likelihood estimates from the rest. Documents are then scored with estimates from all of the
training documents.

Tokens are never rows. A task turns a block of documents into the sorted distinct keys of its n-grams and
sends each range of keys, with its own counts, to the bucket of that range; a bucket adds up and answers each
block with the counts of the keys that it asked for. So what is shuffled are a few bytes for each distinct
n-gram of a block, however frequent it is. Where there are so many buckets that a block would have few keys
for each, blocks send to ranges of buckets first, a group of blocks at a time; a group's keys are merged, asked
for as one block's are, and the answers dealt back, so rows grow with the input to the power 1.5 at most and
not with its square. A word is known by a 64-bit hash; an n-gram by one that is 16 bits longer than the
number of bytes in the corpus is, so the odds that one is mistaken for another are under 1 in 65,536.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import drop, materialize, ship

HELD_OUT, MAIN, DELETED = 0, 1, 2
#: A block ends with the document that takes it over so many tokens; a bucket is made for so many bytes of text.
BLOCK_TOKENS = 1_500_000
BUCKET_BYTES = 12_000_000
#: Buckets that a block sends to directly.
DIRECT = 4096
#: Bins of an estimate for each doubling, while weights are learned for a bucket; an eighth of it for all buckets together.
_BINS_PER_OCTAVE = 8
ROUNDS = 40
#: Words of a block that get the least numbers, being its most frequent.
_TOP = 4096
_SPARE_BITS = 16
_END, _START = b" ", b"  "


def _planes(x: np.ndarray) -> bytes:
    """Integers of 0 or more in as many bytes as the largest needs, compressed byte by byte: first all their lowest bytes, and so on."""
    kind = np.dtype(np.min_scalar_type(int(x.max(initial=0))))
    x = np.ascontiguousarray(x, kind)
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), kind.itemsize).T.tobytes())


def _unplanes(raw: bytes) -> np.ndarray:
    """The integers, as int64 (uint64 where these take 8 bytes)."""
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(raw)[1:]), np.uint8)
    x = np.ascontiguousarray(flat.reshape(raw[0], -1).T).view(f"<u{raw[0]}").ravel()
    return x if raw[0] == 8 else x.astype(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw).astype(np.uint64), dtype=np.uint64)


def _longer(shorter: np.ndarray, key: np.ndarray, starts: np.ndarray, start: np.uint64) -> np.ndarray:
    """Keys of the n-grams that end at each token, from the keys of those one shorter, ending at the token before."""
    before = np.empty_like(shorter)
    before[1:] = shorter[:-1]
    before[starts] = start
    return words.mix(before * np.uint64(0x9E3779B97F4A7C15) + key)


def _start_key() -> np.uint64:
    return words.mix(words.hashes([_START], 1))[0]


def _numbered(n: int, top: np.ndarray) -> np.ndarray:
    """Place, among sorted keys, of each number: first those in top, then the rest in order."""
    return np.concatenate([top, np.delete(np.arange(n), top)])


#: kind: 0 tokens of a block, 1 and more keys of that order, -1 sums of a bucket of words. asker: who wants an answer;
#: part: the place of the row among those of its asker and kind. a: counts in training documents, or tokens; b: in
#: deleted ones; c: keys.
_ROW = "asker long, kind int, part int, gone boolean, a binary, b binary, c binary, ids array<bigint>, roles array<int>, lens array<int>"


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")])


class Plan:
    """Where keys go: how many buckets there are, in how many ranges, from how many groups of blocks; how long keys are."""

    def __init__(self, size: int):
        self.buckets = 1 + size // BUCKET_BYTES
        self.ranges = self.buckets if self.buckets <= DIRECT else math.isqrt(self.buckets) + 1
        self.within = -(-self.buckets // self.ranges)
        self.direct = self.within == 1
        self.bits = min(64, max(32, int(size).bit_length() + _SPARE_BITS))

    def short(self, key: np.ndarray, order: int) -> np.ndarray:
        return key if order == 1 else key >> np.uint64(64 - self.bits)

    def place(self, key: np.ndarray, order: int, parts: int) -> np.ndarray:
        """The one of so many equal ranges that each key is in; keys in order give places in order."""
        top = key >> np.uint64((64 if order == 1 else self.bits) - 32)
        return ((top * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _cut(place: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(place, from, to) of each run of equal places."""
    cuts = np.flatnonzero(np.diff(place)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
        yield int(place[lo]), lo, hi


def _group(number: int, within: int) -> int:
    """The one of so many groups that a block is in: by a hash, as numbers of blocks share their low bits."""
    return int(words.mix(np.array([number + 1], np.uint64))[0] % np.uint64(within))


def _ask(order: int, plan: Plan):
    """Blocks of (doc_id, role, text): a row of tokens for each, and rows of keys and counts for each range of buckets."""
    schema = _arrow("dest long, " + _ROW)

    def block(number: int, gone: bool, ids: list, roles: list[int], lens: list[int], flat: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token = words.mix(np.concatenate(flat))
        flat.clear()
        n = np.array(lens)
        starts = np.cumsum(n) - n
        train = np.repeat(np.array(roles) != HELD_OUT, n)
        group = _group(number, plan.within)
        key, first = token, _start_key()
        for k in range(1, order + 1):
            if k > 1:
                key = _longer(key, token, starts, first)
            distinct, at = np.unique(plan.short(key, k), return_inverse=True)
            count = np.bincount(at[train], minlength=len(distinct))
            if k == 1:
                top = np.argsort(-np.bincount(at, minlength=len(distinct)), kind="stable")[:_TOP]
                number_of = np.empty(len(distinct), np.uint32)
                number_of[_numbered(len(distinct), top)] = np.arange(len(distinct), dtype=np.uint32)
                yield _rows(schema, [{"dest": -1 - number, "asker": number, "kind": 0, "part": 0, "gone": gone, "a": _planes(number_of[at]), "c": _planes(top), "ids": ids, "roles": roles, "lens": lens}])
            rows = []
            for r, lo, hi in _cut(plan.place(distinct, k, plan.ranges)):
                own = _planes(count[lo:hi])
                dest = (k << 56) + (r << 28) + group
                rows.append({"dest": dest, "asker": number, "kind": k, "part": r, "gone": gone, "a": own, "b": own if gone else None, "c": _pack_keys(distinct[lo:hi])})
            yield _rows(schema, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        open_blocks = {gone: ([], [], [], []) for gone in (False, True)}
        size = dict.fromkeys(open_blocks, 0)
        for batch in batches:
            for doc_id, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                seq = words.split(text.as_py())
                seq.append(_END)
                gone = role == DELETED
                for column, x in zip(open_blocks[gone], (doc_id, role, len(seq), words.hashes(seq, len(seq))), strict=True):
                    column.append(x)
                size[gone] += len(seq)
                if size[gone] >= BLOCK_TOKENS:
                    yield from block(number, gone, *open_blocks[gone])
                    number += 1
                    open_blocks[gone], size[gone] = ([], [], [], []), 0
        for gone, columns in open_blocks.items():
            if columns[0]:
                yield from block(number, gone, *columns)
                number += 1

    return run


def _total(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Of rows with keys: these, the distinct ones, the place of each key among them, and the sums of their counts (below 2 ** 53)."""
    keys = [_unpack_keys(r["c"]) for r in rows]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    none = lambda k: np.zeros(len(k), np.int64)
    total = {x: np.bincount(at, np.concatenate([_unplanes(r[x]) if r[x] is not None else none(k) for r, k in zip(rows, keys, strict=True)]), len(distinct)).astype(np.int64) for x in "ab"}
    return keys, distinct, at, total


def _answered(rows: list[dict], keys: list[np.ndarray], at: np.ndarray, total: dict[str, np.ndarray]) -> Iterator[dict]:
    """For each row, the totals of its keys; those of deleted documents only where they are asked for."""
    lo = 0
    for r, k in zip(rows, keys, strict=True):
        own = at[lo : lo + len(k)]
        lo += len(k)
        yield {x: r[x] for x in ("asker", "kind", "part", "gone")} | {"a": _planes(total["a"][own]), "b": _planes(total["b"][own]) if r["gone"] else None, "c": r["c"] if r["kind"] == 1 else None}


def _answer(table: pa.Table) -> pa.Table:
    """What a bucket answers: for each row that asked, the counts of its keys; for words, sums as well."""
    schema = _arrow(_ROW)
    rows = table.to_pylist()
    if rows[0]["kind"] == 0:
        return table.select(schema.names).cast(schema)
    keys, _, at, total = _total(rows)
    out = list(_answered(rows, keys, at, total))
    if rows[0]["kind"] == 1:
        train, main = total["a"], total["a"] - total["b"]
        sums = [int(train.sum()), int((train > 0).sum()), int(main.sum()), int((main > 0).sum())]
        out.append({"asker": -1 - rows[0]["dest"], "kind": -1, "part": 0, "gone": False, "ids": sums})
    return pa.Table.from_pylist(out, schema=schema)


def _merge(plan: Plan):
    """What a group of blocks asks of the buckets of one range: each key once, with the group's counts."""
    schema = _arrow("dest long, " + _ROW)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        kind, out = rows[0]["kind"], []
        _, distinct, _, total = _total(rows)
        for bucket, lo, hi in _cut(plan.place(distinct, kind, plan.ranges * plan.within)):
            out.append({"dest": (kind << 56) + bucket, "asker": rows[0]["dest"], "kind": kind, "part": bucket, "gone": True, "a": _planes(total["a"][lo:hi]), "b": _planes(total["b"][lo:hi]), "c": _pack_keys(distinct[lo:hi])})
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _deal(table: pa.Table) -> pa.Table:
    """The answers to a group of blocks, dealt to the blocks."""
    rows = table.to_pylist()
    asked = [r for r in rows if not r["back"]]
    back = sorted((r for r in rows if r["back"]), key=lambda r: r["part"])
    keys = [_unpack_keys(r["c"]) for r in asked]
    at = np.unique(np.concatenate(keys), return_inverse=True)[1]
    total = {x: np.concatenate([_unplanes(r[x]) for r in back]) for x in "ab"}
    return pa.Table.from_pylist(list(_answered(asked, keys, at, total)), schema=_arrow(_ROW))


def _answers(asked: DataFrame, plan: Plan) -> DataFrame:
    """Rows of tokens, of answers to blocks, and of sums, in the shared folder."""
    if plan.direct:
        return materialize(asked.groupBy("dest").applyInArrow(_answer, _ROW))
    first = materialize(asked)
    posted = first.filter("kind > 0")
    merged = posted.groupBy("dest").applyInArrow(_merge(plan), "dest long, " + _ROW)
    answers = materialize(merged.groupBy("dest").applyInArrow(_answer, _ROW))
    back = answers.filter("kind > 0").withColumn("dest", F.col("asker")).withColumn("back", F.lit(True))
    dealt = posted.withColumn("back", F.lit(False)).unionByName(back).groupBy("dest").applyInArrow(_deal, _ROW)
    out = materialize(dealt.unionByName(first.filter("kind = 0").drop("dest")).unionByName(answers.filter("kind = -1")))
    drop(first, answers)
    return out


class Counted:
    """A block's documents, and for each order the counts of the n-gram that ends at each token."""

    def __init__(self, table: pa.Table, order: int, plan: Plan):
        rows = table.to_pylist()
        doc = next(r for r in rows if r["kind"] == 0)
        self.ids, self.roles, self.lens = doc["ids"], np.array(doc["roles"]), np.array(doc["lens"])
        got = {k: sorted((r for r in rows if r["kind"] == k), key=lambda r: r["part"]) for k in range(1, order + 1)}
        keys = np.concatenate([_unpack_keys(r["c"]) for r in got[1]])
        token = keys[_numbered(len(keys), _unplanes(doc["c"]))][_unplanes(doc["a"])]
        starts = np.cumsum(self.lens) - self.lens
        self.train, self.main = [], []
        key, first = token, _start_key()
        for k in range(1, order + 1):
            if k > 1:
                key = _longer(key, token, starts, first)
            at = np.unique(plan.short(key, k), return_inverse=True)[1]
            train = np.concatenate([_unplanes(r["a"]) for r in got[k]])
            self.train.append(train[at].astype(np.int64))
            if doc["gone"]:
                self.main.append(self.train[-1] - np.concatenate([_unplanes(r["b"]) for r in got[k]])[at].astype(np.int64))


def _estimates(counts: list[np.ndarray], lens: np.ndarray, tokens: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token, the bucket of its context, and the estimates of order 0 (uniform), 1 and so on."""
    starts, ends = np.cumsum(lens) - lens, np.cumsum(lens) - 1
    documents = counts[0][ends[0]]
    p = [np.full(len(counts[0]), 1 / (vocabulary + 1)), counts[0] / max(tokens, 1)]
    bucket = np.zeros(len(counts[0]), np.int64)
    for k in range(1, len(counts)):
        context = np.empty(len(counts[0]))
        context[1:] = counts[k - 1][:-1]
        context[starts] = documents
        p.append(np.where(context > 0, counts[k] / np.maximum(context, 1), 0))
        bucket = np.where(context > 0, 64 * k + np.floor(np.log2(np.maximum(context, 1))).astype(np.int64), bucket)
    return bucket, np.stack(p)


def _weights(b: int, p: np.ndarray, n: np.ndarray, rounds: int) -> np.ndarray:
    """Weights of the orders for bucket b, by expectation-maximisation: n tokens have the estimates p[:, i]."""
    usable = np.arange(len(p)) <= (len(p) - 1 if b == -1 else 1 + b // 64)
    w = usable / usable.sum()
    for _ in range(rounds if n.sum() else 0):
        share = w[:, None] * p
        share /= np.maximum(share.sum(0), 1e-300)
        w = (share @ n + 0.1 * usable) / (n.sum() + 0.1 * usable.sum())
    return w


def learn_weights(bucket: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Weights of the orders for each bucket; see _weights().

    Orders beyond a bucket's context have no weight. A little is added to every other order's share, so that no
    token is impossible. Bucket -1 has the weights of all tokens together, for buckets that were not seen.
    """
    learned = {-1: _weights(-1, p, n, rounds)}
    for b in np.unique(bucket).tolist():
        learned[int(b)] = _weights(int(b), p[:, bucket == b], n[bucket == b], rounds)
    return learned


def weights_of(learned: dict[int, np.ndarray], bucket: np.ndarray) -> np.ndarray:
    """Weights for each token; a bucket that was not learned takes the nearest smaller one of its context's length."""
    out = np.empty((len(learned[-1]), len(bucket)))
    known = sorted(b for b in learned if b >= 0)
    for b in np.unique(bucket).tolist():
        near = [k for k in known if k // 64 == b // 64]
        below = [k for k in near if k <= b]
        w = learned[below[-1]] if below else learned[near[0]] if near else learned[-1]
        if not near:
            usable = np.arange(len(w)) <= 1 + b // 64
            w = np.where(usable, w, 0) / np.where(usable, w, 0).sum()
        out[:, bucket == b] = w[:, None]
    return out


def score(docs: DataFrame, held_out: Column, deleted: Column | None = None, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    held_out and deleted are conditions on docs. Tokens are words cut at ASCII white space, A-Z lower-cased, and
    an end; a null text is an empty one, which is its end alone. base_score is that of add-one unigrams, score
    the interpolated model's, both as log10 of the text's probability. Without training documents both are 0.
    A null condition counts as false. Repeated rows are scored, and counted, each by itself; a null id is
    passed on. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    if deleted is None:
        deleted = F.pmod(F.xxhash64(F.col(id_col)), F.lit(10)) == 0
    role = F.when(F.coalesce(held_out, F.lit(False)), HELD_OUT).when(F.coalesce(deleted, F.lit(False)), DELETED).otherwise(MAIN)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), role.alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan(size)
    answered = _answers(rows.mapInArrow(_ask(order, plan), "dest long, " + _ROW), plan)
    sums = answered.filter("kind = -1").select(*[F.col("ids")[i].alias(f"s{i}") for i in range(4)]).agg(*[F.sum(f"s{i}") for i in range(4)]).first()
    tokens, vocabulary, main_tokens, main_vocabulary = (int(x or 0) for x in sums)
    blocks = answered.filter("kind >= 0")
    binned = "bucket long, bins long, n double, " + ", ".join(f"p{k} double" for k in range(1, order + 1))

    def tally(table: pa.Table) -> pa.Table:
        block = Counted(table, order, plan)
        bucket, p = _estimates(block.main, block.lens, main_tokens, main_vocabulary)
        fine, coarse = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
        for k in range(1, order + 1):
            ratio = np.where(p[k] > 0, np.log2(np.maximum(p[k], 1e-300) / p[0]) * _BINS_PER_OCTAVE, -1000)
            place = np.round(np.clip(ratio, -1000, 2000)).astype(np.int64) + 1000
            fine, coarse = fine * 4096 + place, coarse * 4096 + place // 8
        out = []
        for key in (np.stack([bucket, fine]), np.stack([np.full(len(bucket), -1), coarse])):
            by = np.lexsort(key[::-1])
            first = np.flatnonzero(np.concatenate([[True], (np.diff(key[:, by]) != 0).any(0)]))
            sums = [np.add.reduceat(p[k][by], first) for k in range(1, order + 1)]
            out.append([*key[:, by[first]], np.diff([*first, len(by)]).astype(float), *sums])
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=_arrow(binned))

    # the held-out counts: a row for each bucket and bin of the estimates, a number that doesn't grow without bound
    by_bin = blocks.filter("gone").groupBy("asker").applyInArrow(tally, binned).groupBy("bucket", "bins")
    held = by_bin.agg(F.sum("n").alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, order + 1)])

    def learn(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        p = np.stack([np.full(len(n), 1 / (main_vocabulary + 1)), *(table.column(f"p{k}").to_numpy() / n for k in range(1, order + 1))])
        b = table.column("bucket")[0].as_py()
        return pa.table({"bucket": [b], "w": [_weights(b, p, n, ROUNDS)]})

    # a row for each bucket
    learned = {r[0]: np.array(r[1]) for r in held.groupBy("bucket").applyInArrow(learn, "bucket long, w array<double>").collect()}
    learned.setdefault(-1, np.full(order + 1, 1 / (order + 1)))

    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(table: pa.Table) -> pa.Table:
        block = Counted(table, order, plan)
        starts = np.cumsum(block.lens) - block.lens
        bucket, p = _estimates(block.train, block.lens, tokens, vocabulary)
        mixed = (weights_of(learned, bucket) * p).sum(0) if tokens else p[0]
        base = np.log10((block.train[0] + 1) / (tokens + vocabulary + 1))
        columns = [
            pa.array(block.ids, pa.int64()),
            pa.array(block.roles == HELD_OUT),
            pa.array(block.lens.astype(np.int64)),
            pa.array(np.add.reduceat((block.train[0] > 0).astype(np.int64), starts)),
            pa.array(np.full(len(block.lens), tokens, np.int64)),
            pa.array(np.add.reduceat(base, starts)),
            pa.array(np.add.reduceat(np.log10(mixed), starts)),
        ]
        return pa.Table.from_arrays(columns, schema=_arrow(fields))

    return blocks.groupBy("asker").applyInArrow(finish, fields)
