"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the number of their shingles. From each item its bottom-k MinHash sketch is posted,
k being one more than the shingles that an item of the partition's largest size may miss at the threshold.
So whatever a document's length, one that contains enough of an item holds at least one of its posted
shingles: the search has no false negatives. What it finds is verified on the item's exact shingles.
Documents stream past the index in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import keep_rows, ship

#: Items, and bytes of their texts, sent to every task at once; a larger benchmark is searched in blocks, each a
#: pass over the documents. Only an item that is longer by itself makes a larger block, of that item alone.
ITEMS_PER_BLOCK = 50_000
BYTES_PER_BLOCK = 16 << 20
_MOST_BITS = 48
_FILTER_BITS = 20


class Index:
    """Posted sketch shingles of a block of items, and their exact shingles."""

    def __init__(self, items: list[tuple[int, str]], width: int, min_percent: int):
        self.min_percent, self.items = min_percent, []
        by_width: dict[int, list[tuple[np.ndarray, int]]] = {}
        sized = []
        for item_id, text in items:
            seq = words.split(text, words.PUNCTUATION)
            if not seq:
                continue
            w = min(width, len(seq))
            exact = {b" ".join(seq[i : i + w]) for i in range(len(seq) - w + 1)}
            sized.append((w, len(exact), item_id, seq, exact))
        largest: dict[int, int] = {}
        for _, q, *_ in sized:
            largest[q.bit_length()] = max(q, largest.get(q.bit_length(), 0))
        for w, q, item_id, seq, exact in sized:
            missing = largest[q.bit_length()] * (100 - min_percent) // 100
            h = np.unique(words.shingles(words.hashes(seq, len(seq)), w))
            by_width.setdefault(w, []).append((h[np.argsort(words.mix(h))[: missing + 1]], len(self.items)))
            self.items.append((item_id, w, exact))
        self.posted = {}
        for w, lists in by_width.items():
            h = np.concatenate([x for x, _ in lists])
            owner = np.concatenate([np.full(len(x), i) for x, i in lists])
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << _FILTER_BITS, bool)
            table[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.posted[w] = (h[order], owner[order], table)

    def candidates(self, h: np.ndarray) -> set[int]:
        """Items with a posted shingle among the words whose hashes are given."""
        found: set[int] = set()
        for w, (posted, owner, table) in self.posted.items():
            s = words.shingles(h, w)
            s = np.unique(s[table[(s >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]])
            lo, hi = np.searchsorted(posted, s, "left"), np.searchsorted(posted, s, "right")
            for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True):
                found.update(owner[a:b].tolist())
        return found

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, its shingles found in the text, its shingles) where enough are found."""
        seq = words.split(text, words.PUNCTUATION)
        if not seq:
            return []
        found, sets = [], {}
        for i in sorted(self.candidates(words.hashes(seq, len(seq)))):
            item_id, w, exact = self.items[i]
            if w not in sets:
                sets[w] = {b" ".join(seq[k : k + w]) for k in range(len(seq) - w + 1)}
            n = len(exact & sets[w])
            if 100 * n >= self.min_percent * len(exact):
                found.append((item_id, n, len(exact)))
        return found


def _blocks(items: DataFrame, item_id_col: str, item_text_col: str, width: int, min_percent: int) -> Iterator[Index]:
    rows = items.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct()
    bytes_of = F.sum(F.octet_length("t"))
    fits = lambda n, size: n <= ITEMS_PER_BLOCK and size <= BYTES_PER_BLOCK
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(bytes_of, F.lit(0))).first()
    if fits(n, size):
        yield Index([tuple(r) for r in rows.collect()], width, min_percent)
        return
    # ranges of the hash of id and text, halved until each fits or holds one row, then joined while they fit
    bits, cells = 0, []
    while not cells or bits < _MOST_BITS and any(c.n > 1 and not fits(c.n, c.size) for c in cells):
        bits = bits + 1 if cells else max(1, min(_MOST_BITS, max(n // ITEMS_PER_BLOCK, size // BYTES_PER_BLOCK).bit_length() + 2))
        place = F.shiftrightunsigned(F.xxhash64("i", "t"), 64 - bits)
        cells = rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), bytes_of.alias("size")).orderBy("place").collect()
    blocks: list[list[int]] = []  # first and last place, items, bytes
    for c in cells:
        if blocks and fits(blocks[-1][2] + c.n, blocks[-1][3] + c.size):
            first, _, items_before, bytes_before = blocks[-1]
            blocks[-1] = [first, c.place, items_before + c.n, bytes_before + c.size]
        else:
            blocks.append([c.place, c.place, c.n, c.size])
    for first, last, *_ in blocks:
        yield Index([tuple(r) for r in rows.filter(place.between(first, last)).collect()], width, min_percent)


def find(
    docs: DataFrame,
    items: DataFrame,
    width: int = 5,
    min_percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_found, n_shingles): documents that hold at least min_percent of an item's shingles.

    Words are lower-cased (A-Z) and freed from ASCII punctuation. An item shorter than `width` words is one
    shingle of all its words; items without words, id or text match nothing, nor do texts that are null or
    empty. Repeated documents give repeated rows; an item row that is repeated counts once. An empty table
    on either side gives no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = []
    for index in _blocks(items, item_id_col, item_text_col, width, min_percent):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in sent.value.search(t)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in hits], pa.int64()) for k in range(4)], ["doc_id", "item_id", "n_found", "n_shingles"])

        found.append(rows.mapInArrow(search, "doc_id long, item_id long, n_found long, n_shingles long"))
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, items: DataFrame, width: int = 5, min_percent: int = 80, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, as find() decides, with all their columns."""
    for index in _blocks(items, item_id_col, item_text_col, width, min_percent):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        docs = keep_rows(docs, text_col, lambda texts, sent=sent: [not sent.value.search(t) for t in texts])
    return docs
