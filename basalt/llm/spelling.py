"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

Words are counted in tasks, then by a shuffle of one row a word and task. A word of l letters has l + 2 trigrams
(with padding), of which one edit changes three at most; so two near words share all but three of the longer one's, at
the same place or one further. Each word is posted under its four rarest trigrams with their place and its length: near
words meet under one of these. In each such unit a heap merges, by skipping, the posting lists of a word's trigrams at
the places that an edit allows, and words on as many lists as the bound asks are compared letter by letter.

A unit of many words is cut into blocks, and so are the words that ask it; each block meets each, so no task holds
more than a block.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, ship

#: Fixed value: what words are made of.
LETTERS = "A-Za-zÀ-ÿ"
Q = 3
#: a to z, U+00C0 to U+00FF and the padding; so there are ALPHABET ** Q trigrams at most, which the driver may hold.
ALPHABET = 26 + 64 + 1
#: Words of one block of a unit, and words that ask one.
BLOCK, ASKING = 8_192, 65_536
_FLUSH = 200_000
_LOWER = {c: c + 32 for c in range(65, 91)}
_PAD = "\0" * (Q - 1)
_POSTING = "gram int, place int, length int, side int, word string, n long"


def lower(run: str) -> str:
    """A to Z in lower case, other letters as they are."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


def words_of(doc_id: str, text: str, runs: re.Pattern, typo_every: int, min_letters: int) -> Counter:
    """How often each word stands in a text; a run whose checksum typo_every divides has lost a letter."""
    found: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    together: Counter = Counter()
    for run, times in Counter(runs.findall(text)).items():
        together[lower(run)] += times
    for word, times in together.items():
        h = zlib.crc32(word.encode(), start)
        if h % typo_every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < min_letters:
                continue
        found[word] += times
    return found


def vocabulary(docs: DataFrame, id_col: str, text_col: str, min_letters: int, min_count: int, typo_every: int) -> DataFrame:
    """(word, n) of the words with as many letters and occurrences."""
    ship(docs.sparkSession)
    # a run is found whole or not at all: a match starts at its first letter
    runs = re.compile(f"[{LETTERS}]{{{min_letters},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                for word, times in words_of(doc_id.as_py(), text.as_py(), runs, typo_every, min_letters).items():
                    total[word] += times
                if len(total) > _FLUSH:
                    yield packed()
                    total.clear()
        yield packed()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), text.alias("t"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, word's number, place) of all trigrams of all words, in order."""
    letters = np.frombuffer((_PAD + _PAD.join(words) + _PAD).encode("utf-32-le"), np.uint32).astype(np.int64)
    code = np.where(letters == 0, 0, np.where(letters < 128, letters - 96, letters - 0xC0 + 27))
    whole = code[: len(code) - Q + 1].copy()
    for k in range(1, Q):
        whole = whole * ALPHABET + code[k : len(code) - Q + 1 + k]
    n = np.array([len(w) + Q - 1 for w in words], np.int64)  # the padding after a word is the one before the next
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    number = np.repeat(np.arange(len(words)), n)
    return whole[: int(n.sum())], number, np.arange(int(n.sum())) - starts[number]


def gram_ranks(words: DataFrame) -> np.ndarray:
    """The place of each trigram when they are put in order of how many postings they have, rarest first."""
    n_grams = ALPHABET**Q

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_grams, np.int64)
        for b in batches:
            if len(b):
                total += np.bincount(_grams(b.column(0).to_pylist())[0], minlength=n_grams)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["gram", "n"])

    counted = words.select("word").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(n_grams, np.int64)
    n[counted.column("gram").to_numpy()] = counted.column("n").to_numpy()
    ranks = np.empty(n_grams, np.int32)
    ranks[np.argsort(n, kind="stable")] = np.arange(n_grams)
    return ranks


def postings(words: DataFrame) -> DataFrame:
    """(gram, place, length, side, word, n): words under their rarest trigrams (side 0), and where they ask for near words (side 1).

    A word asks those of its own length at the same place and those that are a letter shorter at the same place or one before it;
    longer ones ask it.
    """
    told = words.sparkSession.sparkContext.broadcast(gram_ranks(words))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            texts = b.column(0).to_pylist()
            gram, number, place = _grams(texts)
            order = np.lexsort((place, told.value[gram], number))
            first = np.searchsorted(number, np.arange(len(texts)))  # lexsort keeps words where they are
            chosen = order[np.arange(len(order)) - first[number] < Q + 1]
            length = np.array([len(w) for w in texts])
            g, w, p = gram[chosen], number[chosen], place[chosen]
            sides = ((0, p, 0), (1, p, 0), (1, p, 1), (1, p - 1, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(g, 4), pa.int32()),
                    pa.array(np.concatenate([x[1] for x in sides]), pa.int32()),
                    pa.array(np.concatenate([length[w] - x[2] for x in sides]), pa.int32()),
                    pa.array(np.repeat([x[0] for x in sides], len(g)), pa.int32()),
                    b.column(0).take(pa.array(np.tile(w, 4))),
                    b.column(1).take(pa.array(np.tile(w, 4))),
                ],
                ["gram", "place", "length", "side", "word", "n"],
            )

    return words.select("word", "n").mapInArrow(post, _POSTING).filter("place >= 0")


def merge_skip(lists: list[list[int]], least: int) -> list[int]:
    """Numbers that are on at least `least` of the ascending lists.

    A heap holds the head of each list. Where the smallest head isn't on enough lists, the `least` - 1 smallest heads
    can't be answers below the next one, so their lists skip to it.
    """
    found = []
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= least:
        low, out = heap[0][0], []
        while heap and heap[0][0] == low:
            out.append(heapq.heappop(heap))
        if len(out) >= least:
            found.append(low)
            to = low + 1
        else:
            while heap and len(out) < least - 1:
                out.append(heapq.heappop(heap))
            to = max(low + 1, heap[0][0]) if heap else None
        for _, i, at in out:
            if to is not None:
                at = bisect_left(lists[i], to, at)
                if at < len(lists[i]):
                    heapq.heappush(heap, (lists[i][at], i, at))
    return found


def one_edit(a: str, b: str) -> bool:
    """Whether a, no longer than b, becomes b by one letter inserted or replaced."""
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else i < len(a) and a[i + 1 :] == b[i + 1 :]


class Unit:
    """Words of one length under one trigram and place, by all their trigrams and places."""

    def __init__(self, members: list[tuple[str, int]]) -> None:
        self.members = members
        self.lists: dict[tuple[int, str], list[int]] = {}
        for number, (word, _) in enumerate(members):
            padded = _PAD + word + _PAD
            for at in range(len(word) + Q - 1):
                self.lists.setdefault((at, padded[at : at + Q]), []).append(number)

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Members one edit away that are shorter, or of the same length and before the word in order."""
        padded, shorter = _PAD + word + _PAD, len(self.members[0][0]) < len(word)
        grams = [(at, padded[at : at + Q]) for at in range(len(word) + Q - 1)]
        lists = [x for at, g in grams for x in (self.lists.get((at, g)), self.lists.get((at - 1, g)) if shorter else None) if x]
        for number in merge_skip(lists, len(word) - 1):
            other, n = self.members[number]
            if (shorter or other < word) and one_edit(other, word):
                yield other, n


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), each pair of words one edit apart once, of words(word, n) of three letters or more."""
    ship(words.sparkSession)
    rows = postings(words)
    side = lambda x: F.count(F.when(F.col("side") == x, 1))
    sizes = rows.groupBy("gram", "place", "length").agg(F.ceil(side(0) / BLOCK).alias("blocks"), F.ceil(side(1) / ASKING).alias("parts"))
    many = materialize(sizes.filter("blocks > 1 OR (parts > 1 AND blocks > 0)"))
    mine = lambda n: F.pmod(F.xxhash64("word"), F.coalesce(n, F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1))
    rows = rows.join(many, ["gram", "place", "length"], "left")
    posted = rows.filter("side = 0").withColumn("block", mine(F.col("blocks"))).withColumn("part", every(F.col("parts")))
    asked = rows.filter("side = 1").withColumn("part", mine(F.col("parts"))).withColumn("block", every(F.col("blocks")))
    unit = ["gram", "place", "length", "block", "part"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, index = None, [], None
        for b in batches:
            out = []
            for *now, word, n, side in zip(*[b.column(c).to_pylist() for c in (*unit, "word", "n", "side")], strict=True):
                if now != key:
                    key, members, index = now, [], None
                if not side:
                    members.append((word, n))
                elif members:
                    index = index or Unit(members)
                    out += [(word, n, *x) for x in index.near(word)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64()) * 2)], ["word", "n", "other", "other_n"])

    work = posted.select(*unit, "side", "word", "n").unionByName(asked.select(*unit, "side", "word", "n"))
    # a number keeps small partitions apart, each of which is much work
    work = work.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), *unit).sortWithinPartitions(*unit, "side")
    return work.mapInArrow(match, "word string, n long, other string, other_n long").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form, form_n): forms followed to the last, twice as far in each round.

    A form occurs `ratio` times as often as its word, so a chain is no longer than the logarithm of the largest count.
    """
    most = forms.agg(F.max("form_n")).first()[0] or 1
    steps = 1 + math.ceil(math.log(max(most, 1), 2))
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialize(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        done = after.filter("moved").isEmpty()
        now = after.select("word", "root")
        if done:
            break
    return now


def variants(
    docs: DataFrame, min_letters: int = 6, min_count: int = 5, ratio: int = 5, typo_every: int = 199, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    Words are maximal runs of LETTERS with A to Z in lower case, of min_letters or more, that occur min_count times or more.
    A run whose CRC-32 after its document's id and a colon is divisible by typo_every is taken without one letter. A word's
    form is the near word (one letter inserted, deleted or replaced) that occurs most, of equal ones the first in
    order of code points, if it occurs `ratio` times as often; else null. root is what forms lead to in the end, the word
    itself where it has none. A null text has no words, a null id is an empty one, repeated rows count as often as they stand
    there, an empty table gives no rows, and other columns are not looked at.
    """
    if min_letters < Q or ratio < 2 or typo_every < 1:
        raise ValueError("words need three letters or more, a form has to be twice as frequent or more, and typo_every is 1 or more")
    words = materialize(vocabulary(docs, id_col, text_col, min_letters, min_count, typo_every))
    pairs = near_pairs(words)
    both = F.explode(F.array(F.struct(F.col("word").alias("w"), F.col("other").alias("o"), F.col("other_n").alias("n")), F.struct(F.col("other").alias("w"), F.col("word").alias("o"), F.col("n").alias("n"))))
    best = F.min(F.struct((-F.col("x.n")).alias("m"), F.col("x.o").alias("o")))
    near = pairs.select(both.alias("x")).groupBy(F.col("x.w").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    out = words.join(near, "word", "left").withColumn("_most", -F.col("best.m"))
    has = F.col("_most") >= ratio * F.col("n")
    out = materialize(out.select("word", F.when(has, F.col("best.o")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("_most")).alias("form_n")))
    drop(words)
    root = _roots(out.filter("form IS NOT NULL"))
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
