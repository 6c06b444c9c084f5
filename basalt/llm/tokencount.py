"""Token counts from an exact histogram of encoded lengths.

Documents are encoded once, in Arrow batches; all that is shuffled is one row per length and task. The
histogram, a row for each length, is written to the shared folder, and all else is read from it. Suffix sums
over the histogram answer, for every context limit, how many documents are longer, how many tokens there are in
all and how many are left when documents are cut at the limit.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

#: Fixed value: how byte-level BPE vocabularies of this kind cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 64 << 20
#: A longer run of white space is cut out and merged by itself: the pattern looks ahead from each of its characters.
LONG_RUN = 50_000
_BLANK = re.compile(r"\s{%d,}" % LONG_RUN)


@functools.lru_cache(maxsize=2)
def _encoding(packed: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, zlib.decompress(packed).splitlines())}
    return tiktoken.Encoding("basalt", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _joined(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one token after another as one, empty ones left out."""
    tokens, counts = tokens[counts > 0], counts[counts > 0]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, np.int64)
    return tokens[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def merged_length(raw: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one piece by byte-pair merging: the pair of least rank first, from the left.

    The piece is held as runs of equal tokens, and all places of a pair are merged at once, which is the same as one
    after another, as a token's rank is above those of its parts. So a run of any length takes as many steps as it
    has kinds of merges.
    """
    names = [bytes([i]) for i in range(256)]
    number = {n: i for i, n in enumerate(names)}
    tokens, counts = _joined(np.frombuffer(raw, np.uint8).astype(np.int64), np.ones(len(raw), np.int64))

    def rank(pair: int) -> int:
        return ranks.get(names[pair >> 32] + names[pair & 0xFFFFFFFF], 1 << 60)

    while len(tokens):
        twice = np.where(counts > 1, tokens << 32 | tokens, -1)
        side = tokens[:-1] << 32 | tokens[1:]
        known = {int(p): rank(int(p)) for p in np.union1d(twice, side) if p >= 0}
        least = min(known.values(), default=1 << 60)
        if least == 1 << 60:
            break
        pairs = np.array([p for p, r in known.items() if r == least])
        within, beside = np.isin(twice, pairs), np.isin(side, pairs)
        if within.any() and beside.any():  # one token out of different pairs: places may share a token, so runs are written out
            tokens = np.repeat(tokens, counts)
            counts, within = np.ones(len(tokens), np.int64), np.zeros(len(tokens), bool)
            side = tokens[:-1] << 32 | tokens[1:]
            beside = np.isin(side, pairs)
        made = names[int(pairs[0]) >> 32] + names[int(pairs[0]) & 0xFFFFFFFF]
        if made not in number:
            number[made] = len(names)
            names.append(made)
        new = number[made]
        if within.any():
            half = np.where(within, counts // 2, 0)
            tokens = np.stack([np.full_like(tokens, new), tokens], 1).ravel()
            counts = np.stack([half, np.where(within, counts % 2, counts)], 1).ravel()
        else:
            # where the token between two places is a single one, only the left place has it
            linked = np.concatenate([[False], beside[1:] & beside[:-1] & (counts[1:-1] == 1)])
            at = np.arange(len(beside))
            start = np.maximum.accumulate(np.where(linked, 0, at))
            take = np.concatenate([beside & ((at - start) % 2 == 0), [False]])
            left = counts - take
            left[1:] -= take[:-1]
            tokens = np.stack([tokens, np.full_like(tokens, new)], 1).ravel()
            counts = np.stack([left, take.astype(np.int64)], 1).ravel()
        tokens, counts = _joined(tokens, counts)
    return int(counts.sum())


def text_length(text: str, enc) -> int:
    """Tokens of a text; a long run of white space goes to the encoder without all but its last character, which may start a token."""
    total, at = 0, 0
    for m in _BLANK.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += len(enc.encode_ordinary(text[at : m.start()])) + merged_length(text[m.start() : end].encode(), enc._mergeable_ranks)
        at = end
    return total + len(enc.encode_ordinary(text[at:]))


def token_lengths(df: DataFrame, vocabulary: str, text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """n_tokens of each row's whole text, and no other column; a null or empty text has 0 tokens.

    vocabulary is a file of token ranks. It is read by the driver and sent along with the tasks, so executors
    need no file of their own; it may have at most MAX_VOCABULARY_BYTES. White space, however much, counts as the pattern
    has it: a run that a text goes on after is one piece but for its last character.
    """
    raw = Path(vocabulary).read_bytes()
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has {len(raw)} bytes; {MAX_VOCABULARY_BYTES} are allowed")
    ship(df.sparkSession)
    packed = df.sparkSession.sparkContext.broadcast(zlib.compress(raw))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(packed.value, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([text_length(x.as_py(), enc) for x in b.column(0)], pa.int64())], ["n_tokens"])

    texts = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(encode, "n_tokens long")


def length_histogram(lengths: DataFrame, chunk: int = 64) -> DataFrame:
    """One row per length that occurs: n_tokens, n_docs, and what holds at a context limit of that length.

    docs_at_least counts documents of this length or longer, tokens_at_least their tokens; total_docs and
    total_tokens cover all; truncated_tokens is the sum of min(length, this length); quantile is the share of
    documents of at most this length. All are exact. Suffix sums are taken within chunks of `chunk` lengths, and
    in one task over the sums of chunks, which has a row for each chunk: the longest length / `chunk` at most,
    whatever the number of documents. An empty table gives no rows.
    """
    hist = materialize(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))
    hist = hist.withColumn("chunk", F.floor(F.col("n_tokens") / chunk)).withColumn("n", F.col("n_tokens") * F.col("n_docs"))
    sums = hist.groupBy("chunk").agg(F.sum("n_docs").alias("chunk_docs"), F.sum("n").alias("chunk_tokens"))
    above = Window.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        "chunk",
        F.coalesce(F.sum("chunk_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("chunk_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("chunk_docs").over(everything).alias("total_docs"),
        F.sum("chunk_tokens").over(everything).alias("total_tokens"),
    )
    within = Window.partitionBy("chunk").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        hist.join(sums, "chunk")
        .withColumn("docs_at_least", F.col("docs_above") + F.sum("n_docs").over(within))
        .withColumn("tokens_at_least", F.col("tokens_above") + F.sum("n").over(within))
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            "total_docs",
            "total_tokens",
            (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"),
            ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
        )
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_tokens, lost_tokens) for any limits, also lengths that don't occur."""
    each = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit")
    over = F.col("n_tokens") > F.col("context_limit")
    return (
        histogram.select("n_tokens", "n_docs", each)
        .groupBy("context_limit")
        .agg(
            F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"),
            F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("truncated_tokens"),
            F.sum(F.when(over, F.col("n_tokens") - F.col("context_limit")).otherwise(0) * F.col("n_docs")).alias("lost_tokens"),
        )
    )
