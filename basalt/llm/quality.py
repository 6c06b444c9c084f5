"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line is scored on its own features and its neighbours', neighbouring labels on
how often they change. Forward-backward gives each line's probability to be good; their mean, weighted by
length, is the document's quality, which a logistic curve then scales to the labels' frequency.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import keep_rows, ship

#: Bounds of the training sample: documents of either label, and lines of such a document. At both bounds the driver
#: collects 250 MB of features, of 2.4 million lines, and fits on a matrix of 1.1 GB; documents of ten lines make a fortieth.
TRAIN_DOCS_PER_LABEL = 3000
TRAIN_LINES_PER_DOC = 400
_CHUNK_CHARS = 300_000

_CLASSES = 8  # lower, upper, digit, space, sentence mark, bar, other ASCII mark, the rest


def _class_table() -> np.ndarray:
    table = np.full(1 << 16, 7, np.uint8)
    for c in range(1 << 16):
        s = chr(c)
        if s.islower():
            table[c] = 0
        elif s.isupper():
            table[c] = 1
        elif s.isdigit():
            table[c] = 2
        elif s.isspace():
            table[c] = 3
        elif s in ".,;:?":
            table[c] = 4
        elif s == "|":
            table[c] = 5
        elif c < 128:
            table[c] = 6
    return table


_table: np.ndarray | None = None


def _repeats(text: str, counts: list[int]) -> np.ndarray:
    """For each line, the share of its three-word runs that the document holds more than once, and of words just said."""
    seq = words.split(text)
    h = words.hashes(seq, len(seq))
    out = np.zeros((len(counts), 2))
    if len(h) < 2:
        return out
    s = words.shingles(h, 3)
    _, inverse, n = np.unique(s, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    for k, flags in enumerate((n[inverse] > 1, h[1:] == h[:-1])):
        total = np.concatenate([[0.0], np.cumsum(flags)])
        lo, hi = np.minimum(ends - counts, len(flags)), np.minimum(ends, len(flags))
        out[:, k] = (total[hi] - total[lo]) / np.maximum(hi - lo, 1)
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and length of every line of every text, and how many lines each text has (an empty one has 1)."""
    global _table
    if _table is None:
        _table = _class_table()
    lines = [t.split("\n") for t in texts]
    per_doc = np.array([len(x) for x in lines])
    flat = [x for doc in lines for x in doc]
    n = np.array([len(x) for x in flat], np.int64)
    code = np.frombuffer("\n".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _table[np.minimum(code, 0xFFFF)]
    starts = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
    share = np.empty((len(flat), _CLASSES))
    for k in range(_CLASSES):
        c = np.concatenate([[0], np.cumsum(kind == k)])
        share[:, k] = c[starts + n] - c[starts]
    n_words = np.array([len(x.split()) for x in flat], float)
    repeats = np.concatenate([_repeats(t, [len(x.encode("utf-8", "surrogatepass").split()) for x in doc]) for t, doc in zip(texts, lines, strict=True)])
    letters = share[:, 0] + share[:, 1]
    size = np.maximum(n, 1)
    f = np.column_stack([
        np.log1p(n) / 5,
        share[:, 1] / np.maximum(letters, 1),
        share[:, 2] / size,
        share[:, 3] / size,
        share[:, 4] / np.maximum(n_words, 1),
        np.log1p(100 * share[:, 5] / size),
        np.log1p(100 * share[:, 6] / size),
        share[:, 7] / size,
        letters / size,
        np.minimum((n - share[:, 3]) / np.maximum(n_words, 1), 40) / 10,
        repeats,
        n == 0,
    ])
    return f, n, per_doc


def with_neighbours(f: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """A line's features, their squares, those of the lines before and after it, and whether there are such."""
    first = np.zeros(len(f), bool)
    first[np.cumsum(per_doc) - per_doc] = True
    last = np.zeros(len(f), bool)
    last[np.cumsum(per_doc) - 1] = True
    before, after = np.roll(f, 1, axis=0), np.roll(f, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.column_stack([np.ones(len(f)), f, f * f, before, after, first, last])


def marginals(score: np.ndarray, change: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Probability of every line to be good. score: of good against bad; change[a, b]: of label b after a."""
    t00, t01, t10, t11 = np.exp(change).ravel().tolist()
    e = np.exp(np.clip(score, -30, 30)).tolist()
    out = np.empty(len(e))
    at = 0
    for m in per_doc.tolist():
        alpha = []
        a, b = 1.0, e[at]
        s = a + b
        a, b = a / s, b / s
        alpha.append((a, b))
        for i in range(at + 1, at + m):
            a, b = a * t00 + b * t10, (a * t01 + b * t11) * e[i]
            s = a + b
            a, b = a / s, b / s
            alpha.append((a, b))
        x, y = 1.0, 1.0
        for i in range(at + m - 1, at - 1, -1):
            a, b = alpha[i - at]
            good = b * y
            out[i] = good / (a * x + good)
            y *= e[i]
            x, y = t00 * x + t01 * y, t10 * x + t11 * y
            s = x + y
            x, y = x / s, y / s
        at += m
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    change: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def quality(self, texts: list[str | None]) -> list[float]:
        """Score of every text, 0 to 1; a null text is an empty one, which is one line without characters."""
        out: list[float] = []
        chunk, size = [], 0
        for t in texts:
            chunk.append(t or "")
            size += len(chunk[-1])
            if size > _CHUNK_CHARS:
                out += self._score(chunk)
                chunk, size = [], 0
        return out + (self._score(chunk) if chunk else [])

    def _score(self, texts: list[str]) -> list[float]:
        raw = self.raw(*line_features(texts))
        z = np.clip(raw, 1e-6, 1 - 1e-6)
        return (1 / (1 + np.exp(-(self.slope * np.log(z / (1 - z)) + self.shift)))).tolist()

    def raw(self, f: np.ndarray, n: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """Mean of the lines' probabilities, weighted by their length."""
        x = with_neighbours((f - self.mean) / self.scale, per_doc)
        p = marginals(x @ self.weight, self.change, per_doc)
        starts = np.cumsum(per_doc) - per_doc
        w = n + 1.0
        return np.add.reduceat(p * w, starts) / np.add.reduceat(w, starts)


def _fit(f: np.ndarray, per_doc: np.ndarray, n: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int, l2: float) -> Model:
    """Climb the conditional likelihood of the labels, all lines of a document having the document's."""
    mean, scale = f.mean(0), f.std(0) + 1e-3
    x = with_neighbours((f - mean) / scale, per_doc)
    starts = np.cumsum(per_doc) - per_doc
    groups = []
    for low in (2**k for k in range(20)):
        docs = np.flatnonzero((per_doc >= low) & (per_doc < 2 * low))
        if len(docs):
            at = starts[docs, None] + np.arange(per_doc[docs].max())[None, :]
            inside = np.arange(per_doc[docs].max())[None, :] < per_doc[docs, None]
            groups.append((np.where(inside, at, 0), inside, label[docs]))
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        score, change = np.clip(x @ theta[:-4], -30, 30), theta[-4:].reshape(2, 2)
        t = np.exp(change)
        d_line, d_change = np.zeros(len(x)), np.zeros((2, 2))
        for at, inside, y in groups:
            k = at.shape[1]
            e = np.stack([np.ones(at.shape), np.exp(score[at])], 2)
            alpha = np.empty_like(e)
            alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
            for i in range(1, k):
                a = (alpha[:, i - 1] @ t) * e[:, i]
                alpha[:, i] = np.where(inside[:, i, None], a / a.sum(1, keepdims=True), alpha[:, i - 1])
            beta = np.ones((len(at), 2))
            for i in range(k - 1, -1, -1):
                p = alpha[:, i] * beta
                p /= p.sum(1, keepdims=True)
                here = inside[:, i]
                d_line[at[here, i]] = y[here] - p[here, 1]
                if i:
                    pair = alpha[:, i - 1, :, None] * t[None] * (e[:, i] * beta)[:, None, :]
                    pair /= pair.sum((1, 2), keepdims=True)
                    d_change -= pair[here].sum(0)
                    d_change[0, 0] += (here & (y == 0)).sum()
                    d_change[1, 1] += (here & (y == 1)).sum()
                    b = (e[:, i] * beta) @ t.T
                    beta = np.where(here[:, None], b / b.sum(1, keepdims=True), beta)
        g = np.concatenate([x.T @ d_line, d_change.ravel()]) / len(per_doc) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))
    z = np.clip(model.raw(f, n, per_doc), 1e-6, 1 - 1e-6)
    z = np.log(z / (1 - z))
    a, b = 0.5, 0.0
    for _ in range(50):  # Newton's steps for the curve
        p = 1 / (1 + np.exp(-(a * z + b)))
        r, h = weight * (label - p), weight * p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, [(r * z).sum() - 1e-3 * (a - 0.5), r.sum()])
        a, b = max(0.05, a + float(np.clip(da, -0.5, 0.5))), b + float(np.clip(db, -1, 1))
    model.slope, model.shift = a, b
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    steps: int = 120,
    l2: float = 1e-3,
) -> Model:
    """Fit on a bounded sample: of either label, the TRAIN_DOCS_PER_LABEL documents least by a hash of their id.

    may_learn is a condition on labels.<id_col>. Rows without id or label are left out, as are documents of
    more than TRAIN_LINES_PER_DOC lines; a document labelled twice counts as the lower label. Where no label of
    one kind is found, the model gives every text the share of good labels.
    """
    ship(docs.sparkSession)
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    if may_learn is not None:
        marked = marked.filter(may_learn)
    marked = marked.groupBy("doc_id").agg(F.min("label").alias("label"))
    totals = {r[0]: r[1] for r in marked.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id")
    sample = [marked.filter(F.col("label") == k).orderBy(order, "doc_id").limit(TRAIN_DOCS_PER_LABEL) for k in (0, 1)]
    chosen = F.broadcast(sample[0].unionByName(sample[1]))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(chosen, "doc_id").filter(F.size(F.split("text", "\n")) <= TRAIN_LINES_PER_DOC)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed, sizes = [], []
            for text in b.column(1):
                f, n, _ = line_features([text.as_py()])
                packed.append(f.astype("<f8").tobytes())
                sizes.append(n.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary()), pa.array(sizes, pa.binary())], ["doc_id", "label", "f", "n"])

    got = sorted(rows.mapInArrow(measure, "doc_id long, label int, f binary, n binary").collect(), key=lambda r: (r[0], r[2]))
    width = line_features([""])[0].shape[1]
    found = {r[1] for r in got}
    if found != {0, 1}:
        share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
        return Model(np.zeros(width), np.ones(width), np.zeros(4 * width + 3), np.zeros((2, 2)), 0.0, math.log(share / (1 - share)))
    f = np.concatenate([np.frombuffer(r[2]).reshape(-1, width) for r in got])
    n = np.concatenate([np.frombuffer(r[3], np.int64) for r in got])
    per_doc = np.array([len(r[3]) // 8 for r in got])
    label = np.array([r[1] for r in got])
    counted = {k: max(1, int((label == k).sum())) for k in (0, 1)}
    weight = np.array([totals[k] / counted[k] for k in label])
    return _fit(f, per_doc, n, label, weight / weight.mean(), steps, l2)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row; a null or empty text is scored as an empty line. Repeated rows stay."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.quality(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score `least` or more, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda texts: [s >= least for s in sent.value.quality(texts)])
