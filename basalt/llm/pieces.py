"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

No piece crosses the start of a run of spaces, nor a character that is part of no piece, so a text's lattice
falls into segments that can be cut one by one. Forward Viterbi scores of many distinct segments are computed
at once. A backward A* search, for which these scores are exact heuristics, lists the best segmentations of a
segment; those of a text change at most N - 1 of its segments, the ones whose second best costs least.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

SPACE = "▁"
MAX_MODEL_BYTES = 64 << 20
_CELLS = 150_000
#: Segments longer than this are cut one by one, over the arcs that they have.
_LONG = 512
#: Scores are multiples of this, so that sums over a text are exact and equal ones are equal however they are added.
_GRAIN = 2.0**-24
_CUT = re.compile(f"{SPACE}| +[^ \n{SPACE}]*|\n|[^ \n{SPACE}]+")
_NONE = -np.inf


def _grained(score: np.ndarray | float) -> np.ndarray | float:
    return np.round(np.asarray(score) / _GRAIN) * _GRAIN


class Pieces:
    """A piece vocabulary as a trie.

    A piece's score is the file's. Files of merges hold bare ranks instead, which are no log-probabilities: there a
    piece's score is the log of Zipf's law at its rank.
    """

    def __init__(self, pieces: list[str], byte_ids: dict[int, int], scores: list[float] | None = None):
        """pieces: by id, "" for what is no text piece; byte_ids: the id of each of the 256 byte pieces; scores: by id, None for ranks."""
        self.byte_ids = byte_ids
        self.raw = [p.replace(SPACE, " ").encode() for p in pieces]
        for byte, i in byte_ids.items():
            self.raw[i] = bytes([byte])
        ranked = [i for i, p in enumerate(pieces) if p]
        self.score = np.full(len(pieces), _NONE)
        self.score[ranked] = _grained(-np.log(np.arange(len(ranked)) + 2.0) if scores is None else [scores[i] for i in ranked])
        self.unknown = float(_grained(-math.log(len(ranked) + 2.0) - 10 if scores is None else min(scores[i] for i in ranked) - 10))
        self.ids = {pieces[i]: i for i in reversed(ranked)}
        self.longest = max(map(len, self.ids))
        nodes, edges, piece = 1, {}, [-1]
        for text, i in self.ids.items():
            at = 0
            for c in text:
                key = (at << 21) | ord(c)
                if key not in edges:
                    edges[key] = nodes
                    piece.append(-1)
                    nodes += 1
                at = edges[key]
            piece[at] = i
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int32)
        self.piece = np.array(piece, np.int32)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses the end of a segment")

    @classmethod
    def from_model(cls, raw: bytes) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = m.get_piece_size()
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)]
        own = np.array([m.get_score(i) for i in range(n) if not special[i]])
        bare = bool((own == np.round(own)).all())  # ranks, in whatever order the pieces stand
        pieces = ["" if special[i] else m.id_to_piece(i) for i in range(n)]
        return cls(pieces, {int(m.id_to_piece(i)[1:-1], 16): i for i in range(n) if m.is_byte(i)}, None if bare else [m.get_score(i) for i in range(n)])

    def decode(self, ids: list[int]) -> str:
        """The text that encode() cut into these ids."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    def _step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = (node.astype(np.int64) << 21) | code
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.to[at], 0)

    def _arcs(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and piece of the arc of each length (less 1) from each place of each segment; codes: place x segment."""
        m, k = codes.shape
        longest = min(self.longest, m)
        score, piece = np.full((longest, m, k), _NONE), np.full((longest, m, k), -1, np.int32)
        place, seg = np.nonzero(np.arange(m)[:, None] < length[None, :])
        score[0, place, seg] = self.unknown
        node = np.zeros(len(place), np.int32)
        for n in range(longest):
            here = place + n < length[seg]
            place, seg, node = place[here], seg[here], node[here]
            node = self._step(node, codes[place + n, seg])
            place, seg, node = place[node > 0], seg[node > 0], node[node > 0]
            if not len(place):
                break
            found = self.piece[node]
            ends = found >= 0
            score[n, place[ends], seg[ends]] = self.score[found[ends]]
            piece[n, place[ends], seg[ends]] = found[ends]
        return score, piece

    def _best(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For segments of like length: score, cost of the second best, number of ids, and the ids one after another."""
        length = np.fromiter(map(len, segments), np.int64, len(segments))
        m, k = int(length.max()), len(segments)
        flat = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.zeros((m, k), np.int64)
        owner = np.repeat(np.arange(k), length)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        codes[place, owner] = np.where(flat == 0x20, ord(SPACE), np.where(flat == ord(SPACE), 0, flat))
        score, piece = self._arcs(codes, length)
        longest = len(score)
        fwd, back = np.full((m + 1, k), _NONE), np.zeros((m + 1, k), np.int64)
        fwd[0] = 0
        for p in range(1, m + 1):
            n = min(longest, p)
            # longest arc first, so that it wins a tie
            cand = fwd[p - n : p] + score[np.arange(n)[::-1], np.arange(p - n, p)]
            at = cand.argmax(0)
            fwd[p] = np.take_along_axis(cand, at[None], 0)[0]
            back[p] = n - at
        bwd = np.full((m + 1, k), _NONE)
        bwd[length, np.arange(k)] = 0
        for p in range(m - 1, -1, -1):
            n = min(longest, m - p)
            bwd[p] = np.maximum(bwd[p], (score[:n, p] + bwd[p + 1 : p + 1 + n]).max(0))
        best = bwd[0]
        taken = np.zeros((m, k), np.int64)
        at, live = length.copy(), np.arange(k)
        while len(live):
            n = back[at[live], live]
            at[live] -= n
            taken[at[live], live] = n
            live = live[at[live] > 0]
        seg, place = np.nonzero(taken.T)
        n = taken[place, seg] - 1
        ids = piece[n, place, seg]
        score[n, place, seg] = _NONE
        second = np.full(k, _NONE)
        for n in range(longest):
            second = np.maximum(second, (fwd[: m - n] + score[n, : m - n] + bwd[n + 1 :]).max(0))
        counts = np.bincount(seg, minlength=k)
        odd = np.flatnonzero(ids < 0)
        if len(odd):  # characters that no piece has become their bytes
            real = [chr(c) for c in flat[(np.cumsum(length) - length)[seg[odd]] + place[odd]].tolist()]
            spelled = [[self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] for c in real]
            width = np.ones(len(ids), np.int64)
            width[odd] = list(map(len, spelled))
            counts = np.bincount(seg, weights=width, minlength=k).astype(np.int64)
            starts = (np.cumsum(width) - width)[odd]
            ids = np.repeat(ids, width)
            for s, x in zip(starts.tolist(), spelled, strict=True):
                ids[s : s + len(x)] = x
        return best, best - second, counts, ids

    def _lattice(self, segment: str) -> tuple[list[list[tuple[int, float, int]]], list[float]]:
        """The arcs that end at each place of one segment, as (start, score, piece; -1 for bytes), longest first, and the best score up to each place."""
        codes = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.where(codes == 0x20, ord(SPACE), np.where(codes == ord(SPACE), 0, codes))
        m = len(codes)
        arcs: list[list[tuple[int, float, int]]] = [[] for _ in range(m + 1)]
        start, node = np.arange(m), np.zeros(m, np.int32)
        by_length = []
        for n in range(min(self.longest, m)):
            here = start + n < m
            start, node = start[here], node[here]
            node = self._step(node, codes[start + n])
            start, node = start[node > 0], node[node > 0]
            if not len(start):
                break
            ends = self.piece[node] >= 0
            by_length.append((n + 1, start[ends], self.piece[node[ends]]))
        whole = np.zeros(m, bool)
        for n, start, piece in reversed(by_length):
            if n == 1:
                whole[start] = True
            for a, i, x in zip(start.tolist(), piece.tolist(), self.score[piece].tolist(), strict=True):
                arcs[a + n].append((a, x, i))
        for a in np.flatnonzero(~whole).tolist():
            arcs[a + 1].append((a, self.unknown, -1))
        fwd = [0.0] + [_NONE] * m
        for end in range(1, m + 1):
            fwd[end] = max([fwd[a] + x for a, x, _ in arcs[end]])
        return arcs, fwd

    def _own(self, segment: str, start: int, piece: int) -> tuple[int, ...]:
        return (piece,) if piece >= 0 else tuple(self.byte_ids[b] for b in segment[start].encode("utf-8", "surrogatepass"))

    def nbest_segment(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of one segment, best first; fewer where there aren't as many.

        The forward scores are what the rest of a path costs exactly, so paths leave the queue best first. Of equally good ones
        the one nearest its end goes on, and no place is left by more than n paths, as no more can be among the n
        best: the time is linear in the segment whatever it repeats.
        """
        arcs, fwd = self._lattice(segment)
        m = len(segment)
        found: list[tuple[float, tuple[int, ...]]] = []
        left = [0] * (m + 1)
        tick = 0
        heap: list[tuple] = [(-fwd[m], m, 0, 0.0, None)]
        while heap and len(found) < n:
            cost, at, _, tail, path = heapq.heappop(heap)
            if left[at] >= n:
                continue
            left[at] += 1
            if at == 0:
                ids: list[int] = []
                while path:
                    start, piece, path = path
                    ids += self._own(segment, start, piece)
                found.append((-cost, tuple(ids)))
                continue
            for start, x, piece in arcs[at]:
                if left[start] < n:
                    tick += 1
                    heapq.heappush(heap, (-(fwd[start] + x + tail), start, tick, x + tail, (start, piece, path)))
        return found

    def encode(self, texts: list[str | None], n: int = 1) -> Iterator[tuple[np.ndarray, list[tuple[float, dict[int, tuple[int, ...]]]], np.ndarray]]:
        """For each text: ids of the best segmentation, the n best as (score, {segment: ids instead}), offsets of segments.

        A null text is an empty one, and that has no ids and a score of 0. A text is read with a space before it.
        """
        known: dict[str, int] = {}
        cut = [[known.setdefault(s, len(known)) for s in _CUT.findall(" " + t)] if t else [] for t in texts]
        names = list(known)
        order = sorted(range(len(names)), key=lambda i: len(names[i]))
        score, second, counts = np.empty(len(names)), np.empty(len(names)), np.empty(len(names), np.int64)
        parts: list[np.ndarray] = []
        listed: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
        a = 0
        while a < len(order):
            b = a
            while b < len(order) and (b == a or (b - a + 1) * len(names[order[b]]) <= _CELLS and len(names[order[b]]) <= _LONG):
                b += 1
            pick = order[a:b]
            if len(names[pick[-1]]) > _LONG:
                (i,) = pick
                (best, ids), *others = listed[i] = self.nbest_segment(names[i], max(n, 2))
                score[i], second[i], counts[i] = best, best - others[0][0] if others else np.inf, len(ids)
                parts.append(np.array(ids, np.int32))
            else:
                score[pick], second[pick], counts[pick], ids = self._best([names[i] for i in pick])
                parts.append(ids)
            a = b
        starts = np.empty(len(names), np.int64)
        if order:
            starts[order] = np.cumsum(counts[order]) - counts[order]
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        for segs in cut:
            s = np.array(segs, np.int64)
            c = counts[s]
            offsets = np.cumsum(c) - c
            own = ids[np.repeat(starts[s] - offsets, c) + np.arange(int(c.sum()))]
            top: list[tuple[float, dict[int, tuple[int, ...]]]] = [(float(score[s].sum()), {})]
            if n > 1 and len(s):
                least = np.argpartition(second[s], min(n - 2, len(s) - 1))[: n - 1]
                for place in least[np.argsort(second[s[least]], kind="stable")].tolist():
                    if segs[place] not in listed:
                        listed[segs[place]] = self.nbest_segment(names[segs[place]], n)
                    other = listed[segs[place]]
                    top = heapq.nsmallest(n, ((x + y - other[0][0], {**ch, place: i} if j else ch) for x, ch in top for j, (y, i) in enumerate(other)), key=lambda z: -z[0])
            yield own, top, offsets


def swap(ids: np.ndarray, offsets: np.ndarray, changes: dict[int, tuple[int, ...]]) -> list[int]:
    """The ids of another segmentation: those of the best with some segments' ids replaced."""
    out, at = [], 0
    for seg in sorted(changes):
        end = int(offsets[seg + 1]) if seg + 1 < len(offsets) else len(ids)
        out += ids[at : int(offsets[seg])].tolist() + list(changes[seg])
        at = end
    return out + ids[at:].tolist()


@functools.lru_cache(maxsize=2)
def _loaded(raw: bytes) -> Pieces:
    return Pieces.from_model(raw)


def encode_texts(df: DataFrame, model: str, n: int = 3, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", batch_chars: int = 6_000_000, with_ids: bool = True) -> DataFrame:
    """The key columns, ids (of the best segmentation), n_pieces, score, nbest_scores, nbest_ids_sha256, decoded_sha256.

    The ids are encoded from the whole text and the digest of the decoded text is made from the ids alone, so
    it equals the text's own digest if nothing was lost. nbest_ids_sha256 has a digest of the little-endian
    32-bit ids of each of the n best segmentations. A null text is encoded as an empty one: no ids, score 0,
    one segmentation. Repeated rows stay; key columns are passed on as they are, other columns ignored; an
    empty table gives no rows. with_ids leaves the ids out where only figures are wanted. A task holds up to 2 KB
    for each character of the longest run without spaces. The model file is read by the driver and sent with the tasks.
    """
    ship(df.sparkSession)
    raw = Path(model).read_bytes()
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"{model} has {len(raw)} bytes; {MAX_MODEL_BYTES} are allowed")
    sent = df.sparkSession.sparkContext.broadcast(raw)
    rows = df.select(*[F.col(k) for k in keys], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    added = "ids array<int>, " * with_ids + "n_pieces long, score double, nbest_scores array<double>, nbest_ids_sha256 array<string>, decoded_sha256 string"
    schema = df.sparkSession.createDataFrame([], added).schema
    out = df.select(*keys).schema
    for f in schema.fields:
        out = out.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(sent.value)
        for b in batches:
            texts, at = b.column(len(keys)).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= batch_chars):
                    size += len(texts[end])
                    end += 1
                made: list[tuple] = []
                for ids, top, offsets in own.encode(texts[at:end], n):
                    digests = [hashlib.sha256(np.asarray(swap(ids, offsets, ch) if ch else ids, "<i4").tobytes()).hexdigest() for _, ch in top]
                    back = hashlib.sha256(own.decode(ids.tolist()).encode("utf-8", "surrogatepass")).hexdigest()
                    made.append((*[ids] * with_ids, len(ids), top[0][0], [s for s, _ in top], digests, back))
                cols = list(zip(*made, strict=True))
                types = [*[pa.list_(pa.int32())] * with_ids, pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.string()]
                arrays = [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]
                part = b.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keys))] + arrays, out.names)
                at = end

    return rows.mapInArrow(run, out)
