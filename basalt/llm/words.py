"""Words and shingles of many texts at once, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_P = np.uint64(0x9E3779B97F4A7C15)
_MEMO_WORDS = 200_000


class _Memo(dict):
    """Hashes of words already met; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_memo = _Memo()


def split(text: str | None, delete: bytes = b"") -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased, cut at ASCII white space; `delete` are bytes to leave out."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").lower().translate(None, delete).split()


def hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any of their bits can be used."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` words; the run that starts at word i is at place i."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out *= _P
        out += h[k : k + n]
    return mix(out)


def whole_or_shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles; the whole sequence as one where it is shorter; none without words. Sorted."""
    if 0 < len(h) < width:
        return shingles(h, len(h)) ^ np.uint64(len(h))
    return np.unique(shingles(h, width))
