"""Hashes of the words of a text, whole texts in bounded slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: words end at these bytes: space and 0x09-0x0D
SPACES = b" \t\n\x0b\x0c\r"
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, SLICE), base % 2**64, np.uint64)
        steps[0] = 1
        known = _POWERS[base] = np.cumprod(steps)
    return known[:n]


def runs(terms: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of terms[start:end] for each pair, wherever the run lies."""
    total = np.zeros(len(terms) + 1, np.uint64)
    np.cumsum(terms * powers(base, len(terms)), out=total[1:])
    inverse = powers(pow(base, -1, 2**64), len(terms) + 1)
    return (total[ends] - total[starts]) * inverse[starts]


def slices(data: bytes, most: int = SLICE) -> Iterator[bytes]:
    """The text in slices that cut no word; a word longer than `most` stays whole."""
    start = 0
    while len(data) - start > most:
        cut = max(data.rfind(b" ", start, start + most), data.rfind(b"\n", start, start + most))
        if cut <= start:
            after = [p for p in (data.find(b" ", start + most), data.find(b"\n", start + most)) if p >= 0]
            if not after:
                break
            cut = min(after)
        yield data[start:cut]
        start = cut
    yield data[start:]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word, in order."""
    from tidefolio.llm.text import mix64

    out = []
    for part in slices(data):
        a = np.frombuffer(part, np.uint8)
        edge = np.diff(np.concatenate(([True], _IS_SPACE[a], [True])).view(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        out.append(mix64(runs(a.astype(np.uint64) + np.uint64(1), starts, ends, BASE) + (ends - starts).astype(np.uint64)))
    return out[0] if len(out) == 1 else np.concatenate(out)


class WordDigests(dict):
    """128-bit digest of each word met lately."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = xxhash.xxh3_128_digest(word)
        return found

    def of_text(self, data: bytes) -> np.ndarray:
        """Digests of the words in order, as two columns of 64 bits."""
        joined = b"".join(b"".join(map(self.__getitem__, part.split())) for part in slices(data))
        return np.frombuffer(joined, np.uint64).reshape(-1, 2)
