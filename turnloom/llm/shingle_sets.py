"""Word-shingle sets of texts as sorted 64-bit hashes, by numpy over Arrow batches.

Words are runs of bytes outside GAP after A-Z are lower-cased; a word's hash is a polynomial over its bytes
with mixing, a shingle's a mix of its words' hashes in order. A text with fewer than k words and at
least one is one shingle; a text without words has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
CHUNK = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _U((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[0] = _U(1)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Shingler:
    def __init__(self, k: int):
        self.k = k
        byte = np.arange(256, dtype=_U)
        byte[65:91] += _U(32)
        self.value = mix(byte, 1)
        self.gap = np.zeros(256, bool)
        self.gap[[32, 9, 10, 11, 12, 13]] = True
        self.up = self.down = np.ones(1, _U)

    def _chunk(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if len(self.up) <= len(data):
            self.up, self.down = _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
        gap = self.gap[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap))))
        start, stop = edge[0::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, _U), np.cumsum(self.value[data] * self.up[: len(data)], dtype=_U)))
            words = mix((sums[stop] - sums[start]) * self.down[start] + mix((stop - start).astype(_U), 2), 3)
            many = words.copy()
            for j in range(1, min(self.k, len(words))):
                many[: len(words) - j] = mix(many[: len(words) - j] * _U(3) + words[j:], 4)
        ends = np.cumsum([len(t) + 1 for t in texts])
        first = np.searchsorted(start, np.concatenate(([0], ends[:-1])))
        last = np.searchsorted(start, ends)
        for i, j in zip(first.tolist(), last.tolist()):
            if j - i >= self.k:
                yield np.unique(many[i : j - self.k + 1])
            elif j > i:
                short = _U(j - i)
                with np.errstate(over="ignore"):
                    for w in words[i:j]:
                        short = mix(np.array([short * _U(3) + w]), 5)[0]
                yield np.array([short])
            else:
                yield np.zeros(0, _U)

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text, in order; memory is that of CHUNK bytes or one text."""
        batch: list[bytes] = []
        size = 0
        for t in texts:
            b = (t or "").encode()
            if batch and size + len(b) > CHUNK:
                yield from self._chunk(batch)
                batch, size = [], 0
            batch.append(b)
            size += len(b)
        if batch:
            yield from self._chunk(batch)
