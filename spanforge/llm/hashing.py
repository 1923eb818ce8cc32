"""Hashes of all words of many texts at once, without a Python object for each word.

A word's hash is a polynomial in its bytes' numbers, modulo 2^64.  All prefixes of a
buffer are summed once; a word is the difference of two sums, shifted back to the start
by the inverse power, and mixed.  Buffers are cut between words, so the powers stay in
the processor's cache and a long text costs no more than many short ones.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """Words are the longest runs of bytes of one kind; kind 0 parts them, and a space must have it."""

    def __init__(self, kinds: np.ndarray, *, fold: bool = True, seed: int = 17):
        numbers = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold:  # A-Z as a-z
            numbers[65:91] = numbers[97:123]
        self.kinds, self.numbers = kinds.astype(np.uint8), np.where(kinds > 0, numbers, np.uint64(0))
        self.powers = self.inverses = np.ones(1, np.uint64)

    @classmethod
    def of_separators(cls, separators: bytes, *, fold: bool = True) -> WordHasher:
        kinds = np.ones(256, np.uint8)
        kinds[list(separators)] = 0
        return cls(kinds, fold=fold)

    def _power(self, size: int) -> None:
        if size > len(self.powers):
            steps = np.full(size, _BASE, np.uint64)
            back = np.full(size, _INVERSE, np.uint64)
            steps[0] = back[0] = 1
            self.powers, self.inverses = np.cumprod(steps), np.cumprod(back)

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, first bytes and kinds of the words of a buffer that begins and ends between words."""
        self._power(len(data))
        kinds = self.kinds[data]
        edges = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        edges = np.concatenate([np.zeros(int(kinds[0] > 0), np.int64), edges, np.full(int(kinds[-1] > 0), len(data))])
        kind = kinds[edges[:-1]]
        word = np.flatnonzero(kind)
        starts, ends = edges[word], edges[word + 1]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.numbers[data] * self.powers[:len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverses[starts]), starts, kind[word]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and kinds of all words of all texts, in order, and how many words each text has."""
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        hashes, places, kinds, at = [], [], [], 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            if end < len(data):  # back to the last separator, or on to the next one
                parted = np.flatnonzero(self.kinds[data[at:end]] == 0)
                if len(parted):
                    end = at + int(parted[-1]) + 1
                else:
                    while end < len(data) and self.kinds[data[end]]:
                        step = self.kinds[data[end:end + PIECE]] == 0
                        end += int(step.argmax()) if step.any() else len(step)
            h, s, k = self._piece(data[at:end])
            hashes.append(h)
            places.append(s + at)
            kinds.append(k)
            at = end
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(len(texts), np.int64)
        limits = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        sizes = np.diff(np.searchsorted(np.concatenate(places), limits), prepend=0)
        return np.concatenate(hashes), np.concatenate(kinds), sizes
