"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np

from spanforge.llm.hashing import WordHasher, mix

WIDTH = 5
_K = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Words are what ASCII white space parts, with A-Z in lower case.

    A text with fewer words than the width is one shingle, one without words has none.
    """

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.hashes = WordHasher.of_separators(b" \t\n\v\f\r")

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """Hashes of all shingles of each text, in order, with repeats."""
        words, _, sizes = self.hashes(texts)
        rolled = words.copy()
        n = max(0, len(words) - self.width + 1)
        if n:
            rolled = words[:n].copy()
            for k in range(1, self.width):
                rolled = rolled * _K + words[k:k + n]
            rolled = mix(rolled)
        out, at = [], 0
        for size in sizes.tolist():
            if size >= self.width:
                out.append(rolled[at:at + size - self.width + 1])
            elif size:
                h = np.uint64(size)
                with np.errstate(over="ignore"):
                    for w in words[at:at + size]:
                        h = h * _K + w
                out.append(mix(np.array([h], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += size
        return out
