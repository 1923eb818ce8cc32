"""Golomb-Rice codes of sorted distinct integers.

The gaps are cut into a quotient in unary and a remainder of a fixed number of
bits.  Quotients and remainders go into two streams, so that both directions are
plain array work: the quotients are the distances between the ones of a bitmap.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBI")


def encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned integers below 2^63, as bytes."""
    n = len(values)
    if n == 0:
        return _HEAD.pack(0, 0, 0, 0)
    values = values.astype(np.uint64)
    gaps = np.diff(values)
    mean = int(gaps.mean()) if n > 1 else 0
    k = max(0, mean.bit_length() - 1)
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    ones = np.zeros(int(ends[-1]) if n > 1 else 0, dtype=np.uint8)
    ones[ends - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    unary = np.packbits(ones).tobytes()
    return _HEAD.pack(n, int(values[0]), k, len(unary)) + unary + np.packbits(low).tobytes()


def decode(data: bytes) -> np.ndarray:
    n, first, k, size = _HEAD.unpack_from(data)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    body = np.frombuffer(data, dtype=np.uint8, offset=_HEAD.size)
    ends = np.flatnonzero(np.unpackbits(body[:size]))[: n - 1]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k and n > 1:
        low = np.unpackbits(body[size:], count=(n - 1) * k).reshape(n - 1, k).astype(np.uint64)
        gaps += (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.concatenate([[np.uint64(first)], np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)])
