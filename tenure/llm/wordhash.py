"""Vectorised hashing of the words of many texts at once (NumPy, inside tasks).

Texts are joined into one byte buffer.  Every byte has a random 64-bit value;
the hash of a word is the polynomial sum of its bytes' values, taken as a
difference of prefix sums modulo 2**64 and scaled back by the inverse power,
so it depends on the word's bytes alone and costs a few passes over the buffer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from tenure.llm.common import WHITE

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
U64 = np.uint64


@lru_cache(maxsize=2)
def _byte_values(fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=U64)
    if fold_case:
        values[65:91] = values[97:123]
    white = np.zeros(256, bool)
    white[list(WHITE)] = True
    return values, white


_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        size = max(n, 1 << 21)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, base, U64)
                p[0] = 1
                _POWERS[key] = np.multiply.accumulate(p)
        _POWERS["n"] = size
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a fixed bijection)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(33))


#: Bytes hashed at a time: temporary arrays are a multiple of this, however long a text is.
SEGMENT = 1 << 21


def _hash_segment(buf: np.ndarray, fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of a buffer that ends in white space."""
    values, white = _byte_values(fold_case)
    edge = np.flatnonzero(np.diff(white[buf], prepend=True))  # word starts and ends alternate
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(buf))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(values[buf] * up, dtype=U64)))
        return mix((sums[ends] - sums[starts]) * down[starts]), starts


def hash_words(texts: list[bytes], fold_case: bool = False, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, first word of every text and the total as one more entry)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    white = _byte_values(fold_case)[1]
    hashes, starts, lo = [], [], 0
    while lo < len(buf):
        hi = lo + segment
        while hi < len(buf) and not white[buf[lo:hi]].any():  # one word longer than a segment
            hi += segment
        hi = min(hi, len(buf))
        hi = lo + int(np.flatnonzero(white[buf[lo:hi]])[-1]) + 1  # the last byte of all is white
        h, first = _hash_segment(buf[lo:hi], fold_case)
        hashes.append(h)
        starts.append(first + lo)
        lo = hi
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


def chunks(texts: Iterable, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts in UTF-8) of runs of about ``limit`` bytes; null is empty."""
    first, run, size = 0, [], 0
    for k, t in enumerate(texts):
        b = b"" if t is None else t.encode() if isinstance(t, str) else t
        if run and size + len(b) > limit:
            yield first, run
            first, run, size = k, [], 0
        run.append(b)
        size += len(b) + 1
    if run:
        yield first, run
