"""Word shingles of whole texts as sorted sets of 64-bit hashes, vectorised over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quire.llm.arrow_groups import pieces, text_bytes

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    """A fixed random value per byte; A-Z share those of a-z."""
    v = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
    v[65:91] = v[97:123]
    return v


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and for each text the number of its first word; words never cross texts."""
    n = len(data)
    word = ~_WHITE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    start[edge] = word[edge]
    end[edge - 1] = word[edge - 1]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_values()[data] * up[:n], out=prefix[1:])
    h = mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64))
    return h, np.searchsorted(a, offsets)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text of the column the sorted distinct hashes of its shingles of `width` words.

    A text of fewer words, but at least one, has the sequence of all its words as one shingle.
    """
    data, offsets = text_bytes(column)
    for i, j in pieces(offsets, CHUNK_BYTES):
        part = offsets[i : j + 1] - offsets[i]
        h, first = word_hashes(data[offsets[i] : offsets[j]], part)
        m = max(len(h) - width + 1, 0)
        s = np.zeros(m, np.uint64)
        for k in range(width):
            s = s * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
        s = mix(s)
        for x in range(j - i):
            a, b = int(first[x]), int(first[x + 1])
            if b - a >= width:
                yield np.unique(s[a : b - width + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for w in h[a:b]:
                    with np.errstate(over="ignore"):
                        whole = whole * np.uint64(0xD6E8FEB86659FD93) + w
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
