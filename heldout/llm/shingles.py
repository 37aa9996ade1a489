"""Hashed words and word shingles of texts, in numpy over whole batches of bytes."""
from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
RADIX = 0x9E3779B97F4A7C15              # odd, so powers have inverses modulo 2^64
STEPS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]
CHUNK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(RADIX, -1, 1 << 64)
    out = []
    for r in (RADIX, inverse):
        p = np.full(n, r, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(CHUNK)


def word_hashes(data: list[bytes]) -> list[np.ndarray]:
    """A 64-bit hash of each word of each text: words split at ASCII white space, A-Z lowered.

    The hash of a word is a polynomial of its bytes, taken as a difference of prefix
    sums, then mixed.
    """
    out, i = [], 0
    while i < len(data):
        j, n = i, 0
        while j < len(data) and (j == i or n + len(data[j]) + 1 <= CHUNK):
            n += len(data[j]) + 1
            j += 1
        raw = np.frombuffer(b" ".join(data[i:j]) + b" ", np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, stops = edge[::2], edge[1::2]
        up, down = _usual_powers() if n < CHUNK else _powers(int(n) + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[raw].astype(np.uint64) + U(1)) * up[:n], dtype=np.uint64, out=sums[1:])
        hashes = mixed((sums[stops] - sums[starts]) * down[starts])
        bounds = np.cumsum([len(x) + 1 for x in data[i:j]])
        out += np.split(hashes, np.searchsorted(starts, bounds)[:-1])
        i = j
    return out


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of k words; of the whole run if there are fewer, of none without words."""
    n = min(k, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total = total + words[i:len(words) - n + 1 + i] * U(STEPS[i % len(STEPS)] + 2 * (i // len(STEPS)))
    return np.unique(mixed(total))
