"""Sets of word shingles as sorted arrays of 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_RANDOM = np.random.default_rng(20240607)
#: A random number for each byte; A-Z have those of a-z. Zero marks white space.
CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
CODES[65:91] = CODES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
STEPS = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (in place)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word in the bytes ``data``, A-Z as a-z."""
    space = SPACE[data]
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    # A word's hash: the sum of its byte codes times powers of an odd base, from its start on.
    order = np.cumsum(~space & before) - 1
    place = np.arange(len(data)) - starts[np.maximum(order, 0)]
    place[space] = 0
    values = CODES[data]
    values[space] = 0
    longest = int(place.max()) + 1
    power = np.cumprod(np.full(longest, BASE, np.uint64))
    return mixed(np.add.reduceat(values * power[place], starts)), starts


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; a shorter text is one shingle of all its words,
    one without words has none."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    words, starts = word_hashes(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, ends).tolist()
    n = len(words) - SHINGLE + 1
    joined = np.zeros(max(n, 0), np.uint64)
    for j in range(SHINGLE if n > 0 else 0):
        joined += words[j : j + n] * STEPS[j]
    joined = mixed(joined)
    found, first = [], 0
    for end in cuts:
        if end - first >= SHINGLE:
            found.append(np.unique(joined[first : end - SHINGLE + 1]))
        elif end > first:
            short = words[first:end] * STEPS[: end - first] + np.uint64(end - first)
            found.append(mixed(short.sum(keepdims=True, dtype=np.uint64)))
        else:
            found.append(np.empty(0, np.uint64))
        first = end
    return found


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
