"""Word shingle sets and MinHash signatures of many texts at once, in numpy. Small helper of the near-duplicate operator."""

from __future__ import annotations

import hashlib

import numpy as np

MASK = (1 << 64) - 1
_draw = np.random.Generator(np.random.PCG64(20240229))
BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64)
POWER = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(POWER), -1, 1 << 64))
FACTORS = _draw.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit ids of each text's k-word shingles.

    A-Z are lower-cased; words are [^\\x20\\x09-\\x0D]+. A text with fewer than k words has one shingle, its whole
    sequence; one without words has none. Words are hashed by differences of a running polynomial over the bytes.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    b = LOWER[np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)]
    cuts = np.cumsum([1, *(len(r) + 1 for r in raw)])  # where each text begins
    space = SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    if len(starts) == 0:
        return [np.empty(0, np.uint64) for _ in raw]
    up = np.cumprod(np.full(len(b), POWER, np.uint64))
    down = np.cumprod(np.full(len(b), BACK, np.uint64))
    total = np.cumsum(BYTE[b] * up)
    words = mix((total[ends - 1] - total[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, cuts)
    n = len(words) - k + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        rolled += words[j : j + n] * FACTORS[j]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= k:
            out.append(np.unique(rolled[lo : hi - k + 1]))
        elif hi > lo:
            short = words[lo:hi] * FACTORS[: hi - lo]
            out.append(mix(np.array([int(short.sum(dtype=np.uint64)) ^ int(hi - lo)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> bytes:
    """Equal for equal sets only, but for a chance of 2**-128."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class MinHash:
    """size minima of a set under as many multiply-shift hashes of 32 bits."""

    def __init__(self, size: int):
        draw = np.random.Generator(np.random.PCG64(7))
        self.a = draw.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, size, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray], most: int = 1 << 15) -> np.ndarray:
        """A row per set; all sets must have members. Sets are joined into runs of about most members."""
        out = np.empty((len(sets), len(self.a)), np.uint32)
        i = 0
        while i < len(sets):
            j, n = i, 0
            while j < len(sets) and (j == i or n + len(sets[j]) <= most):
                n += len(sets[j])
                j += 1
            x = np.concatenate(sets[i:j])
            at = np.cumsum([0, *map(len, sets[i : j - 1])])
            for k, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
                out[i:j, k] = np.minimum.reduceat(x * a + b, at) >> np.uint64(32)
            i = j
        return out
