"""Word and shingle hashes of whole texts, vectorised over a batch of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        _POWERS[:] = [(np.multiply.accumulate(up), np.multiply.accumulate(down))]
    return _POWERS[0]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased; words end at ASCII white space only."""
    blob = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(blob):
        return np.zeros(0, np.uint64)
    inside = np.concatenate([[False], ~SPACE[blob], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(blob) + 1)
    total = np.zeros(len(blob) + 1, np.uint64)
    np.cumsum(_BYTE[blob] * up[: len(blob)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; the whole sequence as one if there are fewer words."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    width = min(SHINGLE, n)
    out = words[: n - width + 1] + np.uint64(width)
    for k in range(1, width):
        out = mixed(out) + words[k : n - width + 1 + k]
    return np.unique(mixed(out))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minhash_family(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, size, dtype=np.uint64)


def minhash(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray], block: int = 2048) -> np.ndarray:
    """Lowest 16 bits of the least hash value per function of the family."""
    a, b = family
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), block):
        values = shingles[i : i + block, None] * a
        values += b
        np.minimum(least, values.min(axis=0), out=least)
    return ((least >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.uint16)


def overlap(one: np.ndarray, two: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(one) > len(two):
        one, two = two, one
    if not len(one):
        return 0
    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
    return int(np.count_nonzero(two[at] == one))


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in integers. Sizes too far apart are not compared."""
    small, large = sorted((len(one), len(two)))
    if not small or 100 * small < percent * large:
        return False
    both = overlap(one, two)
    return 100 * both >= percent * (small + large - both)


def pack(signatures: Sequence[np.ndarray]) -> list[bytes]:
    return [s.tobytes() for s in signatures]
