"""Sets of hashed word n-grams of whole texts, vectorised over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SEED = np.random.default_rng(20240817)
#: A random odd-ish value for every byte; A-Z share theirs with a-z.
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _SEED.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_STEP = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _STEP + 4096)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a byte buffer that ends in a blank."""
    blank = _BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(raw) and not blank[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return start, mix((total[end] - total[start]) * down[start])


def shingle_sets(texts: list[str | None], words: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct hashed shingles of each text, in order.

    Words are runs without blanks (space and the control characters 9 to 13),
    letters A-Z in lower case.  A text with fewer than ``words`` words has its
    whole sequence as one shingle; one without words, or null, has none.
    """
    at = 0
    while at < len(texts):
        part, size, to = [], 0, at
        while to < len(texts) and (to == at or size < _STEP):
            raw = (texts[to] or "").encode("utf-8", "surrogatepass") + b" "
            part.append(raw)
            size += len(raw)
            to += 1
        ends = np.cumsum([len(x) for x in part])
        start, h = _words(np.frombuffer(b"".join(part), dtype=np.uint8))
        cut = np.searchsorted(start, ends)  # words of each text
        full = max(0, len(h) - words + 1)
        grams = np.zeros(full, dtype=np.uint64)
        for k in range(words):
            grams += h[k : k + full] * _PLACE[k]
        grams = mix(grams)
        a = 0
        for b in cut.tolist():
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                whole = (h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([whole], dtype=np.uint64))
            else:
                yield np.empty(0, dtype=np.uint64)
            a = b
        at = to


def set_hash(s: np.ndarray) -> int:
    """One signed 64-bit value of a set; equal sets have equal values."""
    if not len(s):
        return 0
    x = int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) ^ (len(s) * _BASE & (2**64 - 1))
    return x - 2**64 if x >= 2**63 else x


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    k = np.searchsorted(b, a)
    k[k == len(b)] = 0
    return int((b[k] == a).sum())
