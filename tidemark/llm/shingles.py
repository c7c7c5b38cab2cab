"""Hashed word shingles of whole texts, computed with numpy over their bytes."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Words hashed at once: longer texts are taken in slices that overlap by a shingle.
SLICE = 400_000
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Tables:
    up = _powers(_BASE, 1)
    down = _powers(_INVERSE, 1)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up[:n], cls.down[:n]


def _hash_slice(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of the k-word runs of ``words``; of all of them where they are fewer."""
    buf = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _Tables.upto(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:-1], out=sums[1:])
    blanks = np.flatnonzero(buf == 32)
    starts = np.concatenate([[0], blanks + 1])
    ends = np.concatenate([blanks, [len(buf)]])
    n = max(1, len(words) - k + 1)
    s, e = starts[:n], ends[-n:]
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles, A-Z lower-cased.

    Words are runs without space and U+0009-000D. Fewer than k words are one shingle; none
    give an empty array.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= SLICE:
        h = _hash_slice(words, k)
    else:
        h = np.concatenate([_hash_slice(words[i : i + SLICE + k - 1], k) for i in range(0, len(words) - k + 1, SLICE)])
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]
