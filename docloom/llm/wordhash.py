"""64-bit hashes of words and word sequences, for whole batches of texts at once with numpy.

A word's hash is a polynomial over a table of random byte values, taken from prefix sums modulo 2^64
and mixed.  Sequences combine word hashes with odd constants and are mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240611))
_BYTES = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}

#: Bytes of text that are hashed at once (a longer text is hashed alone): about ten arrays of 8 bytes for each.
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, base & ((1 << 64) - 1), dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= CHUNK_BYTES + 1:
            _powers[name] = have
    return have[:n]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """[from, to) ranges of texts with about CHUNK_BYTES together."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if texts:
        yield start, len(texts)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, and the number of words of each text."""
    raw = np.frombuffer(b" ".join([*texts, b""]) if texts else b" ", dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * _power(_BASE, "up", len(raw)), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _power(_INVERSE, "down", len(raw))[start] + (end - start).astype(np.uint64))
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    return hashes, counts


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words (across texts too: callers drop those)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if width <= len(_ODD):
        total = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            total += words[k : k + n] * _ODD[k]
        return mix(total + np.uint64(width))
    raise ValueError(f"width of {width} is over {len(_ODD)}")


def short_sequence(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of one whole sequence of fewer than ``width`` words; no run of another length has it."""
    return windows(words, len(words)) ^ np.uint64(width)
