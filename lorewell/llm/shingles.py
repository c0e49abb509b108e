"""Sets of hashed word shingles, a block of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of the bytes."""
    a = np.frombuffer(data, np.uint8)
    space = _SPACE[a]
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, np.empty(0, np.uint64)
    up, down = _power_tables(len(a))
    total = np.cumsum(_BYTE[a] * up[: len(a)], dtype=np.uint64)
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    return start, mix((total[end - 1] - before) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[str | None], width: int, block: int = 1 << 19) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text: A-Z lower-cased, words of anything but ASCII blanks. A text with fewer than ``width`` words,
    but one at least, has its whole sequence as its one shingle; one without words has none. Texts are hashed in blocks of about ``block`` bytes."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        data = b" ".join(held)
        begin = np.cumsum([0] + [len(x) + 1 for x in held])
        start, h = _word_hashes(data)
        first = np.searchsorted(start, begin)
        if len(h) >= width:
            g = np.zeros(len(h) - width + 1, np.uint64)
            for k in range(width):
                g = mix(g * np.uint64(3) + h[k : len(h) - width + 1 + k])
        for i in range(len(held)):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                yield np.unique(g[a : b - width + 1])
            elif b > a:
                one = np.uint64(b - a)
                for x in h[a:b]:
                    one = mix(np.array([one], np.uint64) * np.uint64(5) + x)[0]
                yield np.array([one], np.uint64)
            else:
                yield np.empty(0, np.uint64)

    for t in texts:
        b = (t or "").encode().lower()
        held.append(b)
        size += len(b)
        if size >= block:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()
