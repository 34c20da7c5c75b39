"""Sets of word shingles as sorted arrays of 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
_M = np.uint64(0x9E3779B97F4A7C15)  # steps of the counter-based generator below


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random(n: int, seed: int) -> np.ndarray:
    return _mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _M)


_BYTE = _random(256, 1)
_BASE = np.uint64(_random(1, 2)[0] & ~np.uint64(3) | np.uint64(3))
_PLACE = _random(WIDTH, 3) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts in order, and the first word of each text (one more at the end)."""
    joined = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[joined]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    # Text k begins at byte 1 + the lengths of those before it and their separators.
    begins = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    firsts = np.searchsorted(starts, begins)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), firsts
    lengths = ends - starts
    power = np.cumprod(np.full(int(lengths.max()), _BASE, dtype=np.uint64))
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
    values = _BYTE[joined[~space]] * power[inside]
    return _mix(np.add.reduceat(values, offsets) + lengths.astype(np.uint64)), firsts


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes (int64) of its 5-word shingles; one for 1 to 4 words, none without words."""
    words, firsts = word_hashes([t.lower() for t in texts])
    n = len(words)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(WIDTH):
        rolled[: max(0, n - k)] += words[k:] * _PLACE[k]
    rolled = _mix(rolled)
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        count = b - a
        if count >= WIDTH:
            found = rolled[a : b - WIDTH + 1]
        elif count:
            found = _mix((words[a:b] * _PLACE[:count]).sum(dtype=np.uint64, keepdims=True) + np.uint64(count))
        else:
            found = rolled[:0]
        yield np.unique(found.view(np.int64))
