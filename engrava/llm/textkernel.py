"""Vectorised hashing of character and word windows over batches of texts.

A batch is one long code-point array; window hashes are polynomial in a fixed odd
base modulo 2**64 over randomised symbols, so a window's value does not depend on
where it stands. All functions are pure numpy and run inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = 6364136223846793005
_INVERSE = pow(_BASE, -1, 2**64)
#: Characters handled at once inside one task; bounds a task's memory, not a text's length.
BATCH_CHARS = 120_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(28)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """For each code point, whether it is a letter or a digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def chunks(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``limit`` characters in all."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points, each text followed by a line feed, and where texts start (one more at the end)."""
    data = "\n".join(texts) + "\n"
    points = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return points, starts


class Prefix:
    """Prefix sums of a symbol sequence, from which any window's hash follows in O(1)."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix(symbols + np.uint64(1)) * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        """Hashes of the windows of ``length`` symbols at every start that has room."""
        m = self.n - length + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:m]) * self.down[:m])


def sliding_min(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """``op`` over each window of ``w`` values; len(x) - w + 1 results."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    padded = np.concatenate([x, np.repeat(x[-1:], pad)]).reshape(-1, w)
    ahead = op.accumulate(padded, axis=1).ravel()
    back = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - w + 1], ahead[w - 1 : n])


def anchors(hashes: np.ndarray, w: int) -> np.ndarray:
    """Starts selected by content: the minima of all runs of ``w`` consecutive hashes.

    Every run of ``w`` starts holds one; equal stretches select the same.
    """
    if not len(hashes):
        return np.empty(0, np.int64)
    if len(hashes) <= w:
        return np.flatnonzero(hashes == hashes.min())
    low = sliding_min(hashes, w)
    reach = np.concatenate([np.full(w - 1, low[0]), low, np.full(w - 1, low[-1])])
    return np.flatnonzero(sliding_min(reach, w, np.maximum) == hashes)


class Words:
    """The words of a batch: longest runs of letters and digits of the lower-cased texts."""

    def __init__(self, texts: list[str]):
        points, starts = code_points([t.lower() for t in texts])
        inside = word_characters()[points]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.hash = Prefix(points).of(self.start, self.end)
        self.text = np.searchsorted(starts, self.start, side="right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``n`` words inside one text, and the index of its first word."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.text[:m] == self.text[n - 1 :])
        return Prefix(self.hash).all(n)[at], at
