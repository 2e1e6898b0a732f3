"""Hashes of words and character runs, computed for a whole batch of text at once with numpy."""

from __future__ import annotations

import numpy as np

_STEP = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


_held: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and step**-i modulo 2**64, for i below n. The longest made so far is kept for the next call."""
    if not _held or len(_held[0][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, _STEP, np.uint64), np.full(size, pow(_STEP, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _held[:] = [(np.cumprod(up, out=up), np.cumprod(down, out=down))]
    up, down = _held[0]
    return up[:n], down[:n]


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h ^ np.uint64((salt * 0xD6E8FEB86659FD93) & _MASK)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Runs:
    """Hashes of any runs of a sequence of numbers, in constant time for each run."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of code points, a line feed after each, and where each text begins (and the end)."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return points, begins


def letters(points: np.ndarray) -> np.ndarray:
    """Which code points count as parts of words: letters of any script, as far as one comparison tells (ASCII letters, all from U+00AA on but general punctuation)."""
    low = points | 32
    return ((low >= 97) & (low <= 122)) | ((points >= 0xAA) & ((points < 0x2000) | (points > 0x206F)) & ~np.isin(points, (0xAB, 0xBB, 0xB7, 0xBF, 0xD7, 0xF7)))
