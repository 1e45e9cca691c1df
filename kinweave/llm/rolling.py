"""Hashes of all words, word windows and byte windows of texts, without a loop over them, and winnowing.

A polynomial hash of any stretch is a difference of two prefix sums times a power of the inverse of an odd base, all modulo
2**64; each byte first becomes a random word, and the result is mixed. Two seeds give 128 bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Powers:
    """Powers of an odd base and of its inverse, grown as needed up to the longest text."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while self.up.size < n:
            k = self.up.size
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


class Hasher:
    def __init__(self, seed: int):
        make = np.random.default_rng(seed)
        self.table = make.integers(0, 1 << 64, 256, dtype=U)
        bases = [int(x) | 5 for x in make.integers(0, 1 << 63, 2, dtype=U)]
        self.bytes_, self.words_ = Powers(bases[0]), Powers(bases[1])

    def stretches(self, values: np.ndarray, starts: np.ndarray, stops: np.ndarray, powers: Powers) -> np.ndarray:
        up, down = powers.get(values.size + 1)
        sums = np.zeros(values.size + 1, U)
        np.cumsum(values * up[:-1], out=sums[1:])
        return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U))

    def words(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return self.stretches(self.table[data], starts, stops, self.bytes_)

    def runs(self, values: np.ndarray, length: int, powers: Powers) -> np.ndarray:
        """Hash of each stretch of `length` neighbouring values."""
        at = np.arange(max(0, values.size - length + 1))
        return self.stretches(values, at, at + length, powers)

    def windows(self, word_hashes: np.ndarray, length: int) -> np.ndarray:
        return self.runs(word_hashes, length, self.words_)

    def byte_windows(self, data: np.ndarray, length: int) -> np.ndarray:
        return self.runs(self.table[data], length, self.bytes_)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words of a text's bytes."""
    inside = np.zeros(data.size + 2, np.int8)
    inside[1:-1] = ~_BLANK[data]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


PLACES = 20


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` neighbours the place of its least value by its upper bits, the leftmost of equals."""
    n = h.size - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    step = (1 << PLACES) - width
    if n > step:
        return np.concatenate([least_in_windows(h[i : i + step + width - 1], width) + i for i in range(0, n, step)])
    keyed = (h & ~U((1 << PLACES) - 1)) | np.arange(h.size, dtype=U)
    # The least of a window is that of the tail of one block of `width` and the head of the next.
    blocks = np.full(-(-h.size // width) * width, np.iinfo(U).max, U)
    blocks[: h.size] = keyed
    blocks = blocks.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tail[:n], head[width - 1 : width - 1 + n]) & U((1 << PLACES) - 1)).astype(np.int64)


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of `size` places lie in a stretch of `length` from one of the starts."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, size), -1)
    return np.cumsum(change[:-1]) > 0
