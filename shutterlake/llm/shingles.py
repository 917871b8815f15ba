"""Sets of word shingles as sorted 64-bit hashes, and their exact candidate keys."""

from __future__ import annotations

import math

import numpy as np
import xxhash

CACHED_WORDS = 100_000


class WordHashes(dict):
    """Hash of a word, remembered; forgotten when too many words have been seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = values.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sequence_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` word hashes, in order."""
    count = len(words) - width + 1
    total = np.zeros(max(count, 0), dtype=np.uint64)
    for i in range(width if count > 0 else 0):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i:i + count]
    return mixed(total)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles, sorted; all words as one where there are fewer than ``width``."""
    if not len(words):
        return words
    return np.unique(sequence_hashes(words, min(width, len(words))))


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits as two signed numbers; equal sets and only these agree."""
    value = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


class PigeonholeKeys:
    """Keys of which two sets of similarity ``percent`` or more share at least one.

    Sizes fall into classes of the ratio 100 / percent, so similar sets are of the same or neighbouring
    classes. At level L, sets of the classes L - 1 and L meet: they differ in at most D elements, so cut
    into K > D bins by hash range, at least K - D bins agree. A bin's key is the sum of its elements.
    Empty bins are keys only for sets with so many of them that all agreeing bins could be empty.
    A set goes to the levels of its own class and of the next.

    K is larger than it need be by an eighth of D. So up to ``room`` agreeing keys of a set, less one, may
    be left out, for example those that many sets share, and another agreeing one remains.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.ratio = 100 / percent
        self.levels: dict[int, tuple[int, int, np.ndarray]] = {}

    def bins(self, level: int) -> tuple[int, int, np.ndarray]:
        """(bins, bins that agree at least, bin edges)."""
        if level not in self.levels:
            largest = self.ratio ** level + self.ratio ** (level + 1)
            most = int(largest * (100 - self.percent) / (100 + self.percent) + 1e-9)
            count = most + 3 + most // 8
            edges = np.array([(j << 64) // count for j in range(1, count)], dtype=np.uint64)
            self.levels[level] = count, count - most, edges
        return self.levels[level]

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys, and for each its slot: twice the room of its level, plus the level's parity."""
        size_class = int(math.log(len(shingles)) / math.log(self.ratio))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(shingles))])
        keys, slots = [], []
        for level in (size_class, size_class + 1):
            count, agreeing, edges = self.bins(level)
            cuts = np.concatenate([[0], np.searchsorted(shingles, edges), [len(shingles)]])
            filled = cuts[1:] > cuts[:-1]
            tag = np.arange(count, dtype=np.uint64) + np.uint64(level) * np.uint64(1 << 40)
            made = mixed((sums[cuts[1:]] - sums[cuts[:-1]]) ^ mixed(tag))
            empty = count - int(filled.sum())
            keys.append(made if empty >= agreeing else made[filled])
            slots.append(np.full(len(keys[-1]), 2 * max(agreeing - empty, 0) + level % 2, dtype=np.int32))
        return np.concatenate(keys), np.concatenate(slots)
