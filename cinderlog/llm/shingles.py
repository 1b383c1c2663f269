"""Word shingles of whole texts as 64-bit values.

Words are maximal runs of other characters than space, tab, line feed, vertical tab, form
feed and carriage return; A-Z are lower-cased.  UTF-8 bytes are split and lower-cased, as
these rules concern ASCII characters only.
"""

from functools import lru_cache

import numpy as np
from xxhash import xxh3_64_intdigest

MEMO_WORDS = 1 << 19


class WordHashes(dict):
    """64-bit hashes of words, worked out once for each of the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value = xxh3_64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the text's words in order."""
        words = text.encode().lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


@lru_cache(maxsize=8)
def _factors(size: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """One value for each place of ``size`` words; a shorter text is one shingle, an empty one has none."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    places = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        total = np.full(places, size, np.uint64)
        for i, factor in enumerate(_factors(size)):
            total = _mix(total ^ (hashes[i : i + places] * factor))
    return total


def shingle_set(words: WordHashes, text: str | None, size: int) -> np.ndarray:
    """Distinct shingle values, sorted."""
    return np.unique(shingles(words.of(text), size))
