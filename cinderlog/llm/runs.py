"""Runs of words that repeat with a period, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
identical) that has at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods and that no
neighbouring word extends.  Texts of about ``CHUNK_WORDS`` words are searched together, their
words numbered so that no two texts share a number:

1. *Suffix array.*  Words are ranked by prefix doubling; only suffixes that still tie are
   sorted again.  The ranks of every power of two are kept: two stretches of that length are
   equal if their ranks are, which also tells how far two places agree, in either direction.
2. *Internal pattern matching.*  A run of period ``q`` holds a block of ``2**k <= q`` words that
   starts at a multiple of ``2**k`` and stands again ``q`` words on.  The suffixes that start
   with the block are one stretch of the suffix array, and a wavelet tree over it answers which
   of them lies next at or after a word (range successor), so each block asks for the first, the
   second and the last occurrence in the window from ``2**k`` to ``2**(k+1)`` words on.
3. *Candidate periods.*  Occurrences in such a window form an arithmetic progression.  One or
   two give their distances; from three on, block and occurrences lie in stretches whose period
   is the difference, and a longer period must map the start or the end of one stretch to that
   of the other.  So a block has a constant number of candidates, whatever it holds.
4. Each candidate is extended as far as it holds; of equal stretches the least period stays.

Definitions: a null text and one of white space only have no words, no runs and an empty
result; an id may be null; repeated rows are searched each on its own; an empty table gives an
empty table.  A text is searched whole by one task, in memory of some 4 bytes a word for each
doubling of its longest repeat (30 bytes a word at the least).  Only the named columns are read,
so further columns can't clash with the results.
"""

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Blocks start at 8 words: a run of 24 words and a period of up to 8 holds such a block and its next occurrence.
FIRST_LEVEL = 3
CHUNK_WORDS = 1 << 18

Words = list[bytes]


def suffix_ranks(symbols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(levels, order, tied): ranks of the stretches of ``2**k`` symbols, the suffix array, and its places that tie at 8 symbols.

    ``levels[0]`` are the symbols; ``levels[k]`` has for every place the first place in the suffix
    array of those that agree with it on ``2**k`` symbols.  The last level has no ties.
    """
    n = len(symbols)
    levels, order, tied = [symbols.astype(np.int32)], np.arange(n), np.empty(0, np.int64)
    slots, rank, width = np.arange(n), symbols.astype(np.int64), 1
    while len(slots):
        places = order[slots]
        after = np.zeros(len(places), np.int64)
        inside = places + width < n
        after[inside] = rank[places[inside] + width] + 1
        keys = rank[places] * (n + 1) + after
        by_key = np.argsort(keys)
        places, keys = places[by_key], keys[by_key]
        order[slots] = places
        first = np.append(True, keys[1:] != keys[:-1])
        start = np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))
        rank = rank.copy()
        rank[places] = slots[start]
        levels.append(rank.astype(np.int32))
        slots = slots[~(first & np.append(first[1:], True))]
        width *= 2
        if len(levels) == FIRST_LEVEL + 1:
            tied = slots
    return levels, order, tied


def agree_after(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many symbols agree from two places on, the second of which is the later one."""
    n, length = len(levels[0]), np.zeros(len(low), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ranks, at = levels[k], high + length
        same = (at + (1 << k) <= n) & (ranks[low + length] == ranks[np.minimum(at, n - 1)])
        length += same.astype(np.int64) << k
    return length


def agree_before(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many symbols agree before two places, the second of which is the later one."""
    length = np.zeros(len(low), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ranks, at = levels[k], low - length - (1 << k)
        same = (at >= 0) & (ranks[np.maximum(at, 0)] == ranks[np.maximum(high - length - (1 << k), 0)])
        length += same.astype(np.int64) << k
    return length


class WaveletTree:
    """A sequence of numbers; finds by order those in a stretch of it (as a matrix of bits, most significant first)."""

    def __init__(self, values: np.ndarray, most: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        self.most = 1 << max(1, int(most).bit_length())
        for bit in range(self.most.bit_length() - 2, -1, -1):
            ones = (values >> bit) & 1
            zeros = np.concatenate(([0], np.cumsum(1 - ones)))
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate((values[ones == 0], values[ones == 1]))

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the numbers in each stretch are less than a bound."""
        bound = np.minimum(bound, self.most - 1)
        found = np.zeros(len(low), np.int64)
        for bit, zeros, split in self.levels:
            zl, zh = zeros[low], zeros[high]
            one = (bound >> bit) & 1 == 1
            found += np.where(one, zh - zl, 0)
            low, high = np.where(one, low - zl + split, zl), np.where(one, high - zh + split, zh)
        return found

    def pick(self, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth smallest number of each stretch; with :meth:`below` of a bound, the bound's range successor."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros, split in self.levels:
            zl, zh = zeros[low], zeros[high]
            one = nth >= zh - zl
            nth = np.where(one, nth - (zh - zl), nth)
            value += one.astype(np.int64) << bit
            low, high = np.where(one, low - zl + split, zl), np.where(one, high - zh + split, zh)
        return value


def _candidates(levels: list[np.ndarray], order: np.ndarray, tied: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block starts, periods) to be tried, for every size of blocks."""
    suffixes = order[tied]
    tree = WaveletTree(suffixes, len(order))
    for k in range(FIRST_LEVEL, len(levels) - 1):
        size = 1 << k
        blocks = suffixes[suffixes & (size - 1) == 0]
        ranks = levels[k][suffixes]
        low, high = (np.searchsorted(ranks, levels[k][blocks], side) for side in ("left", "right"))
        more = high - low > 1
        blocks, low, high = blocks[more], low[more], high[more]
        windows = [(size, 2 * size)]
        if k == FIRST_LEVEL:
            windows.append((1, size))
        for nearest, beyond in windows:
            before = tree.below(low, high, blocks + nearest)
            count = tree.below(low, high, blocks + beyond) - before
            found = count > 0
            b, lo, hi, before, count = blocks[found], low[found], high[found], before[found], count[found]
            first = tree.pick(lo, hi, before)
            yield b, first - b
            several = count > 1
            b, first, count = b[several], first[several], count[several]
            second = tree.pick(lo[several], hi[several], before[several] + 1)
            yield b[count == 2], (second - b)[count == 2]
            long = count > 2
            b, first, step = b[long], first[long], (second - first)[long]
            starts = [x - agree_before(levels, x, x + step) for x in (b, first)]
            ends = [x + agree_after(levels, x, x + step) for x in (b, first)]
            for period in (starts[1] - starts[0], ends[1] - ends[0]):
                fits = (nearest <= period) & (period < beyond)
                yield b[fits], period[fits]


def find_runs(symbols: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then end."""
    levels, order, tied = suffix_ranks(symbols)
    if not len(tied):
        return np.empty((0, 3), np.int64)
    pairs = list(_candidates(levels, order, tied))
    at, period = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    start = at - agree_before(levels, at, at + period)
    end = at + period + agree_after(levels, at, at + period)
    whole = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, end, period = start[whole], end[whole], period[whole]
    by_place = np.lexsort((period, end, start))
    start, end, period = start[by_place], end[by_place], period[by_place]
    least = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.empty(0, bool)
    return np.stack([start, end - start, period], axis=1)[least]


def _numbered(texts: list[Words]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, where each text starts); equal words of one text have equal numbers, others never."""
    starts = np.cumsum([0] + [len(words) for words in texts])
    symbols, used = np.empty(starts[-1], np.int64), 0
    for words, start in zip(texts, starts, strict=False):
        known = dict.fromkeys(words)
        number = dict(zip(known, range(used, used + len(known)), strict=True))
        symbols[start : start + len(words)] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        used += len(known)
    return symbols, starts


def _kept(words: Words, runs: np.ndarray) -> bytes:
    """The words but those that a run contains after its first period."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, np.cumsum(edges)[:-1] == 0))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _search(ids: list, texts: list[Words], kind: pa.DataType) -> pa.RecordBatch:
    symbols, starts = _numbered(texts)
    runs = find_runs(symbols)
    text = np.searchsorted(starts, runs[:, 0], "right") - 1
    runs[:, 0] -= starts[text]
    # By text, start and period.
    by_text = np.lexsort((runs[:, 2], runs[:, 0], text))
    runs, text = runs[by_text], text[by_text]
    ends = np.searchsorted(text, np.arange(len(texts) + 1), "left")
    collapsed = [_kept(words, runs[ends[i] : ends[i + 1]]) for i, words in enumerate(texts)]
    rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, i])) for i in range(3)], [f.name for f in RUN])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, kind),
            pa.array(np.diff(starts), pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ],
        ["id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    prepare: Callable[[object, Words], Words] | None = None,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """(key, n_words, runs, collapsed) for every row.

    ``runs`` are structs (start, length, period) by start, then period; ``collapsed`` is the text's
    words, joined by single spaces, but for those that a run contains after its first period.
    Words are separated by white space of ASCII.  ``prepare`` is given a row's id and words and
    returns the words to be searched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, ids, texts, held = batch.column(0).type, [], [], 0
            for key_value, value in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                name, words = key_value.as_py(), (value.as_py() or b"").split()
                if prepare is not None:
                    words = prepare(name, words)
                if held and held + len(words) > chunk_words:
                    yield _search(ids, texts, kind)
                    ids, texts, held = [], [], 0
                ids.append(name)
                texts.append(words)
                held += len(words)
            if ids:
                yield _search(ids, texts, kind)

    rows = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    run_type = T.StructType([T.StructField(f.name, T.LongType()) for f in RUN])
    out = T.StructType().add("id", rows.schema["id"].dataType).add("n_words", "long").add("runs", T.ArrayType(run_type)).add("collapsed", "string")
    return rows.mapInArrow(run, out).withColumnRenamed("id", key)
