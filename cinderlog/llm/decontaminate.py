"""Benchmark decontamination: item-sized windows by SimHash, verified on weighted shingles.

Items are sorted into size classes.  Windows of each class's size move over every text in
steps of a fraction of it, and at its end, and get a 64-bit SimHash over word pairs, from
running sums of bits.  A multi-index finds all items whose fingerprint is within ``RADIUS``
bits: of four 16-bit blocks one must be within a quarter of that, so each block's table
lists the items for every value that near, and the full distance is taken for those only.

Candidates are verified exactly: windows of the item's own size around the place are compared
with the item by the weighted Jaccard similarity of five-word shingles (of all its words for
a shorter item, so such an item is found where its words stand one after the other).  A shingle's weight is
ln(1 + items / items that have it), times how often it occurs.

A text that has no shingle of any item can't reach a threshold above 0 and is left out before
its windows are made.

The benchmark is the query set.  It is taken in blocks of ``BLOCK_ITEMS`` items.  Holders of a
shingle are counted once over all items and stored, so results don't depend on the blocks;
besides its block each task is sent the counts of the block's own shingles.

Definitions: null or word-free texts and items match nothing; a text shorter than a class's
windows is one window if it has at least ``threshold`` of their words; rows without an id are
left out; rows with equal ids are one text; an empty table on either side gives an empty
table.  Only the named columns are read, so further columns can't clash with the results.
"""

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.bpe import Memo
from cinderlog.llm.names import free_name
from cinderlog.llm.shingles import WordHashes, shingles
from cinderlog.sources.staging import materialize

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 15
BLOCKS, BLOCK_BITS = 4, 16
GROWTH = 1.08
STEPS = 12
BLOCK_ITEMS = 2000
BLOCK_WORDS = 16_000
#: High bits of a shingle by which most shingles of no item are told at once.
MARK_BITS = 20


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _sums(words: np.ndarray, longest: int) -> np.ndarray:
    """Running sums of the bits of word pairs; a row for each place before a pair.

    Sums may wrap around: differences over at most ``longest`` pairs are still right.
    """
    pairs = shingles(words, 2) if len(words) > 1 else words
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if longest < 1 << 8 * k().nbytes)
    sums = np.zeros((len(pairs) + 1, 64), kind)
    np.cumsum(_bits(pairs), axis=0, dtype=kind, out=sums[1:])
    return sums


def _fingerprints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of the windows [start, end) of words; a window of n words has n - 1 pairs."""
    pairs = np.maximum(ends - starts - 1, 1)
    ones = sums[starts + pairs] - sums[starts]
    return np.packbits(ones > pairs[:, None] // 2, axis=1, bitorder="little").view(np.uint64).ravel()


def _near_values(bits: int, radius: int) -> np.ndarray:
    values = np.arange(1 << bits)
    return values[np.bitwise_count(values) <= radius]


class SizeClass:
    """Items of about one size, with the tables of their fingerprints' blocks."""

    def __init__(self, size: int, items: list[int], fingerprints: np.ndarray, radius: int):
        self.size, self.items, self.fingerprints, self.radius = size, items, fingerprints, radius
        near = _near_values(BLOCK_BITS, radius // BLOCKS)
        # A bit for each item; narrow marks keep the tables of small classes in the processor's cache.
        self.kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if k is np.uint64 or len(items) <= 8 * k().nbytes)
        self.bits = 8 * self.kind().nbytes
        self.tables = np.zeros((-(-len(items) // self.bits), BLOCKS, 1 << BLOCK_BITS), self.kind)
        for i, value in enumerate(fingerprints):
            for b in range(BLOCKS):
                part = int(value) >> (b * BLOCK_BITS) & ((1 << BLOCK_BITS) - 1)
                self.tables[i // self.bits, b, near ^ part] |= self.kind(1 << i % self.bits)

    def near(self, found: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, places of fingerprints within the radius of its own)."""
        parts = np.ascontiguousarray(found, "<u8").view("<u2").reshape(-1, BLOCKS).T.astype(np.int64)
        for w, table in enumerate(self.tables):
            marked = table[0][parts[0]]
            for b in range(1, BLOCKS):
                marked |= table[b][parts[b]]
            some = np.flatnonzero(marked)
            marks = marked[some]
            for i in range(w * self.bits, min(len(self.items), (w + 1) * self.bits)):
                at = some[(marks & self.kind(1 << i % self.bits)) != 0]
                at = at[np.bitwise_count(found[at] ^ self.fingerprints[i]) <= self.radius]
                if len(at):
                    yield self.items[i], at


class Index:
    """A block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[int, int], total: int, threshold: float, radius: int):
        self.hashes, self.threshold = WordHashes(), threshold
        self.usual = log(1 + total)
        self.shared = {s: log(1 + total / n) for s, n in frequency.items()}
        self.ids, self.words, self.bags, self.weights = [], [], [], []
        for key, text in items:
            words = self.hashes.of(text)
            if len(words):
                bag = Counter(shingles(words, SHINGLE).tolist())
                self.ids.append(key), self.words.append(words), self.bags.append(bag)
                self.weights.append(sum(self.weight(s) * n for s, n in bag.items()))
        groups: dict[int, list[int]] = {}
        for i, words in enumerate(self.words):
            groups.setdefault(round(log(len(words)) / log(GROWTH)), []).append(i)
        self.classes = []
        for step in sorted(groups):
            members = groups[step]
            sizes = sorted(len(self.words[i]) for i in members)
            prints = [_fingerprints(_sums(self.words[i], len(self.words[i])), np.array([0]), np.array([len(self.words[i])]))[0] for i in members]
            self.classes.append(SizeClass(sizes[len(sizes) // 2], members, np.array(prints, np.uint64), radius))
        self.longest = max((len(w) for w in self.words), default=0)
        self.widths = sorted({min(SHINGLE, len(w)) for w in self.words})
        self.any = np.array(sorted({s for bag in self.bags for s in bag}), np.uint64)
        self.marked = np.zeros(1 << MARK_BITS, bool)
        self.marked[self.any >> np.uint64(64 - MARK_BITS)] = True

    def touches(self, words: np.ndarray) -> bool:
        """Whether a text has a shingle of some item."""
        for width in self.widths:
            own = shingles(words, width)
            own = own[self.marked[own >> np.uint64(64 - MARK_BITS)]]
            if len(own) and np.isin(own, self.any).any():
                return True
        return False

    def weight(self, shingle: int) -> float:
        return self.shared.get(shingle, self.usual)

    def similarity(self, item: int, words: np.ndarray, start: int, slack: int, values: list[int] | None = None) -> tuple[float, int]:
        """Best weighted similarity of an item-sized window that starts within ``slack`` of a place, and its start.

        ``values`` are the text's shingles, if they are known.
        """
        size, bag = len(self.words[item]), self.bags[item]
        low, high = max(0, start - slack), min(len(words), start + slack + size)
        width = min(SHINGLE, size)
        if values is None or width < SHINGLE or high - low < SHINGLE:
            values = shingles(words[low:high], width).tolist()
        else:
            values = values[low : high - SHINGLE + 1]
        if bag.keys().isdisjoint(values):
            return 0.0, start
        places = max(size - SHINGLE + 1, 1)
        best = (0.0, start)
        for first in range(max(len(values) - places, 0) + 1):
            window = Counter(values[first : first + places])
            shared = sum(self.weight(s) * min(n, bag[s]) for s, n in window.items() if s in bag)
            whole = self.weights[item] + sum(self.weight(s) * n for s, n in window.items()) - shared
            best = max(best, (shared / whole, low + first), key=lambda x: (x[0], -x[1]))
        return best

    def matches(self, texts: list[np.ndarray]) -> dict[tuple[int, int], tuple[float, int]]:
        """(text, item): best similarity of at least the threshold, and the window's first word."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        nothing = np.zeros(0, np.uint64)
        texts = [words if self.touches(words) else nothing for words in texts]
        known = Memo(lambda text: shingles(texts[text], SHINGLE).tolist(), 64)
        align = max((step_of(cls.size) for cls in self.classes), default=1)
        for block in _blocks(texts, self.longest, align):
            sums = _sums(block.words, self.longest)
            for cls in self.classes:
                starts, found = block.windows(sums, cls.size, step_of(cls.size), self.threshold)
                for item, at in cls.near(found):
                    slack = step_of(cls.size) + abs(cls.size - len(self.words[item]))
                    for k in at.tolist():
                        part = block.part[starts[k]]
                        text = block.owners[part]
                        place = int(starts[k] - block.firsts[part] + block.offsets[part])
                        if best.get((text, item), (0.0, 0))[0] >= 1 and place - slack >= best[text, item][1]:
                            continue
                        value, first = self.similarity(item, texts[text], place, slack, known[text])
                        if value >= self.threshold and (value, -first) > (lambda b: (b[0], -b[1]))(best.get((text, item), (0.0, 0))):
                            best[text, item] = (value, first)
        return best


def step_of(size: int) -> int:
    """Words between the starts of two windows: a power of two, at most the ``STEPS``th part of the size."""
    return 1 << max(size // STEPS, 1).bit_length() - 1


class Block:
    """Short texts, or a part of a long one, side by side; each starts where every class has a window."""

    def __init__(self, parts: list[np.ndarray], owners: list[int], offsets: list[int], align: int):
        lengths = np.array([len(p) for p in parts])
        padded = -(-lengths // align) * align
        self.owners, self.offsets, self.lengths = owners, offsets, lengths
        self.firsts = np.cumsum(padded) - padded
        self.words = np.zeros(int(padded.sum()), np.uint64)
        for first, words in zip(self.firsts, parts, strict=True):
            self.words[first : first + len(words)] = words
        self.part = np.repeat(np.arange(len(parts)), padded)
        self.room = np.repeat(self.firsts + lengths, padded) - np.arange(len(self.words))

    def windows(self, sums: np.ndarray, size: int, step: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Starts and fingerprints of a class's windows: every ``step`` words, at each text's end, and whole short texts.

        Those on the grid come from whole slices of the running sums; the ones that would
        reach into the next text are left out afterwards.
        """
        pairs = max(size - 1, 1)
        if size == 1:
            starts = np.flatnonzero(self.room >= 1)
            return starts, self.words[starts]
        before, after = sums[: max(len(sums) - pairs, 0) : step], sums[pairs::step]
        found = np.packbits(after - before > pairs // 2, axis=1, bitorder="little").view(np.uint64).ravel()
        inside = np.flatnonzero(self.room[: len(found) * step : step] >= size)
        ends = self.firsts + self.lengths
        last = np.flatnonzero((self.lengths >= size) & ((self.lengths - size) % step > 0))
        short = np.flatnonzero((self.lengths < size) & (self.lengths >= threshold * size) & (self.lengths > 1))
        more = np.concatenate((ends[last] - size, self.firsts[short]))
        stops = np.concatenate((ends[last], ends[short]))
        return np.concatenate((inside * step, more)), np.concatenate((found[inside], _fingerprints(sums, more, stops)))


def _blocks(texts: list[np.ndarray], overlap: int, align: int) -> Iterator[Block]:
    """Blocks of about ``BLOCK_WORDS`` words; parts of long texts overlap by the longest item."""
    parts, owners, offsets, held = [], [], [], 0
    size = max(BLOCK_WORDS, 2 * overlap)
    for no, words in enumerate(texts):
        for at in range(0, max(len(words) - overlap, 1), size - overlap):
            part = words[at : at + size]
            if held and held + len(part) > size:
                yield Block(parts, owners, offsets, align)
                parts, owners, offsets, held = [], [], [], 0
            if len(part):
                parts.append(part), owners.append(no), offsets.append(at)
                held += len(part)
    if held:
        yield Block(parts, owners, offsets, align)


SCHEMA = "id long, item_id long, similarity double, first_word long"


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(key, item_id, similarity, first_word): every text and item with a window at or above the threshold."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull())
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("string").alias("words")).where(F.col("item").isNotNull())
    spark = df.sparkSession
    total = items.count()
    found = spark.createDataFrame([], SCHEMA)
    if not total:
        return found.select(F.col("id").alias(key), "item_id", "similarity", "first_word")
    held = materialize(_shingles_of(items), "item-shingles")
    shared = materialize(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-shingles")
    blocks = -(-total // BLOCK_ITEMS)
    for block in range(blocks):
        own = F.pmod(F.xxhash64("item"), F.lit(blocks)) == block
        found = found.unionByName(_block(rows, items.where(own), _counts(held.where(own), shared), total, threshold, radius))
    return (
        found.groupBy("id", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("first"))).alias("best"))
        .select(F.col("id").alias(key), "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.first")).alias("first_word"))
    )


def without_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose text has no passage of the benchmark; rows without an id stay."""
    name = free_name(df, "leaking_id")
    leaking = leaks(df, benchmark, key, text).select(F.col(key).alias(name)).distinct()
    return df.join(leaking, F.col(key).cast("long") == F.col(name), "left_anti")


def _block(rows: DataFrame, chosen: DataFrame, frequency: dict[int, int], total: int, threshold: float, radius: int) -> DataFrame:
    items = [(r["item"], r["words"]) for r in chosen.orderBy("item").collect()]
    sent = rows.sparkSession.sparkContext.broadcast((items, frequency, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*sent.value, threshold, radius)
        for batch in batches:
            texts = [index.hashes.of(x.as_py()) for x in batch.column(1)]
            best = index.matches(texts)
            ids = batch.column(0).to_pylist()
            columns = [[ids[t] for t, _ in best], [index.ids[i] for _, i in best], [v for v, _ in best.values()], [f for _, f in best.values()]]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "item_id", "similarity", "first_word"])

    return rows.mapInArrow(run, SCHEMA)


def _shingles_of(items: DataFrame) -> DataFrame:
    """(item, shingle): the distinct shingles of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.unique(shingles(words.of(text), SHINGLE))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), item, np.int64)), pa.array(own.view(np.int64))], ["item", "shingle"])

    return items.select("item", "words").mapInArrow(run, "item long, shingle long")


def _counts(held: DataFrame, shared: DataFrame) -> dict[int, int]:
    """How many of all items have a shingle, for a block's shingles that several items have; no longer than the block."""
    own = held.select("shingle").distinct().join(shared, "shingle")
    return {r["shingle"] & (1 << 64) - 1: r["n"] for r in own.collect()}
