"""Near duplicates: banded MinHash candidates, pruned by a sequential Bayesian test, then verified.

Texts with equal shingle sets are one class, so copies are never paired.  Classes that
agree in a band share a bucket.  A bucket never yields all its pairs: its members are
first compared with its hub and its last class only, links are contracted to components,
and just members of buckets that are still in several components are compared further.  Pairs
inside a component can't change the result, so no link between different components is lost.

These last pairs come from an exact set-similarity join, not from the bucket: shingles are
ordered by how many open classes hold them, rarest first, and two classes meet only if they
share one of their first few (prefix filter), with enough of both left from there on (length
and positional filters), in different components and with a band in common.  Copies with edits
of their own have those edits first, so a large group does not meet on what all of it shares.

Shingles that only one class in all buckets has can't be shared with a candidate.  What is
left of two classes bounds their similarity from above, so pairs below the threshold are
left out before they are made; and the hub is the class that has least of its own.  A copy
with many edits has many such shingles, and is compared with few others.

A candidate's sketches are compared batch by batch.  After each batch the pair is dropped
when the posterior chance of a similarity of at least the threshold is below ``MISS``.
Survivors are confirmed on their full shingle sets.  Bands are as long as they may be for a
pair at the threshold to share none with a chance below ``BAND_MISS``.

Definitions: a null or word-free text has no shingles and is linked with nothing; a text
of fewer words than a shingle is one shingle; rows without an id are linked with nothing
and have no component; repeated rows are one class, and rows of one id with different texts
are told apart by their texts; an empty table gives an empty table.
Only the named columns are read, so further columns can't clash with the results.
"""

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.components import connected
from cinderlog.llm.names import free_name
from cinderlog.llm.shingles import WordHashes, shingle_set
from cinderlog.sources.staging import materialize, scratch

SHINGLE = 5
VALUES = 216
BATCH = 24
#: Posterior chance of a link below which a candidate is dropped.
MISS = 1e-9
#: Chance that a pair just at the threshold shares no band.
BAND_MISS = 1e-7
BLOCK = 2048


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    draw = random.integers(0, 1 << 32, (2, VALUES), dtype=np.uint64).astype(np.uint32)
    return draw[0] | np.uint32(1), draw[1] | np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of ``VALUES`` hashes over the shingles."""
    first, second = _multipliers()
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for start in range(0, len(low), BLOCK):
            part = low[start : start + BLOCK], high[start : start + BLOCK]
            for i in range(0, VALUES, BATCH):
                mixed = first[i : i + BATCH, None] * part[0] + second[i : i + BATCH, None] * part[1]
                np.minimum(least[i : i + BATCH], mixed.min(axis=1), out=least[i : i + BATCH])
    return least


def band_rows(threshold: float) -> int:
    """Values in a band: the most with which a pair at the threshold is still found."""
    return max([1, *(r for r in range(1, 33) if (1 - threshold**r) ** (VALUES // r) <= BAND_MISS)])


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    bands = VALUES // rows
    parts = least[: bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for column in parts.T:
            key = (key ^ column) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _describe(band: int):
    """Size, set digest, band keys and sketch of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sizes, digests, keys, sketches = [], [], [], []
            for text in batch.column(2):
                found = shingle_set(words, text.as_py(), SHINGLE)
                sizes.append(len(found))
                if not len(found):
                    digests.append(None), keys.append(None), sketches.append(None)
                    continue
                least = signature(found)
                digests.append(blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(band_keys(least, band))
                sketches.append((least >> np.uint32(11)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["id", "mark", "n", "digest", "keys", "sketch"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle set of every text as sorted 64-bit values."""
    words = WordHashes()
    for batch in batches:
        sets = [shingle_set(words, text.as_py(), SHINGLE).tobytes() for text in batch.column(0)]
        digests = [blake2b(s, digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingle) for every member of every set."""
    for batch in batches:
        for node, packed in zip(batch.column(0), batch.column(1), strict=True):
            shingles = np.frombuffer(packed.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shingles), node.as_py(), np.int64)), pa.array(shingles)], ["node", "shingle"])


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each number of compared batches the matches a pair needs to stay.

    Sketch values are 8 bits of a MinHash, so unequal ones agree by chance once in 256.
    With a uniform prior, the posterior of the match rate after m of n is a beta
    distribution, and its tail is a binomial sum.
    """
    rate = threshold + (1 - threshold) / 256
    needs = []
    for n in range(BATCH, VALUES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * rate**m * (1 - rate) ** (n + 1 - m)
        needs.append(m)
    return needs


def _likely(threshold: float, miss: float):
    needs = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left = np.array([x.as_py() for x in batch.column(2)], f"V{VALUES}").view(np.uint8).reshape(-1, VALUES)
            right = np.array([x.as_py() for x in batch.column(3)], f"V{VALUES}").view(np.uint8).reshape(-1, VALUES)
            alive, matches = np.arange(len(left)), np.zeros(len(left), np.int32)
            for i, need in enumerate(needs):
                part = slice(i * BATCH, (i + 1) * BATCH)
                matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1, dtype=np.int32)
                alive = alive[matches[alive] >= need]
            kept = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["u", "v"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, similarity = [], []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - shared
                keep.append(100 * shared >= percent * union)
                similarity.append(shared / union)
            chosen = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(similarity, pa.float64()).take(chosen)], ["u", "v", "similarity"]
            )

    return run


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows without near duplicates: of each component the text with the smallest id.

    Rows with equal id and text are one: the first by the JSON of their other columns.  An id's
    other texts are judged each on its own.  Rows without an id stay, and so do rows without words.
    """
    own, mark, kept = (free_name(df, name) for name in ("kept_id", "kept_mark", "kept_row"))
    with scratch(df.sparkSession):
        judged = NearDuplicates(df, key, text, percent).components(marked=True).where("kept")
        judged = judged.select(F.col(key).alias(own), F.col("mark").alias(mark)).distinct()
        judged = materialize(judged, "neardup-kept", keep=True)
    rows = df.where(F.col(key).isNotNull()).withColumns({own: F.col(key).cast("long"), mark: _mark(F.col(text))})
    rest = [F.col(c) for c in df.columns if c != text] or [F.lit(0)]
    chosen = rows.join(judged, [own, mark]).groupBy(own, mark).agg(F.min_by(F.struct(*df.columns), F.to_json(F.struct(*rest))).alias(kept))
    return chosen.select(f"{kept}.*").unionByName(df.where(F.col(key).isNull()))


def _mark(text: Column) -> Column:
    """What tells the texts of one id apart."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row, stored; the tables on the way are removed."""
    with scratch(df.sparkSession):
        return materialize(NearDuplicates(df, key, text, percent).components(), "neardup", keep=True)


class NearDuplicates:
    """Classes, buckets and links of a table of texts; every step is stored once."""

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, miss: float = MISS):
        self.percent, self.miss, self.key = percent, miss, key
        rows = df.select(F.col(key).cast("long").alias("id"), _mark(F.col(text)).alias("mark"), F.col(text).cast("string").alias("text"))
        schema = "id long, mark string, n long, digest binary, keys array<bigint>, sketch binary"
        self.described = materialize(rows.mapInArrow(_describe(band_rows(percent / 100)), schema), "neardup-described")
        known = self.described.where((F.col("n") > 0) & F.col("id").isNotNull())
        classes = known.groupBy("digest").agg(F.min("id").alias("first"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch"))
        self.classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "neardup-classes")
        members = self.classes.select("node", F.explode("keys").alias("key"))
        shared = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where(F.col("low") != F.col("high"))
        members = materialize(members.join(shared.select("key"), "key"), "neardup-shared")
        active = members.select("node").distinct().join(self.classes.select("node", "digest", "first"), "node")
        texts = rows.join(active.select(F.col("first").alias("id")).distinct(), "id", "left_semi").select("text")
        sets = texts.mapInArrow(_sets, "digest binary, shingles binary")
        sets = active.select("node", "digest").join(sets, "digest").groupBy("node").agg(F.any_value("shingles").alias("shingles"))
        self.sets = materialize(sets, "neardup-sets")
        own = self.sets.mapInArrow(_places, "node long, shingle long").groupBy("shingle").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
        own = own.where(F.col("n") == 1).groupBy("node").agg(F.count(F.lit(1)).alias("own"))
        sized = self.sets.select("node", (F.octet_length("shingles") / 8).cast("long").alias("n")).join(own, "node", "left")
        sized = sized.select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))
        members = members.join(sized.where(100 * F.col("shared") >= percent * F.col("n")), "node")
        hubs = members.groupBy("key").agg(
            F.min(F.struct((-F.col("shared") / F.col("n")).alias("share"), "node", "n", "shared")).alias("hub"),
            F.max(F.struct("node", "n", "shared")).alias("last"),
            F.count(F.lit(1)).alias("size"),
        )
        self.members = materialize(members.join(hubs.where(F.col("size") > 1), "key"), "neardup-members")

    def _possible(self, n, shared, other_n, other_shared) -> Column:
        """Whether two classes can be links, by their sizes and by how many of their shingles any other one has."""
        most = F.least(shared, other_shared)
        return 100 * most >= self.percent * (n + other_n - most)

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) that are links."""
        sketches = self.classes.select("node", "sketch")
        for end, name in (("u", "left"), ("v", "right")):
            pairs = pairs.join(sketches.select(F.col("node").alias(end), F.col("sketch").alias(name)), end)
        likely = pairs.select("u", "v", "left", "right").mapInArrow(_likely(self.percent / 100, self.miss), "u long, v long")
        likely = materialize(likely, "neardup-likely")
        for end, name in (("u", "left"), ("v", "right")):
            likely = likely.join(self.sets.select(F.col("node").alias(end), F.col("shingles").alias(name)), end)
        links = likely.select("u", "v", "left", "right").mapInArrow(_confirmed(self.percent), "u long, v long, similarity double")
        return materialize(links, "neardup-links")

    def roots(self) -> DataFrame:
        """(node, root) of all classes that are linked with another one."""
        m = F.col
        ends = [
            self.members.where((m("node") != m(f"{e}.node")) & self._possible(m("n"), m("shared"), m(f"{e}.n"), m(f"{e}.shared"))).select(
                F.least("node", f"{e}.node").alias("u"), F.greatest("node", f"{e}.node").alias("v")
            )
            for e in ("hub", "last")
        ]
        near = self._verified(ends[0].unionByName(ends[1]).distinct())
        stars = connected(near)
        placed = self.members.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = (
            placed.groupBy("key")
            .agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max(F.when(F.col("node") == F.col("hub.node"), F.col("root"))).alias("main"))
            .where(F.col("least") != F.col("most"))
            .select("key", "main")
        )
        open_nodes = placed.join(split.select("key"), "key", "left_semi").select("node", "root", "n").distinct()
        rest = self._residual(open_nodes.join(self.classes.select("node", "keys"), "node"))
        links = near.select("u", "v").unionByName(self._verified(rest).select("u", "v"))
        return connected(links)

    def _residual(self, nodes: DataFrame) -> DataFrame:
        """Pairs (u, v) of classes (node, root, n, keys) in different components that can be links.

        A pair's first shared shingle, rarest first, is at places with enough shingles from there on
        in both sets.  For the smaller set these are its first few (a partner is no smaller), for the
        larger one about twice as many.
        """
        nodes = materialize(nodes, "neardup-open")
        p = self.percent
        places = self.sets.join(nodes.select("node"), "node", "left_semi").mapInArrow(_places, "node long, shingle long")
        places = materialize(places, "neardup-places")
        held = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
        inside = places.join(held, "shingle")
        sizes = inside.groupBy("node").agg(F.count(F.lit(1)).alias("common"))
        ordered = Window.partitionBy("node").orderBy("holders", "shingle")
        # Shingles that no other open class has come first; only their number matters.
        first = inside.withColumn("nth", F.row_number().over(ordered)).join(sizes, "node").join(nodes, "node")
        first = first.withColumn("at", F.col("n") - F.col("common") + F.col("nth") - 1).where(100 * F.col("at") <= (100 - p) * F.col("n"))
        first = materialize(first.select("shingle", "node", "root", "n", "at", "keys"), "neardup-prefixes")
        small = first.where((100 + p) * F.col("at") <= (100 - p) * F.col("n"))
        small, large = (side.select("shingle", *[F.col(c).alias(f"{end}_{c}") for c in ("node", "root", "n", "at", "keys")]) for side, end in ((small, "u"), (first, "v")))
        m = F.col
        left = F.least(m("u_n") - m("u_at"), m("v_n") - m("v_at"))
        pairs = small.join(large, "shingle").where(
            ((m("u_n") < m("v_n")) | ((m("u_n") == m("v_n")) & (m("u_node") < m("v_node"))))
            & (m("u_root") != m("v_root"))
            & ((100 + p) * left >= p * (m("u_n") + m("v_n")))
            & F.arrays_overlap("u_keys", "v_keys")
        )
        return pairs.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")).distinct()

    def components(self, marked: bool = False) -> DataFrame:
        """(key, n_shingles, component_id, kept) for every row; ``marked`` adds the mark of its text."""
        roots = self.roots()
        named = self.classes.select("node", "digest", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = named.groupBy("root").agg(F.min("first").alias("component_id"))
        placed = named.join(least, "root").select("digest", "component_id")
        known = F.col("n") > 0
        component = F.when(known, F.col("component_id")).otherwise(F.col("id"))
        rows = self.described.select("id", "mark", "n", "digest").join(placed, "digest", "left")
        return rows.select(
            F.col("id").alias(self.key),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), component).alias("component_id"),
            F.when(F.col("id").isNotNull(), component == F.col("id")).otherwise(False).alias("kept"),
            *([F.col("mark")] if marked else []),
        )
