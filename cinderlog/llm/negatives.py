"""Hard negatives for anchors, from full exact scores by lookups in subset-sum tables.

Components become integers, ``floor(scale * x)``; a score is the integer inner product of a row
and an anchor.  Scoring is the Four Russians' way: dimensions are taken eight at a time.  For
every anchor and group of eight, a table has the sums of all 256 subsets of the anchor's eight
components.  Rows are stored as bit planes: a byte has one bit of each of eight components, so
it names the subset whose components have that bit.  One lookup a byte sums a plane; planes are
added with shifts (the highest counts negative, two's complement).  No score is estimated.

Rows are packed once into blocks, anchors into blocks of their own; every anchor block meets
every row block in one cell of a grid (anchors are copied along its columns, row blocks along
its rows), so a task holds a bounded number of blocks and no pair is ever a row.  A cell keeps
for each anchor only what can be in the answer; those few are merged by anchor.  It takes two
rounds: the best rows of the same label, then for each of them the best of the other labels
whose score lies in the window that it sets.

Definitions: a row with a null id, label or vector, or with a null or non-finite component,
takes no part; components are cut to 21 bits (``scale * |x|`` up to 1,048,576), so that scores
of up to 8,192 dimensions are exact; a vector that is shorter than the anchor's counts as filled
up with zeros; of equal scores the smaller id comes first; a row with the anchor's own id is not
another row; repeated rows count, and anchors answer, each on its own; an empty table gives an
empty table.  Only the named columns are read, so further columns can't clash with the results.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.sources.staging import materialize

GROUP = 8
COMPONENT_BITS = 20
#: Rows are scored this many at a time; scores and a row's place in the block share 64 bits.
SLICE = 1 << 10
SLICE_BITS = 10
BLOCK_ROWS = 1 << 12
BLOCK_ANCHORS = 1 << 9
#: Most blocks in a cell of the grid.
CELL_ROW_BLOCKS = 64
CELL_ANCHOR_BLOCKS = 8
#: Less than any key of a score.
NOTHING = np.iinfo(np.int64).min

BLOCK = "block long, ids binary, labels binary, dims int, bits int, data binary"
BLOCK_NAMES = [c.split()[0] for c in BLOCK.split(", ")]
BLOCK_KINDS = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary())


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(bits, groups, rows) bytes of rows of integers; the last plane has the signs."""
    widest = max(int(values.max(initial=0)), -1 - int(values.min(initial=0)))
    padded = np.pad(values, ((0, 0), (0, -values.shape[1] % GROUP)))
    planes = [np.packbits(((padded >> bit) & 1).astype(np.uint8), axis=1, bitorder="little").T for bit in range(widest.bit_length() + 1)]
    return np.ascontiguousarray(np.stack(planes))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): of every anchor and group of eight components, the sum of each subset."""
    padded = np.pad(anchors, ((0, 0), (0, -anchors.shape[1] % GROUP)))
    groups = padded.reshape(len(anchors), padded.shape[1] // GROUP, GROUP).transpose(1, 2, 0)
    table = np.zeros((len(groups), 1 << GROUP, len(anchors)), np.int64)
    for bit in range(GROUP):
        table[:, 1 << bit : 2 << bit] = table[:, : 1 << bit] + groups[:, bit : bit + 1]
    return table


def scores(planes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(rows, anchors): exact inner products, by one lookup for each plane and group."""
    total = np.zeros((planes.shape[2], table.shape[2]), table.dtype)
    found = np.empty_like(total)
    top = len(planes) - 1
    for bit in range(top, -1, -1):
        if bit < top:
            total <<= 1
        for plane, sums in zip(planes[bit], table, strict=False):
            np.take(sums, plane, axis=0, out=found, mode="clip")
            if bit == top:
                total -= found
            else:
                total += found
    return total


class Rows:
    """A block of rows as tasks use it."""

    def __init__(self, row: dict):
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.planes = np.frombuffer(row["data"], np.uint8).reshape(row["bits"], -(-row["dims"] // GROUP), len(self.ids))


class Anchors:
    """A block of anchors with their tables, and the scores of their best rows where these are known."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.table = subset_sums(np.frombuffer(row["data"], np.int64).reshape(len(self.ids), row["dims"]))
        self.best = row.get("best") or []
        self.most = int(np.abs(self.table).max(axis=1).sum(axis=0).max(initial=0))

    def sums(self, bits: int) -> np.ndarray:
        """The table, with 32-bit sums where no partial result of rows of so many bits can pass them."""
        return self.table.astype(np.int32) if self.most << bits < 1 << 31 else self.table


def _keys(score: np.ndarray) -> np.ndarray:
    """(anchors, rows): scores, and below them the rows' places backwards, so that keys are all different."""
    backwards = np.arange(len(score) - 1, -1, -1)
    return (score.T.astype(np.int64) << SLICE_BITS) + backwards


def _first(columns: tuple[np.ndarray, ...], score: np.ndarray, ids: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows of each group of ``columns`` with the highest scores; ties go by id."""
    by_group = np.lexsort((ids, -score, *columns[::-1]))
    columns = [c[by_group] for c in columns]
    changed = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)) if len(by_group) else np.empty(0, bool)
    at = np.arange(len(by_group))
    keep = at - np.maximum.accumulate(np.where(changed, at, 0)) < most
    return [c[keep] for c in (*columns, score[by_group], ids[by_group])]


def _joined(parts: list[tuple[np.ndarray, ...]], width: int) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(width)]


def _slices(block: Rows) -> Iterator[slice]:
    for at in range(0, len(block.ids), SLICE):
        yield slice(at, at + SLICE)


def _same_label(anchors: Anchors, blocks: list[Rows], most: int) -> list[np.ndarray]:
    """(anchor, score, id): the ``most`` best other rows of each anchor's own label."""
    parts = []
    for block in blocks:
        sums = anchors.sums(len(block.planes))
        for label in np.intersect1d(anchors.labels, block.labels):
            own, rows = np.flatnonzero(anchors.labels == label), np.flatnonzero(block.labels == label)
            table = np.ascontiguousarray(sums[:, :, own])
            for at in range(0, len(rows), SLICE):
                part = rows[at : at + SLICE]
                keys = _keys(scores(np.ascontiguousarray(block.planes[:, :, part]), table))
                keys[anchors.ids[own][:, None] == block.ids[part]] = NOTHING
                if len(part) > most:
                    keys = np.partition(keys, len(part) - most, axis=1)[:, len(part) - most :]
                anchor, column = np.nonzero(keys != NOTHING)
                found = keys[anchor, column]
                place = len(part) - 1 - (found & (SLICE - 1))
                parts.append((own[anchor], found >> SLICE_BITS, block.ids[part][place]))
    anchor, score, ids = _joined(parts, 3)
    return _first((anchor,), score, ids, most)


def _other_labels(anchors: Anchors, blocks: list[Rows], most: int, low: int, high: int) -> list[np.ndarray]:
    """(anchor, number of the positive, score, id): the ``most`` best rows in the window that each positive sets."""
    many = max((b["no"] for b in anchors.best), default=0)
    least = np.full((len(anchors.ids), many), 1, np.int64)
    beyond = np.full((len(anchors.ids), many), NOTHING, np.int64)
    for b in anchors.best:
        least[b["anchor"], b["no"] - 1] = -(-low * b["score"] // 100)
        beyond[b["anchor"], b["no"] - 1] = (high * b["score"] // 100 + 1) << SLICE_BITS
    parts = []
    for block in blocks:
        sums = anchors.sums(len(block.planes))
        for part in _slices(block):
            keys = _keys(scores(block.planes[:, :, part], sums))
            keys[anchors.labels[:, None] == block.labels[part]] = NOTHING
            ids, every = block.ids[part], np.arange(len(keys))
            keys.sort(axis=1)
            for no in range(many):
                place = (keys < beyond[:, no : no + 1]).sum(axis=1)
                for back in range(1, most + 1):
                    found = keys[every, np.maximum(place - back, 0)]
                    score = found >> SLICE_BITS
                    fits = (place >= back) & (found != NOTHING) & (score >= least[:, no])
                    anchor = np.flatnonzero(fits)
                    at = len(ids) - 1 - (found[anchor] & (SLICE - 1))
                    parts.append((anchor, np.full(len(anchor), no + 1), score[anchor], ids[at]))
    anchor, no, score, ids = _joined(parts, 4)
    return _first((anchor, no), score, ids, most)


def _blocks(df: DataFrame, rows: int, pack: Callable[[np.ndarray], tuple[int, np.ndarray]]) -> DataFrame:
    """Rows (id, label, vector) as blocks, each of rows of one task; in a block they are in order of id."""

    def block(number: int, part: pa.Table) -> pa.RecordBatch:
        part = part.sort_by([("id", "ascending"), ("label", "ascending")]).combine_chunks()
        vectors = [np.asarray(v.values, np.int64) for v in part["vector"]]
        values = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
        for row, vector in zip(values, vectors, strict=True):
            row[: len(vector)] = vector
        bits, data = pack(values)
        ids, labels = (part[c].to_numpy() for c in ("id", "label"))
        cells = (number, ids.tobytes(), labels.tobytes(), values.shape[1], bits, data.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, BLOCK_KINDS, strict=True)], BLOCK_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while len(held) >= rows:
                yield block(number, held.slice(0, rows))
                number, held = number + 1, held.slice(rows)
        if held is not None and len(held):
            yield block(number, held)

    return df.mapInArrow(run, BLOCK)


def _packed_rows(values: np.ndarray) -> tuple[int, np.ndarray]:
    planes = bit_planes(values)
    return len(planes), planes


def _packed_anchors(values: np.ndarray) -> tuple[int, np.ndarray]:
    return 0, values


def _grid(anchors: DataFrame, rows: DataFrame, answer: Callable[[Anchors, list[Rows]], list[np.ndarray]], names: list[str]) -> DataFrame:
    """What ``answer`` finds for each anchor block among the row blocks of a cell; each meets each in one cell.

    Cells depend on how many blocks there are: at least as many as keep all cores busy, and
    enough that none holds many more blocks than the stated ones.
    """
    n_anchors, n_rows = anchors.count(), rows.count()
    across = max(1, -(-n_anchors // CELL_ANCHOR_BLOCKS))
    cores = anchors.sparkSession.sparkContext.defaultParallelism
    down = max(1, -(-n_rows // CELL_ROW_BLOCKS), min(n_rows, -(-2 * cores // across)))

    def dealt(df: DataFrame, own: str, n: int, other: str, copies: int) -> DataFrame:
        place = F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
        return df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).groupBy("across", "down")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = [Rows(row) for row in right.to_pylist()]
        tables = []
        for row in left.to_pylist() if blocks else ():
            own = Anchors(row)
            found = answer(own, blocks)
            number = np.full(len(found[0]), own.block)
            tables.append(pa.table([number, own.ids[found[0]], *found], ["block", "anchor_id", *names]))
        empty = pa.table([np.empty(0, np.int64)] * (2 + len(names)), ["block", "anchor_id", *names])
        return pa.concat_tables([empty, *tables])

    schema = ", ".join(f"{c} long" for c in ("block", "anchor_id", *names))
    left = dealt(anchors, "across", across, "down", down)
    return left.cogroup(dealt(rows, "down", down, "across", across)).applyInArrow(cell, schema)


def hard_negatives(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; their positives are the ``positives``
    best other rows of their label.  For each, ``negatives`` rows of other labels with the highest
    scores from ``low`` to ``high`` percent of the positive's score, ranked from 1.
    """
    most = F.lit(1 << COMPONENT_BITS)
    whole = F.transform("v", lambda x: F.least(F.greatest(F.floor(x * scale), -most), most - 1).cast("long"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite).select("id", "label", whole.alias("vector"))
    chosen = rows.where(F.col("id") % every == 0)
    parts = max(1, -(-chosen.count() // BLOCK_ANCHORS))
    anchors = materialize(_blocks(chosen.repartition(parts), BLOCK_ANCHORS, _packed_anchors), "anchor_blocks")
    blocks = materialize(_blocks(rows, BLOCK_ROWS, _packed_rows), "row_blocks")

    same = _grid(anchors, blocks, lambda own, part: _same_label(own, part, positives), ["anchor", "score", "id"])
    order = Window.partitionBy("block", "anchor").orderBy(F.desc("score"), "id")
    best = same.withColumn("no", F.row_number().over(order)).where(F.col("no") <= positives)
    best = materialize(best, "positives")
    windows = best.groupBy("block").agg(F.collect_list(F.struct("anchor", "no", "score")).alias("best"))
    asked = materialize(anchors.join(windows, "block"), "anchor_windows")

    other = _grid(asked, blocks, lambda own, part: _other_labels(own, part, negatives, low, high), ["anchor", "no", "score", "id"])
    order = Window.partitionBy("block", "anchor", "no").orderBy(F.desc("score"), "id")
    found = other.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    found = found.select("block", "anchor", F.col("no").cast("int").alias("no"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    best = best.select("block", "anchor", "no", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(best, ["block", "anchor", "no"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
