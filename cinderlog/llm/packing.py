"""Token-id rows of one length, packed best fit first.

Texts are encoded, closed with an end id, and cut losslessly into pieces of at most ``length``
ids.  Pieces are packed by decreasing length, each into the row with the least room that
still holds it; a segment tree over room sizes finds that row.  Packing works inside a task,
on pools of ``POOL_IDS`` ids, so nothing is shuffled and a task's memory is bounded.

A row has its ids, padded to ``length``; the positions, which start again at 0 with every
segment; the cumulative segment lengths; and for each segment the text's id and the place in
the text's ids where the piece starts, from which the texts can be put together again.

Definitions: a null or empty text has no ids and is in no row; repeated rows are packed each
on its own; an id may be null; an empty table gives an empty table.  Only the named columns
are read, so further columns can't clash with the results.
"""

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
POOL_IDS = 1 << 22
OUT_ROWS = 512


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoder, one for each worker process; what is packed here are its ids."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class RoomTree:
    """How many rows have each amount of room; finds the least room of at least a size."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.counts[at] += n
            at >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(row, room) of the row with the least room of at least ``size``; it leaves the tree."""
        counts, at = self.counts, self.leaves + size
        if not counts[at]:
            # Up to the first subtree on the right that has a row, then down its left side.
            while at > 1 and (at & 1 or not counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not counts[at]:
                    at += 1
        room = at - self.leaves
        row = self.rows[room].pop()
        self._add(room, -1)
        return row, room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """The pieces of every row, by decreasing size; ties keep their order."""
    tree, rows = RoomTree(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[piece]
        found = tree.take(size)
        if found is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row, room = found
        rows[row].append(piece)
        tree.put(row, room - size)
    return rows


SCHEMA = "n_ids int, input_ids array<int>, position_ids array<int>, segment_ends array<int>, ids array<bigint>, starts array<bigint>"


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    flat = np.concatenate(values) if values and isinstance(values[0], np.ndarray) else [x for v in values for x in v]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _rows(pieces: list[tuple], length: int, pad: int) -> Iterator[pa.RecordBatch]:
    packed = best_fit([len(p[2]) for p in pieces], length)
    for at in range(0, len(packed), OUT_ROWS):
        part = [[pieces[i] for i in row] for row in packed[at : at + OUT_ROWS]]
        ends = [np.cumsum([0] + [len(p[2]) for p in row]).astype(np.int32) for row in part]
        ids, positions = [], []
        for row, end in zip(part, ends, strict=True):
            fill = np.full(length - end[-1], pad, np.int32)
            ids.append(np.concatenate([*(p[2] for p in row), fill]))
            positions.append(np.concatenate([*(np.arange(len(p[2]), dtype=np.int32) for p in row), np.zeros(len(fill), np.int32)]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(end[-1]) for end in ends], pa.int32()),
                _lists(ids, pa.int32()),
                _lists(positions, pa.int32()),
                _lists(ends, pa.int32()),
                _lists([[p[0] for p in row] for row in part], pa.int64()),
                _lists([[p[1] for p in row] for row in part], pa.int64()),
            ],
            [c.split()[0] for c in SCHEMA.split(", ")],
        )


def pack(df: DataFrame, rank_file: str, pattern: str, end_id: int, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows: n_ids, input_ids, position_ids, segment_ends, ids (of the texts), starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pool, held = encoding(rank_file, pattern), [], 0
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = own.encode_to_numpy(value.as_py() or "", disallowed_special=())
                if not len(ids):
                    continue
                ids = np.append(ids.astype(np.int32), np.int32(end_id))
                pool += [(name.as_py(), at, ids[at : at + length]) for at in range(0, len(ids), length)]
                held += len(ids)
                if held >= POOL_IDS:
                    yield from _rows(pool, length, end_id)
                    pool, held = [], 0
        if pool:
            yield from _rows(pool, length, end_id)

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def unpack(packed: DataFrame) -> DataFrame:
    """(id, start, piece): the pieces of packed rows, each without its padding."""
    segment = F.explode(F.arrays_zip("ids", "starts", F.sequence(F.lit(0), F.size("ids") - 1).alias("no"))).alias("s")
    cut = packed.select("input_ids", "segment_ends", segment)
    at, end = F.get("segment_ends", F.col("s.no")), F.get("segment_ends", F.col("s.no") + 1)
    return cut.select(F.col("s.ids").alias("id"), F.col("s.starts").alias("start"), F.slice("input_ids", at + 1, end - at).alias("piece"))


def write_matrices(packed: DataFrame, path: str) -> None:
    """Store the rows with their ids and positions as little-endian bytes, one matrix row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [[x.values.to_numpy().astype(kind).tobytes() for x in batch.column(i)] for i, kind in ((1, "<u4"), (2, "<u4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.binary()) for r in raw), *(batch.column(i) for i in (3, 4, 5))], batch.schema.names)

    schema = SCHEMA.replace("input_ids array<int>", "input_ids binary").replace("position_ids array<int>", "position_ids binary")
    packed.mapInArrow(run, schema).write.parquet(path)
