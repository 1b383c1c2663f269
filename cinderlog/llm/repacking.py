"""Sequences filled best fit first, certified by lower bounds and repacked where they are not.

Texts are encoded, closed with an end id, and cut into pieces of at most ``length`` ids; only
longer texts are cut, and their first piece takes what is left over.  Pieces are dealt into
partitions of bounded size, and each partition is packed by decreasing size into the sequence
with the least room that still holds the piece.  Then its count of sequences is held against a
lower bound from dual feasible functions: functions of a piece's size whose sum over the pieces
of any sequence is at most 1, so that their sum over all pieces bounds the sequences needed.

* A partition whose count equals the bound is certified: no packing of it has fewer sequences.
  It keeps them all but for the emptiest, which can still be filled from elsewhere.
* A partition with a gap keeps its full sequences and gives the pieces of all others away.

What was given away is dealt anew, so that partitions exchange texts, and packed again, until
everything fits one partition, or the total equals the bound of all pieces, or a round saves no
sequence (then the sequences before it stand).  Each round has fewer pieces; only sizes travel,
never ids.

Ids are those of the vocabulary's rank file, which are the tokenizer library's for its own file of
the same vocabulary (tests hold them against it): the rank encoder takes a fourth of its time.
Strings of special tokens in a text are ordinary text.

Definitions: a null or empty text is a piece of the end id alone; repeated rows are packed each
on its own; an id may be null; an empty table gives an empty table.  A text's ids are held by one
task.  Only the named columns are read, so further columns can't clash with the results.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.packing import best_fit, encoding
from cinderlog.sources.staging import materialize

LENGTH = 2048
END_ID = 0
#: A partition has about so many ids and pieces at the most, whatever the table's size.
PARTITION_IDS = 1 << 22
PARTITION_PIECES = 1 << 17
#: Parameters of the rounding functions of the lower bound.
ROUNDINGS = range(2, 33)


def cuts(n: int, length: int) -> list[int]:
    """Where the pieces of n ids start; only the first may be shorter than ``length``."""
    return list(range(0, n, length)) if n % length == 0 else [0, *range(n % length, n, length)]


PIECES = "id {kind}, piece int, start long, length int, ids binary, piece_no long"


def token_pieces(
    df: DataFrame, rank_file: str, pattern: str, length: int = LENGTH, end_id: int = END_ID, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids, piece_no): the pieces of all texts; ids are 32-bit little-endian.

    ``piece_no`` tells pieces apart while the table is stored: it has the task and a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = encoding(rank_file, pattern), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, held = [], 0
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(own.encode_to_numpy(value.as_py() or "", disallowed_special=()).astype("<u4"), np.uint32(end_id))
                starts = cuts(len(ids), length)
                for piece, (at, beyond) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((name.as_py(), piece, at, beyond - at, ids[at:beyond].tobytes(), number + len(rows)))
                held += len(ids)
                if held >= PARTITION_IDS:
                    yield _pieces(rows, batch.column(0).type)
                    number, rows, held = number + len(rows), [], 0
            yield _pieces(rows, batch.column(0).type)
            number += len(rows)

    rows = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES.format(kind=rows.schema["id"].dataType.simpleString()))


def _pieces(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])


def lower_bound(counts: np.ndarray, length: int) -> int:
    """Sequences that any packing needs; ``counts[s]`` is the number of pieces of size s, up to ``length``.

    The greatest of three families of dual feasible functions, in whole numbers:
    small pieces are left out and those that only small ones can join count as whole sequences;
    sizes are rounded down to parts of a sequence but for whole multiples of them;
    large pieces count by how many pieces of a size no longer fit beside them.
    """
    sizes = np.arange(length + 1)
    counts = counts.astype(np.int64)
    total = np.concatenate(([0], np.cumsum(counts * sizes)))
    number = np.concatenate(([0], np.cumsum(counts)))
    least = np.arange(0, length // 2 + 1)
    # Sizes from ``least`` to ``length - least`` count as they are, larger ones as a whole sequence.
    middle = total[length - least + 1] - total[least]
    whole = number[length + 1] - number[length - least + 1]
    best = int((middle + length * whole).max())
    bound = -(-best // length)
    for k in ROUNDINGS:
        exact = (k + 1) * sizes % length == 0
        parts = np.where(exact, sizes * k, (k + 1) * sizes // length * length)
        bound = max(bound, -(-int((counts * parts).sum()) // (k * length)))
    present = np.flatnonzero(counts)
    for low in range(1, length // 2 + 1) if len(present) else ():
        fit = length // low
        parts = np.where(2 * present > length, 2 * (fit - (length - present) // low), np.where(2 * present == length, fit, 2 * (present // low)))
        bound = max(bound, -(-int((counts[present] * parts).sum()) // (2 * fit)))
    return bound


SMALL = "id {kind}, piece int, start long, length int, ids_crc32 long, piece_no long"
PLACED = SMALL + ", sequence_id long, offset long, gap int, given boolean"


def _packed(table: pa.Table, length: int, number: int) -> pa.Table:
    """The pieces of one partition with their sequences, and which are given away."""
    table = table.sort_by([("length", "descending"), ("piece_no", "ascending")])
    sizes = table["length"].to_pylist()
    rows = best_fit(sizes, length)
    gap = len(rows) - lower_bound(np.bincount(sizes, minlength=length + 1), length)
    sequence, offset, room = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    rooms = [length - sum(sizes[i] for i in row) for row in rows]
    emptiest = max(range(len(rows)), key=rooms.__getitem__)
    for no, row in enumerate(rows):
        at = 0
        for i in row:
            sequence[i], offset[i] = no, at
            at += sizes[i]
        room[row] = rooms[no]
    given = (room > 0) & ((gap > 0) | (sequence == emptiest))
    for name, value in (("sequence_id", number + sequence), ("offset", offset), ("gap", np.full(len(sizes), gap, np.int32)), ("given", given)):
        table = table.append_column(name, pa.array(value))
    return table.drop_columns(["part"])


def _packer(length: int, first: int):
    """Packs a partition; its sequences' numbers start at ``first`` and its own number."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return _packed(table, length, first + (key[0].as_py() << 24))

    return pack


def _sizes(pieces: DataFrame, length: int) -> np.ndarray:
    """Pieces of each size: at most ``length`` counts."""
    counts = np.zeros(length + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return counts


def place(pieces: DataFrame, length: int = LENGTH, partition_ids: int = PARTITION_IDS, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """(id, piece, start, length, ids_crc32, piece_no, sequence_id, offset, gap) of stored pieces.

    ``gap`` is by how many sequences the piece's last partition was over its lower bound.
    """
    names = [c.split()[0] for c in SMALL.split(", ")]
    pieces = pieces.select(*names)
    out = PLACED.format(kind=pieces.schema["id"].dataType.simpleString())
    counts = _sizes(pieces, length)
    bound, settled, done, given, before, turn = lower_bound(counts, length), 0, [], pieces, None, 0
    while True:
        parts = max(1, -(-int((counts * np.arange(length + 1)).sum()) // partition_ids), -(-int(counts.sum()) // partition_pieces))
        dealt = given.select(*names, F.pmod(F.xxhash64("piece_no", F.lit(turn)), F.lit(parts)).cast("int").alias("part"))
        placed = materialize(dealt.groupBy("part").applyInArrow(_packer(length, turn << 52), out), "placed_pieces")
        # A sequence is counted by the piece at its start.
        opened = placed.where(F.col("offset") == 0).groupBy("given").count().collect()
        made = {r["given"]: r["count"] for r in opened}
        if before is not None and sum(made.values()) >= before[1]:
            done.append(before[0])
            break
        settled += made.get(False, 0)
        given, left = placed.where("given"), made.get(True, 0)
        if parts == 1 or not left or settled + left == bound:
            done.append(placed)
            break
        done.append(placed.where("not given"))
        before, turn = (given, left), turn + 1
        counts = _sizes(given, length)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.drop("given")


def repack(
    df: DataFrame, rank_file: str, pattern: str, length: int = LENGTH, end_id: int = END_ID, key: str = "doc_id", text: str = "text", **limits: int
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, piece_no, sequence_id, offset, gap) for every piece."""
    cut = token_pieces(df, rank_file, pattern, length, end_id, key, text)
    pieces = materialize(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "token_pieces")
    return place(pieces, length, **limits).withColumnRenamed("id", key)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, segment_ends): whole sequences from stored pieces with their ids and their places."""
    rows = pieces.select("piece_no", "ids").join(placed.select("piece_no", "sequence_id", "offset", "length"), "piece_no")
    parts = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    return parts.select("sequence_id", ids.alias("ids"), F.transform("p", lambda p: p["offset"] + p["length"]).alias("segment_ends"))
