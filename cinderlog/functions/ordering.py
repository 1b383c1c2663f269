"""Order-dependent operators without a global sort.

A :class:`RowOrder` splits the ordering key in two: ``chunk`` (coarse, a bounded
number of rows per value, e.g. one file split) and ``within`` (exact position
inside the chunk).  Positions come from chunk sizes: sizes are counted with a
map-side combine, summed up over the small table of chunks, and only then joined
back.  No task ever sees more than one chunk of one group, so a group that holds
a third of all rows is spread over its chunks.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions.hashing import digest

CHUNK = "__chunk"
OFFSET = "__offset"
LIMIT = "__limit"
LOCAL = "__local"


@dataclass(frozen=True)
class RowOrder:
    chunk: Column
    within: Column

    def key(self) -> Column:
        return F.struct(self.chunk.alias("chunk"), self.within.alias("within"))


def file_order() -> RowOrder:
    """Line order of scanned text files; a chunk is one input split."""
    return RowOrder(
        F.struct(F.col("file"), F.col("block_start")), F.col("line_in_block")
    )


def numbered_order(rows_per_chunk: int = 1 << 20) -> RowOrder:
    """Line order of files whose lines are numbered; a chunk is a stretch of one file, whatever its splits."""
    return RowOrder(F.struct(F.col("file"), F.floor(F.col("line_no") / F.lit(rows_per_chunk)).alias("part")), F.col("line_no"))


def column_order(name: str, rows_per_chunk: int = 1 << 20) -> RowOrder:
    """Order by a numeric position column."""
    return RowOrder(F.floor(F.col(name) / F.lit(rows_per_chunk)), F.col(name))


def hash_order(seed: int | str, *key: str, prefix: int = 4) -> RowOrder:
    """Seeded shuffle order; a chunk is one digest prefix."""
    code = digest(seed, *[F.col(k) for k in key])
    return RowOrder(
        F.substring(code, 1, prefix), F.struct(code, *[F.col(k) for k in key])
    )


def _chunk_offsets(chunked: DataFrame, group: tuple[str, ...]) -> DataFrame:
    sizes = chunked.groupBy(*group, CHUNK).agg(F.count(F.lit(1)).alias("__size"))
    before = (
        Window.partitionBy(*group)
        .orderBy(CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return sizes.select(
        *group, CHUNK, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias(OFFSET)
    )


def _attach(data: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be NULL, keeping one copy of the keys."""
    renamed = small.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in small.columns if c not in keys],
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & data[k].eqNullSafe(F.col(f"__r_{k}"))
    return data.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def _place(group: tuple[str, ...], prefix: str = "") -> Column:
    """A row's group and chunk as one key; NULLs inside it are equal."""
    return F.struct(*[F.col(f"{prefix}{k}").alias(f"k{i}") for i, k in enumerate((*group, CHUNK))])


def _attach_chunks(data: DataFrame, chunks: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Rows with what is known of their chunk, dealt out by group and chunk as the numbering needs them.

    The table of chunks grows with the rows, so it is never collected for a broadcast.
    """
    keys = (*group, CHUNK)
    renamed = chunks.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in chunks.columns if c not in keys],
    ).hint("shuffle_hash")
    return data.join(renamed, _place(group) == _place(group, "__r_"), "inner").drop(*[f"__r_{k}" for k in keys])


def _local_number(group: tuple[str, ...], within: str) -> Column:
    return F.row_number().over(Window.partitionBy(_place(group)).orderBy(within))


def _chunked(df: DataFrame, order: RowOrder) -> DataFrame:
    return df.withColumns({CHUNK: order.chunk, "__within": order.within})


def number_rows(
    df: DataFrame, order: RowOrder, group: tuple[str, ...] = (), name: str = "row_no"
) -> DataFrame:
    """Dense 1-based position of every row inside its group."""
    chunked = _chunked(df, order)
    offsets = _chunk_offsets(chunked, group)
    return (
        _attach_chunks(chunked, offsets, group)
        .withColumn(name, F.col(OFFSET) + _local_number(group, "__within"))
        .drop(CHUNK, OFFSET, "__within")
    )


def _limited(offsets: DataFrame, group: tuple[str, ...], n) -> DataFrame:
    if isinstance(n, DataFrame):
        return _attach(offsets, n, list(group), "inner")
    return offsets.withColumn(LIMIT, n if isinstance(n, Column) else F.lit(n))


def first_n(
    df: DataFrame, order: RowOrder, n: "int | Column | DataFrame", group: tuple[str, ...] = ()
) -> DataFrame:
    """First ``n`` rows of every group in the given order.

    ``n`` is a number, an expression over the group columns, or a table of
    (group columns, ``__limit``).  Chunks past the limit are dropped by the join,
    before anything is sorted.
    """
    chunked = _chunked(df, order)
    reached = _limited(_chunk_offsets(chunked, group), group, n).where(
        F.col(OFFSET) < F.col(LIMIT)
    )
    return (
        _attach_chunks(chunked, reached, group)
        .withColumn(LOCAL, _local_number(group, "__within"))
        .where(F.col(OFFSET) + F.col(LOCAL) <= F.col(LIMIT))
        .drop(CHUNK, OFFSET, LIMIT, LOCAL, "__within")
    )


def mark_first_n(
    df: DataFrame, order: RowOrder, n: "int | Column | DataFrame", name: str, group: tuple[str, ...] = ()
) -> DataFrame:
    """All rows, with a flag for those :func:`first_n` would keep."""
    chunked = _chunked(df, order)
    limits = _limited(_chunk_offsets(chunked, group), group, n)
    return (
        _attach_chunks(chunked, limits, group)
        .withColumn(
            name,
            F.col(OFFSET) + _local_number(group, "__within") <= F.col(LIMIT),
        )
        .drop(CHUNK, OFFSET, LIMIT, "__within")
    )
