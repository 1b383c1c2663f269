"""Shards by jump consistent hashing.

A key's shard follows from the key and the number of shards alone: no ring, no
table.  With one shard more, a key either stays or moves into the new shard.

Definitions: a null text has no bytes; a null key is a key like any other; rows
with equal keys share a shard, in any number (their slots follow the table's layout); an empty
table gives an empty table.  Only the named
key and text columns are read, so further columns can't clash with the results.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.names import free_name
from cinderlog.sources.staging import materialize

# Fixed values of the published jump hash: the generator's multiplier and its range.
MULTIPLIER = np.uint64(2862933555777941757)
RANGE_BITS = 31
#: Rows of a shard are numbered in so many chunks, so that no task sorts a whole shard.
CHUNKS = 512
ROW_BYTES = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every 64-bit key."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    todo = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(todo):
            state[todo] = state[todo] * MULTIPLIER + np.uint64(1)
            draw = (state[todo] >> np.uint64(64 - RANGE_BITS)).astype(np.float64) + 1.0
            after = ((shard[todo] + 1) * (float(1 << RANGE_BITS) / draw)).astype(np.int64)
            moves = after < shards
            todo = todo[moves]
            shard[todo] = after[moves]
    return shard


def with_shards(df: DataFrame, key: str, shards: int, shard: str = "shard", grown: str | None = None) -> DataFrame:
    """The rows with their shard; ``grown`` names a column for the shard with one shard more."""
    if shards < 1:
        raise ValueError("there must be at least one shard")

    kind = "struct<shard int, grown int>"

    @F.pandas_udf(kind)
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for keys in batches:
            both = [jump(keys.to_numpy(), n).astype(np.int32) for n in ((shards, shards + 1) if grown else (shards, shards))]
            yield pd.DataFrame({"shard": both[0], "grown": both[1]})

    both = free_name(df, "both_shards")
    placed = df.withColumn(both, place(F.xxhash64(F.col(key).cast("string"))))
    named = {shard: F.col(both)["shard"], **({grown: F.col(both)["grown"]} if grown else {})}
    return placed.withColumns(named).drop(both)


def assign(df: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", chunks: int = CHUNKS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Slots count the rows of a shard from 0 without gaps.  Rows are numbered inside
    (shard, chunk) and shifted by the sizes of the chunks before; the texts
    themselves are not moved.  Chunks hash id, text and a row number, so that neither
    a key that many rows share nor a row that is repeated meets in one task; shards and
    chunks are stored first, so that later steps agree on them.
    """
    data = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(
        F.col(key).alias("id"),
        (F.octet_length(data).cast("long") + F.lit(ROW_BYTES)).alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    rows = with_shards(rows, "id", shards, "shard", "grown_shard")
    spread = F.xxhash64(F.col("id").cast("string"), "text_crc32", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("chunk", F.pmod(spread, F.lit(chunks)).cast("int")), "shard-rows")
    sizes = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "chunk").orderBy("id", "text_crc32", "size")
    return rows.join(offsets, ["shard", "chunk"]).select(
        F.col("id").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("offset") + F.row_number().over(inside) - 1).alias("slot"),
        "grown_shard",
    )


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id", files: int = 1) -> None:
    """Store the rows in one folder for each shard, each in up to ``files`` files."""
    spread = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("file")), F.lit(files))
    placed = with_shards(df, key, shards, "shard")
    placed.repartition(shards * files, "shard", spread).write.partitionBy("shard").parquet(path)
