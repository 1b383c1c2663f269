"""Repeated byte strings across documents, by sampled suffixes and induced order.

A byte goes when a string of ``length`` bytes that covers it also starts in a document
with a smaller id.  Matches never cross documents and are judged on the input.

Only some suffixes are sorted.  Every window of ``length`` bytes holds one anchor: the
gram of ``GRAM`` bytes with the least hash among those in the window.  Equal windows have
equal anchors at equal places, so windows need comparing only around anchors that occur in
two documents; the bytes around all others are never moved.

0. Texts that an earlier id has as a whole are found by digest; they lose all their bytes if
   they have ``length`` of them, and take no further part.
1. Anchors are moved once, with their ids, and sorted by hash; those that occur in one text
   are dropped.  A batch deals out rows of an anchor that it has in two texts already.
2. Around every other anchor the run of windows that share it is cut out.  Equal runs are
   one, with the smallest id that has it (marked in each batch before the only shuffle).
3. Each shard takes whole anchors, in the order of Spark's external sort, which spills to
   disk as it must.  The suffixes that start at anchors are sorted, with the common-prefix
   lengths of neighbours.  The order of the suffixes before them is induced, one byte a
   step: a suffix is ordered by its first byte and the class of the suffix after it.  Two
   windows are equal when their induced classes are, and the sorted suffixes between them
   share enough.  The smallest id of each class is what its windows get.
4. Windows whose class has a smaller id are merged into spans, and removed.

Definitions: a null text is the empty text; a row without an id loses nothing and takes
nothing from others; rows with equal ids are one document, so they take nothing from each
other, whatever their texts; an empty table gives an empty table.  Only the named columns are
read, so further columns can't clash with the results.  Grams and windows are told apart by
64-bit hashes, as far as they are not compared byte by byte.
"""

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.sources.staging import materialize, new_path, scratch

LENGTH = 50
GRAM = 20
#: Rows of a shard that are worked on together; anchors stay whole.
BLOCK_ROWS = 1 << 17

#: Bytes of texts that are worked on together; a longer text is alone.
BLOCK_BYTES = 1 << 15

_UPPER = np.uint64(0xFFFFFFFF00000000)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = 8


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of strings from the hashes of their halves."""
    mixed = left * _LEFT
    mixed += right
    mixed ^= mixed >> np.uint64(29)
    mixed *= _RIGHT
    return mixed


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each gram of ``size`` bytes, put together from its words of eight; the last may overlap the one before."""
    n = len(data) - size + 1
    padded = np.zeros(len(data) // _WORD * _WORD + 2 * _WORD, np.uint8)
    padded[: len(data)] = data
    words = np.empty(len(padded) - _WORD, np.uint64)
    for at in range(_WORD):
        words[at::_WORD] = padded[at : len(padded) - _WORD + at].view("<u8")
    if size < _WORD:
        words &= np.uint64((1 << 8 * size) - 1)
    whole = _join(words[:n], np.full(1, size, np.uint64))
    for at in range(_WORD, size, _WORD):
        at = min(at, size - _WORD)
        whole = _join(whole, words[at : at + n])
    return whole


def anchors(
    data: np.ndarray, length: int = LENGTH, gram: int = GRAM, edges: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one anchor: first and last window, the anchor's place and hash.

    With ``edges``, the data are texts end to end, and windows that lie in two of them don't count.
    """
    windows = len(data) - length + 1
    if windows < 1:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64)
    hashes = gram_hashes(data, gram)
    span = length - gram + 1
    # The upper half of the hash and the place in one number: of equal ones the first place is less.
    least, width = (hashes & _UPPER) | np.arange(len(hashes), dtype=np.uint64), 1
    while width < span:
        shift = min(width, span - width)
        least = np.minimum(least[shift:], least[: len(least) - shift])
        width += shift
    place = (least & ~_UPPER).view(np.int64)
    if edges is not None:
        for start, end in pairwise(edges.tolist()):
            place[max(start, end - length + 1) : end] = -1
    change = np.flatnonzero(place[1:] != place[:-1]) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change, [windows])) - 1
    at = place[first]
    if edges is not None:
        inside = at >= 0
        first, last, at = first[inside], last[inside], at[inside]
    return first, last, at, hashes[at]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts to be worked on together: the first and the one after the last, their bytes end to end, and the edges of each."""
    if not len(texts):
        return
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + BLOCK_BYTES, "right")) - 1)
        yield low, high, data[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
        low = high


PLACES = "anchor long, id long, spread int"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, id, spread) for every anchor of every text.

    ``spread`` is 0 if the batch has the anchor in one text.  Otherwise it is known to be in two:
    the first row has 1, the others have numbers of their own, by which they may be dealt out.
    """
    for batch in batches:
        found, ids = [], []
        keys = batch.column(0).to_numpy()
        for low, high, data, edges in _blocks(batch.column(1)):
            first, _, _, own = anchors(data, edges=edges)
            for start, end in pairwise(np.searchsorted(first, edges).tolist()):
                own[start:end].sort()
            owner = np.searchsorted(edges, first, "right") - 1
            once = np.ones(len(own), bool)
            once[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
            found.append(own[once])
            ids.append(keys[low:high][owner[once]])
        if found:
            anchor = np.concatenate(found)
            order = np.argsort(anchor)
            anchor, key = anchor[order], np.concatenate(ids)[order]
            starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))[: len(anchor)]
            n = np.diff(np.append(starts, len(anchor)))
            nth = np.arange(len(anchor)) - np.repeat(starts, n)
            spread = np.where(np.repeat(n, n) > 1, nth + 1, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(key), pa.array(spread)], ["anchor", "id", "spread"])


def _in_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, anchor) of the rows whose anchor is in two texts, by ``spread`` or by a row beside; rows come sorted by anchor."""
    held, known = [np.empty(0, t) for t in (np.int64, np.int64, np.int32)], False

    def kept(anchor: np.ndarray, key: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(anchor[keep])], ["id", "anchor"])

    for batch in batches:
        anchor, key, spread = (np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held))
        if not len(anchor):
            continue
        same = anchor[1:] == anchor[:-1]
        keep = spread > 0
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= known
        # The last row may have its like in the next batch.
        held, known = [anchor[-1:], key[-1:], spread[-1:]], bool(keep[-1])
        yield kept(anchor[:-1], key[:-1], keep[:-1])
    if known:
        yield kept(held[0], held[1], np.ones(1, bool))


RUNS = "anchor long, no int, id long, first int, before int, least boolean, data binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of every run of windows whose anchor is among the given ones; of equal runs in a batch one with the least id is marked."""
    for batch in batches:
        columns, rows = ([], [], [], [], [], []), 0
        least: dict[tuple[int, bytes], tuple[int, int]] = {}
        nos, keys = (batch.column(i).to_numpy() for i in (0, 1))
        for low, high, data, edges in _blocks(batch.column(2)):
            first, last, at, found = anchors(data, edges=edges)
            # An anchor that one text lists is in two texts, so every text that has it lists it.
            wanted = batch.column(3).slice(low, high - low).flatten()
            keep = pc.is_in(pa.array(found.view(np.int64)), value_set=wanted).to_numpy(zero_copy_only=False)
            first, last, at, found = first[keep], last[keep], at[keep], found[keep]
            owner = np.searchsorted(edges, first, "right") - 1
            key, before = keys[low:high][owner], at - first
            raw = data.tobytes()
            cut = [raw[a:b] for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)]
            new = (found.view(np.int64), nos[low:high][owner], key, (first - edges[owner]).astype(np.int32), before.astype(np.int32), cut)
            for column, values in zip(columns, new, strict=True):
                column.append(values)
            # The anchor lies in the run, so its place and the bytes tell runs apart.
            for place, (mine, run) in enumerate(zip(key.tolist(), zip(before.tolist(), cut, strict=True), strict=True), rows):
                if run not in least or mine < least[run][0]:
                    least[run] = mine, place
            rows += len(cut)
        if columns[0]:
            marked = np.zeros(rows, bool)
            marked[[place for _, place in least.values()]] = True
            arrays = [*(pa.array(np.concatenate(c)) for c in columns[:5]), pa.array(marked), pa.array(chain.from_iterable(columns[5]), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in RUNS.split(", ")])


def least_ids(anchor: np.ndarray, before: np.ndarray, data: list[bytes], low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every run, one run after the other, the smallest id among runs that have an equal window; where each run begins."""
    sizes = np.array([len(x) for x in data])
    windows = sizes - LENGTH + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    joined = np.frombuffer(b"".join(data) + bytes(LENGTH), np.uint8)
    least = np.repeat(low, windows)
    out = np.cumsum(windows) - windows

    # A run that is alone with its anchor, or with its class later on, has no window of another.
    _, induced, n = np.unique(anchor, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(n[induced] > 1)
    induced, held = induced[rows].astype(np.int64), len(rows)
    if not held:
        return least, out

    # Sort the suffixes at the anchors; bytes past a run's end can't belong to its windows.
    tail = LENGTH - GRAM
    where = (starts[rows] + before[rows] + GRAM)[:, None] + np.arange(tail)
    right = np.where(where < ends[rows][:, None], joined[np.minimum(where, len(joined) - 1)], 0).astype(np.uint8)
    words = np.zeros((held, (tail + 7) // 8 * 8), np.uint8)
    words[:, :tail] = right
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], induced))
    same_anchor = induced[order][1:] == induced[order][:-1]
    differs = right[order][1:] != right[order][:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), tail)
    common = np.where(same_anchor, common, -1)

    # Induce the suffixes before: class of a suffix from its first byte and the class after it.
    place = np.arange(held)
    cls = np.empty(held, np.int64)
    for step in range(tail + 1):
        if step:
            inside = np.flatnonzero(before[rows] >= step)
            rows, place = rows[inside], place[inside]
            byte = joined[starts[rows] + before[rows] - step].astype(np.int64)
            _, induced, n = np.unique((induced[inside] << 8) | byte, return_inverse=True, return_counts=True)
            several = np.flatnonzero(n[induced] > 1)
            rows, place, induced = rows[several], place[several], induced[several].astype(np.int64)
        window = before[rows] - step
        having = np.flatnonzero(window < windows[rows])
        if not len(having):
            continue
        # Sorted suffixes that share what is left of the window after the anchor.
        cls[order] = np.concatenate(([0], np.cumsum(common < tail - step)))
        key = induced[having] * held + cls[place[having]]
        by = np.argsort(key, kind="stable")
        edges = np.concatenate(([0], np.flatnonzero(np.diff(key[by])) + 1))
        mine = rows[having][by]
        lows = np.minimum.reduceat(low[mine], edges)
        least[out[mine] + window[having][by]] = np.repeat(lows, np.diff(np.append(edges, len(by))))
    return least, out


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest ids of the windows of distinct runs; rows come sorted by anchor, blocks hold whole anchors."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        anchor, before, low, code = (table.column(i).to_numpy() for i in (0, 1, 3, 4))
        data = table.column(2).to_pylist()
        found, out = least_ids(anchor, before.astype(np.int64), data, low)
        # One value stands for all windows where they agree.
        sizes = np.diff(np.append(out, len(found)))
        agree = np.minimum.reduceat(found, out) == np.maximum.reduceat(found, out)
        kept = ~np.repeat(agree, sizes)
        kept[out] = True
        offsets = np.concatenate(([0], np.cumsum(np.where(agree, 1, sizes)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.array(found[kept]))
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(before), pa.array(code), lists], ["anchor", "before", "code", "lows"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < BLOCK_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield solve(table.slice(0, cut))
        rest = table.slice(cut)
        held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield solve(pa.Table.from_batches(held).combine_chunks())


def _spans(keys: np.ndarray, edges: np.ndarray, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans to remove, from the windows whose smallest id is below the text's own: the text, first byte and the one after the last."""
    owner = np.repeat(np.arange(len(keys)), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
    first, windows, lists = found.flatten().flatten()
    n = pc.list_value_length(lists).to_numpy()
    run = np.repeat(np.arange(len(n)), n)
    later = np.flatnonzero(lists.flatten().to_numpy() < keys[owner[run]])
    run, nth = run[later], later - (np.cumsum(n) - n)[run[later]]
    # A place between the texts keeps their spans apart.
    start = (edges[:-1] + np.arange(len(keys)))[owner[run]] + first.to_numpy()[run] + nth
    end = start + LENGTH + np.where(n[run] == 1, windows.to_numpy()[run] - 1, 0)
    order = np.argsort(start, kind="stable")
    start, reach, owner = start[order], np.maximum.accumulate(end[order]), owner[run][order]
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))[: len(start)]
    text = owner[new]
    return text, start[new] - text, reach[np.append(new[1:], len(start))[: len(new)] - 1] - text


REMOVED = T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary")


@F.arrow_udf(REMOVED)
def _removed(ids: pa.Array, texts: pa.Array, found: pa.Array, with_text: pa.Array) -> pa.Array:
    """What stays of every text."""
    out: tuple[list, ...] = ([], [], [], [], [])
    keys, wanted = ids.to_numpy(), with_text.to_pylist()
    for low, high, data, edges in _blocks(texts):
        raw, at = data.tobytes(), edges.tolist()
        owner, starts, ends = _spans(keys[low:high], edges, found.slice(low, high - low))
        mine, starts, ends = np.searchsorted(owner, np.arange(high - low + 1)).tolist(), starts.tolist(), ends.tolist()
        for i in range(high - low):
            a, b = mine[i], mine[i + 1]
            kept = b"".join([raw[x:y] for x, y in zip([at[i], *ends[a:b]], [*starts[a:b], at[i + 1]], strict=True)])
            size = at[i + 1] - at[i]
            values = (size, size - len(kept), b - a, hashlib.sha256(kept).hexdigest(), kept if wanted[low + i] else None)
            for column, value in zip(out, values, strict=True):
                column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], REMOVED.names)


def _stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows as a stored table; the shuffle files behind them are let go at once, not when the driver next tidies up."""
    table = materialize(df, name, keep=keep, compression="zstd")
    df.sparkSession.sparkContext._jvm.System.gc()
    return table


def _identified(df: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(id, no, text): rows with one id and different texts are told apart by ``no``, a hash of the text."""
    rows = df.select(*more, F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("no", F.hash("text"))


def _beside(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Rows of one (id, no) joined; only the id is a key, so that texts stay in the buckets of theirs."""
    other = right.withColumnsRenamed({"no": "__no", "id": "__id"})
    return left.join(other, (left["id"] == F.col("__id")) & (left["no"] - F.col("__no") == 0), how).drop("__no", "__id")


def _first_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, texts): rows (id, no) whose text an earlier id has, and the other rows, stored in buckets of their ids.

    Copies are found by digest, so only ids and digests are grouped.  The texts are moved
    once; what is joined to them later comes to where they are.
    """
    spark = rows.sparkSession
    with scratch(spark):
        digests = _stored(rows.where(F.col("id").isNotNull()).select("no", "id", F.sha2("text", 256).alias("digest")), "suffix-digests")
        firsts = digests.groupBy("digest").agg(F.min("id").alias("first"))
        copies = digests.join(firsts, "digest").where(F.col("id") != F.col("first")).select("no", "id").distinct()
        copies = _stored(copies, "suffix-copies", keep=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = _beside(rows.where(F.col("id").isNotNull()).repartition(parts, "id"), copies, "left_anti")
    name = f"suffix_texts_{uuid.uuid4().hex}"
    own.write.bucketBy(parts, "id").option("compression", "zstd").option("path", new_path(spark, "suffix-texts")).saveAsTable(name)
    spark.sparkContext._jvm.System.gc()
    return copies, spark.table(name)


def repeated_runs(texts: DataFrame) -> DataFrame:
    """(no, id, found): for every text (no, id, text) the runs of windows that may lie in an earlier one, stored."""
    with scratch(texts.sparkSession):
        return _stored(_repeated_runs(texts), "suffix-found", keep=True)


def _shared_runs(texts: DataFrame) -> DataFrame:
    """The runs around anchors that occur in two texts, stored; what led to them is not kept."""
    with scratch(texts.sparkSession):
        places = texts.select("id", "text").mapInArrow(_places, PLACES)
        # An anchor's rows are moved once and meet in one task, but for those that are known to be in two texts.
        placed = places.repartition("anchor", F.greatest("spread", F.lit(1))).sortWithinPartitions("anchor")
        shared = placed.mapInArrow(_in_two, "id long, anchor long")
        wanted = _stored(shared.groupBy("id").agg(F.collect_list("anchor").alias("wanted")), "suffix-wanted")
        runs = texts.join(wanted, "id").select("no", "id", "text", "wanted").mapInArrow(_runs, RUNS)
        return _stored(runs, "suffix-runs", keep=True)


def _repeated_runs(texts: DataFrame) -> DataFrame:
    runs = _shared_runs(texts)
    code = F.xxhash64("data").alias("code")
    # Each batch has marked its distinct runs, so they are moved once, by anchor, and made one where they are sorted.
    marked = runs.where("least").select("anchor", "before", "data", "id").repartition("anchor")
    distinct = marked.groupBy("anchor", "before", "data").agg(F.min("id").alias("low"))
    shards = distinct.sortWithinPartitions("anchor").select("anchor", "before", "data", "low", code)
    lows = _stored(shards.mapInArrow(_induce, "anchor long, before int, code long, lows array<bigint>"), "suffix-lows")
    windows = (F.octet_length("data") - LENGTH + 1).alias("windows")
    coded = runs.select("anchor", "before", "no", "id", "first", windows, code)
    later = coded.join(lows, ["anchor", "before", "code"]).where(F.array_min("lows") < F.col("id"))
    return later.groupBy("id", "no").agg(F.collect_list(F.struct("first", "windows", "lows")).alias("found"))


def _untouched(rows: DataFrame) -> DataFrame:
    """The result for rows (id, text) that keep all of their text, or none if ``whole``."""
    size = F.octet_length("text").cast("long")
    gone = F.col("whole") & (size >= LENGTH)
    left = F.when(gone, F.lit("")).otherwise(F.col("text"))
    return rows.select(
        "id",
        size.alias("n_bytes"),
        F.when(gone, size).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        gone.cast("long").alias("n_spans"),
        F.sha2(left, 256).alias("kept_sha256"),
    )


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    rows = _identified(df, key, text)
    copies, texts = _first_texts(rows)
    done = _beside(texts, repeated_runs(texts), "left").select("id", _removed("id", "text", "found", F.lit(False)).alias("removed"))
    others = _untouched(_beside(rows, copies, "left_semi").withColumn("whole", F.lit(True)))
    nameless = _untouched(rows.where(F.col("id").isNull()).withColumn("whole", F.lit(False)))
    parts = done.select("id", "removed.n_bytes", "removed.n_removed", "removed.n_spans", "removed.kept_sha256")
    return parts.unionByName(others).unionByName(nameless).withColumnRenamed("id", key)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with what is left of their texts; bytes of characters that were cut in two go as well."""
    rows = _identified(df, key, text, F.struct(*[df[c] for c in df.columns if c != text]).alias("row"))
    copies, texts = _first_texts(rows)
    found = repeated_runs(texts)
    done = _beside(texts, found, "left").select("row", _removed("id", "text", "found", F.lit(True)).getField("kept").cast("string").alias("kept"))
    whole = F.when(F.octet_length("text") >= LENGTH, F.lit("")).otherwise(F.col("text"))
    others = _beside(rows, copies, "left_semi").select("row", whole.alias("kept"))
    nameless = rows.where(F.col("id").isNull()).select("row", F.col("text").alias("kept"))
    left = done.unionByName(others).unionByName(nameless)
    valid = F.coalesce(F.try_validate_utf8("kept"), F.replace(F.make_valid_utf8("kept"), F.lit("\ufffd"), F.lit("")))
    return left.select(*[valid.alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in df.columns])
