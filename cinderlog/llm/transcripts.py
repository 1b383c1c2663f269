"""Roles of transcript lines by a hidden Markov model, and canonical turns.

States are (role, first line of a turn or a later one).  A line shows a speaker-marker name,
whether it ends with a question mark, a length class, the case of its first letter and
whether it is empty.  All probabilities are learned by counting labelled transcripts: counts
are summed up on the executors, and only the finished tables (their size is bounded by the
states, the feature values and ``NAME_SHARE``) go to every task.

A transcript is a sequence of text parts (one message each, or one log line, or the whole).
It may be longer than any task should hold: parts are cut into pieces of ``PIECE_LINES`` lines,
pieces are numbered densely along the transcript, whatever the parts' own numbers are, and
worked on in chunks of ``CHUNK`` pieces.
A first pass gives each chunk's best scores between any two border states; those are chained
along the transcript; a second pass decodes each chunk between its own border states.  The
result is the Viterbi path of the whole transcript.

Definitions: a null or empty part has no lines; parts with equal numbers follow each other
in the order of their texts' first ``ORDER_CHARS`` characters, then of a hash; parts without a number come first; a part without a transcript id belongs to the transcript with the
null id; repeated rows are parts of their own; empty tables give empty tables.  Only the named
columns are read, so further columns can't clash with the results.
"""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.sources.staging import materialize

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
NUMBER = {state: i for i, state in enumerate(STATES)}
S = len(STATES)
CHUNK = 256
PIECE_LINES = 64
#: Parts with equal numbers are told apart by so many characters, then by a hash of the text.
ORDER_CHARS = 200
#: A marker name is told apart when at least this share of all marked lines has it.
NAME_SHARE = 0.001
SMOOTHING = 0.5
#: A marker name is so much likelier (logarithm) for starts than for later lines.
MARKED = log(10)

# What may stand before a speaker's words: some signs, a name, a closing sign.
MARKER = re.compile(r"^[\s#*\-<|\[(]{0,8}([A-Za-z]{1,14})[|\])*>]{0,3}(?:[:>\]|]+\s?|\s*$)")
FEATURES = ("name", "asks", "size", "case", "blank")


def observe(line: str) -> tuple[str, str, str, str, str]:
    """Feature values of a line."""
    found = MARKER.match(line)
    body = line[found.end() :] if found else line
    text = body.strip()
    first = next((c for c in text if c.isalpha()), "")
    case = "none" if not first else "upper" if first.isupper() else "lower"
    return found[1].lower() if found else "-", str(text.endswith("?")), str(min(len(text).bit_length(), 12)), case, str(not text)


def without_marker(line: str, model: "Model") -> str:
    """The line without its speaker marker, if the model knows that name for the starts of turns."""
    found = MARKER.match(line)
    return line[found.end() :] if found and model.marks(found[1].lower()) else line


@dataclass(frozen=True)
class Model:
    """Logarithms of the start, transition and emission probabilities."""

    start: np.ndarray
    moves: np.ndarray
    emissions: dict[str, dict[str, np.ndarray]]

    def marks(self, name: str) -> bool:
        """Whether a name is clearly likelier in the first line of some role's turns than in their later ones."""
        found = self.emissions["name"].get(name) if name else None
        return found is not None and any(found[NUMBER[r, True]] > found[NUMBER[r, False]] + MARKED for r in ROLES)

    def scores(self, lines: list[str]) -> np.ndarray:
        """Log probability of each line in each state."""
        out = np.zeros((len(lines), S))
        for i, line in enumerate(lines):
            for feature, value in zip(FEATURES, observe(line), strict=True):
                table = self.emissions[feature]
                out[i] += table.get(value, table[""])
        return out


def _ordered(df: DataFrame, conv: str, turn: str, text: str, *more: str) -> DataFrame:
    return df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(text).cast("string").alias("text"), *more)


def fit(labelled: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Learn from parts whose role is known; parts with another role are left out."""
    parts = _ordered(labelled, conv, turn, text, F.col(role).alias("role")).where(F.col("role").isin(*ROLES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for value, who in zip(batch.column(0), batch.column(1), strict=True):
                lines = (value.as_py() or "").split("\n") if value.as_py() else []
                for i, line in enumerate(lines):
                    state = NUMBER[who.as_py(), i == 0]
                    for feature, shown in zip(FEATURES, observe(line), strict=True):
                        seen["emit", feature, state, shown] += 1
                    if i:
                        seen["stay", who.as_py(), 0 if i == 1 else 1, ""] += 1
                if lines:
                    seen["end", who.as_py(), 0 if len(lines) == 1 else 1, ""] += 1
            rows = [(*map(str, k), n) for k, n in seen.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "what", "state", "shown", "n"])

    counted = parts.select("text", "role").mapInArrow(count, "kind string, what string, state string, shown string, n long")
    counted = materialize(counted.groupBy("kind", "what", "state", "shown").agg(F.sum("n").alias("n")), "transcript-counts")
    is_name = (F.col("kind") == "emit") & (F.col("what") == "name")
    by_name = counted.where(is_name & (F.col("shown") != "-")).groupBy("shown").agg(F.sum("n").alias("total"))
    marked = by_name.agg(F.sum("total")).first()[0] or 0
    usual = by_name.where(F.col("total") >= NAME_SHARE * marked).select(F.col("shown").alias("known"))
    small = counted.join(usual, F.col("shown") == F.col("known"), "left")
    shown = F.when(is_name & (F.col("shown") != "-") & F.col("known").isNull(), F.lit("")).otherwise(F.col("shown"))
    tables = small.groupBy("kind", "what", "state", shown.alias("shown")).agg(F.sum("n").alias("n")).collect()

    # Turns follow each other by number; joined on it, no transcript meets in one task.
    turns = parts.groupBy("conv", "turn").agg(F.min("role").alias("role"))
    after = turns.select(F.col("conv").alias("c"), (F.col("turn") - 1).alias("t"), F.col("role").alias("next"))
    follow = turns.join(after, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t"))).groupBy("role", "next").agg(F.count(F.lit(1)).alias("n")).collect()
    first = turns.groupBy("conv").agg(F.min_by("role", "turn").alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()
    return _model(tables, {(r["role"], r["next"]): r["n"] for r in follow}, {r["role"]: r["n"] for r in first})


def _model(tables, follow: dict, first: dict) -> Model:
    emissions: dict[str, dict[str, np.ndarray]] = {}
    for feature in FEATURES:
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.full(S, SMOOTHING))
        counts[""] = np.full(S, SMOOTHING)
        for r in tables:
            if r["kind"] == "emit" and r["what"] == feature:
                counts[r["shown"]][int(r["state"])] += r["n"]
        total = sum(counts.values())
        emissions[feature] = {shown: np.log(n / total) for shown, n in counts.items()}
    stays, ends = Counter(), Counter()
    for r in tables:
        if r["kind"] in ("stay", "end"):
            (stays if r["kind"] == "stay" else ends)[r["what"], int(r["state"])] += r["n"]
    moves = np.full((S, S), -np.inf)
    for (role, begins), i in NUMBER.items():
        later = 0 if begins else 1
        stay, end = stays[role, later] + SMOOTHING, ends[role, later] + SMOOTHING
        moves[i, NUMBER[role, False]] = log(stay / (stay + end))
        whole = sum(follow.get((role, r), 0) + SMOOTHING for r in ROLES)
        for r in ROLES:
            moves[i, NUMBER[r, True]] = log(end / (stay + end)) + log((follow.get((role, r), 0) + SMOOTHING) / whole)
    start = np.full(S, -np.inf)
    whole = sum(first.get(r, 0) + SMOOTHING for r in ROLES)
    for r in ROLES:
        start[NUMBER[r, True]] = log((first.get(r, 0) + SMOOTHING) / whole)
    return Model(start, moves, emissions)


def transfer(model: Model, scores: np.ndarray, entry: bool) -> np.ndarray:
    """Best score of a path through the lines from each state before them to each state at their end.

    At a transcript's start there is no state before; all rows then hold the start's scores.
    """
    best = np.where(np.eye(S, dtype=bool), 0.0, -np.inf)
    for i, score in enumerate(scores):
        step = np.tile(model.start, (S, 1)) if entry and i == 0 else model.moves
        best = (np.zeros((S, S)) + step if entry and i == 0 else (best[:, :, None] + step[None]).max(axis=1)) + score
    return best


def best_path(model: Model, scores: np.ndarray, before: int | None, last: int) -> list[int]:
    """Most likely states of the lines, given the state before them (None at the start) and the last one."""
    value = (model.start if before is None else model.moves[before]) + scores[0]
    back = []
    for score in scores[1:]:
        options = value[:, None] + model.moves
        back.append(options.argmax(axis=0))
        value = options.max(axis=0) + score
    path = [last]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def _pieces(parts: DataFrame) -> DataFrame:
    """(conv, block, at, text): each part with lines in pieces, sorted by range over tasks (blocks), ``at`` counting a task's rows.

    The range is over transcript, number, text and the row, so neither a hot transcript nor a
    repeated part is one task's.
    """
    lines = F.split("text", "\n")
    starts = F.sequence(F.lit(1), F.size(lines), F.lit(PIECE_LINES))
    cut = F.transform(starts, lambda i: F.array_join(F.slice(lines, i, PIECE_LINES), "\n"))
    rows = parts.where(F.octet_length("text") > 0).select("conv", "turn", F.xxhash64("text").alias("code"), F.monotonically_increasing_id().alias("row"), "text")
    order = [F.col("conv"), F.col("turn"), F.substring("text", 1, ORDER_CHARS), F.col("code"), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cuts = rows.select("conv", F.explode(cut).alias("text"))
    return cuts.select("conv", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("at"), "text")


def _chunks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list[str]]]]:
    """(key, lines of each part) of successive rows with equal first columns; the text comes last."""
    key, parts = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if row[:keys] != key:
                if parts:
                    yield key, parts
                key, parts = row[:keys], []
            parts.append(row[-1].split("\n"))
    if parts:
        yield key, parts


SEGMENTS = "chunk long, segment long, role string, continues boolean, n_lines long, content string"


def parse(df: DataFrame, model: Model, conv: str = "conv_id", turn: str = "turn", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv, chunk, segment, role, continues, n_lines, content, canonical): the turns of every transcript.

    A turn that goes on over a chunk's border is two segments; the second ``continues``.
    """
    spark = df.sparkSession
    kind = df.select(F.col(conv)).schema[0].dataType.simpleString()
    id_kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    pieces = materialize(_pieces(_ordered(df, conv, turn, text)), "transcript-pieces")
    # A piece's number is its place among the task's rows of its transcript, after those of the tasks before.
    inside = pieces.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = inside.select(F.col("conv").alias("c"), F.col("block").alias("b"), "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = pieces.join(offsets, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    number = F.col("offset") + F.col("at") - F.col("least")
    parts = numbered.select("conv", number.alias("number"), F.floor(number / chunk).alias("chunk"), "text")
    parts = materialize(parts, "transcript-parts")
    opens = parts.withColumn("opens", F.col("chunk") == 0)

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "number")

    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for (name, no, opens), found in _chunks(batches, 3):
            lines = [x for part in found for x in part]
            matrix = transfer(own, own.scores(lines), opens)
            yield pa.RecordBatch.from_arrays([pa.array([name], id_kind), pa.array([no], pa.int64()), pa.array([matrix.ravel().tolist()])], ["conv", "chunk", "matrix"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(name, numbers, matrices):
            value, back = matrices[0][0], []
            for matrix in matrices[1:]:
                options = value[:, None] + matrix
                back.append(options.argmax(axis=0))
                value = options.max(axis=0)
            path = [int(value.argmax())]
            for step in reversed(back):
                path.append(int(step[path[-1]]))
            path = path[::-1]
            before = [None, *path[:-1]]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(path), id_kind), pa.array(numbers, pa.int64()), pa.array(before, pa.int32()), pa.array(path, pa.int32())], ["conv", "chunk", "before", "last"])

        name, numbers, matrices = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if numbers and row[0] != name:
                    yield solved(name, numbers, matrices)
                    numbers, matrices = [], []
                name = row[0]
                numbers.append(row[1])
                matrices.append(np.array(row[2]).reshape(S, S))
        if numbers:
            yield solved(name, numbers, matrices)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for (name, no, before, last), found in _chunks(batches, 4):
            lines = [x for part in found for x in part]
            path = best_path(own, own.scores(lines), before, last)
            rows: list[list] = []
            for line, state in zip(lines, path, strict=True):
                role, begins = STATES[state]
                if begins or not rows:
                    rows.append([role, not begins, []])
                rows[-1][2].append(without_marker(line, own) if begins else line)
            content = ["\n".join(r[2]).strip() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(rows), id_kind),
                    pa.array([no] * len(rows), pa.int64()),
                    pa.array(range(len(rows)), pa.int64()),
                    pa.array([r[0] for r in rows]),
                    pa.array([r[1] for r in rows]),
                    pa.array([len(r[2]) for r in rows], pa.int64()),
                    pa.array(content),
                ],
                ["conv", *[c.split()[0] for c in SEGMENTS.split(", ")]],
            )

    matrices = in_order(opens).select("conv", "chunk", "opens", "text").mapInArrow(score, f"conv {kind}, chunk long, matrix array<double>")
    borders = matrices.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(chain, f"conv {kind}, chunk long, before int, last int")
    borders = materialize(borders, "transcript-borders").withColumnsRenamed({"conv": "c", "chunk": "k"})
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))
    ready = in_order(parts.join(borders, same)).select("conv", "chunk", "before", "last", "text")
    turns = ready.mapInArrow(decode, f"conv {kind}, {SEGMENTS}")
    canonical = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n<|end|>"))
    return turns.withColumn("canonical", canonical).withColumnRenamed("conv", conv)
