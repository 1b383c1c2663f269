"""Byte-level BPE: texts to token ids and back.

A piece is encoded from its longest vocabulary matches, without replaying merges.
Bytes are mapped to Latin-1 characters, so one automaton over all tokens finds
every match; the encoder takes the longest one, and goes back to a shorter one
when a token may not stand beside its left neighbour.  Two tokens may stand side
by side when no merge across their border would have happened before the merges
that made them.  That test is memoised, and a position that led nowhere is never
tried again, so the work is linear in the length of the piece.

Definitions: a null text is the empty text (no ids, empty bytes); repeated rows
are encoded each on its own; an empty table gives an empty table.  Only the named
id and text columns are read, so further columns can't clash with the results.
"""

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMO_ENTRIES = 1 << 18
#: Characters of the longest piece whose ids are remembered.
MEMO_LENGTH = 64
COMPATIBLE_ENTRIES = 1 << 20


class Memo(dict):
    """Remembers a function's results: the recent ones, and those used again since the last turnover."""

    def __init__(self, compute, entries: int = MEMO_ENTRIES, longest: int | None = None):
        """``longest``: results for longer keys are not remembered, which bounds the memory."""
        super().__init__()
        self.compute, self.entries, self.longest, self.older = compute, entries, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if self.longest is not None and len(key) > self.longest:
                return value
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class BytePairCodec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            parts = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in parts}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.lengths = {rank: len(token) for rank, token in self.tokens.items()}
        self.decimals = {rank: b"%d" % rank for rank in self.tokens}
        # Of every token: its id, its length, and how far its first byte lies before its last.
        entries = {rank: (rank, len(token), len(token) - 1) for rank, token in self.tokens.items()}
        self.matcher = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.matcher.add_word(token.decode("latin-1"), entries[rank])
        self.matcher.make_automaton()
        self.entries = entries
        self.pattern = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int]] = {}
        self.never = max(self.tokens) + 1
        self.shorter = Memo(self._shorter)
        self.compatible = Memo(self._side_by_side, COMPATIBLE_ENTRIES)
        self.piece = Memo(self._encode_piece, longest=MEMO_LENGTH)

    def _shorter(self, rank: int) -> tuple[int, int, int] | None:
        """The longest other token that the token starts with."""
        token = self.tokens[rank]
        for end in range(len(token) - 1, 0, -1):
            found = self.ranks.get(token[:end])
            if found is not None:
                return self.entries[found]
        return None

    def _halves(self, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a single byte has none."""
        found = self.halves.get(rank)
        if found is None:
            found, token, start = (rank, rank), self.tokens[rank], self.shorter[rank]
            while start is not None:
                left, length, _ = start
                right = self.ranks.get(token[length:])
                if right is not None and left < rank and right < rank and self._compatible(left, right, rank):
                    found = (left, right)
                    break
                start = self.shorter[left]
            self.halves[rank] = found
        return found

    def _side_by_side(self, key: int) -> bool:
        return self._compatible(key >> 32, key & 0xFFFFFFFF, self.never)

    def _compatible(self, left: int, right: int, limit: int) -> bool:
        """Whether BPE keeps the border between two tokens, looking at merges before ``limit`` only.

        The later of the two was made last.  Before that its inner part stood at the
        border, and a merge across the border that comes earlier would have won.  Each
        round undoes the latest merge and tests the parts that then met.
        """
        ranks, tokens = self.ranks, self.tokens
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < limit:
                return False
            left_whole, right_whole = self.lengths[left] == 1, self.lengths[right] == 1
            if left_whole and right_whole:
                return True
            # Of two equal merges the left one happens first, so the right one is undone first.
            if right_whole or (not left_whole and left > right):
                # A merge across with the same rank as the left token's would come later.
                limit = left
                left = self._halves(left)[1]
            else:
                limit = right + 1
                right = self._halves(right)[0]

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        size = len(data)
        longest = [None] * size
        for end, match in self.matcher.iter(data.decode("latin-1")):
            longest[end - match[2]] = match
        shorter, compatible = self.shorter, self.compatible
        closed: set[int] = set()
        out: list[tuple[int, int, int]] = []
        at, token, left = 0, longest[0], -1
        while True:
            rank, length, _ = token
            end = at + length
            if end not in closed and (left < 0 or compatible[left << 32 | rank]):
                out.append(token)
                if end == size:
                    return tuple([x[0] for x in out])
                at, left, token = end, rank, longest[end]
            elif (smaller := shorter[rank]) is not None:
                token = smaller
            else:
                # Nothing fits here: the position is closed, the token before it is tried shorter.
                closed.add(at)
                token = out.pop()
                at -= token[1]
                left = out[-1][0] if out else -1

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.piece.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that token ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def id_list(self, ids: Iterable[int]) -> bytes:
        """Decimal ids joined by one space."""
        return b" ".join(map(self.decimals.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(rank_file: str, pattern: str) -> BytePairCodec:
    """One codec for each worker process."""
    return BytePairCodec(rank_file, pattern)


def _columns(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))


def encode_texts(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            ids = [own.encode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    rows = _columns(df, key, text)
    kind = rows.schema["id"].dataType
    return rows.mapInArrow(run, T.StructType().add("id", kind).add("ids", T.ArrayType(T.IntegerType()))).withColumnRenamed("id", key)


def decode_ids(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, data) with the bytes that every row's ids stand for; null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            data = [own.decode(x.as_py() or ()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["id", "data"])

    rows = df.select(F.col(key).alias("id"), F.col(ids).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType
    return rows.mapInArrow(run, T.StructType().add("id", kind).add("data", T.BinaryType())).withColumnRenamed("id", key)


def round_trip(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, n_bytes): what encoding and then decoding gave, in one pass."""

    def digests(own: BytePairCodec, value: str | None) -> tuple[int, str, str, int]:
        ids = own.encode(value)
        data = own.decode(ids)
        return len(ids), hashlib.sha256(own.id_list(ids)).hexdigest(), hashlib.sha256(data).hexdigest(), len(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            found = [digests(own, x.as_py()) for x in batch.column(1)]
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
            )

    rows = _columns(df, key, text)
    kind = rows.schema["id"].dataType
    out = T.StructType().add("id", kind).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("n_bytes", "long")
    return rows.mapInArrow(run, out).withColumnRenamed("id", key)
