"""Periodic runs, hard negatives and certified packing against brute force, on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cinderlog.llm import negatives, packing, queries, repacking, runs

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF_DIR = "/root/testdata/sf0.001"


def runs_of(words):
    """(start, length, period) of all runs, from the definition: every period, every stretch."""
    best = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def repetitive(chance):
    kind = chance.randrange(5)
    if kind == 0:
        return [chance.choice("ab") for _ in range(chance.randrange(200))]
    if kind == 1:
        out = []
        while len(out) < 250:
            out += [chance.choice("abcdefgh"[: chance.choice([1, 2, 8])]) for _ in range(chance.randrange(1, 30))] * chance.randrange(1, 6)
        return out
    if kind == 2:
        # A stretch of a short period inside a longer one.
        unit = ["a"] * chance.randrange(1, 40) + ["b"] * chance.randrange(30) + ["c"] * chance.randrange(30)
        return ["d"] * chance.randrange(5) + unit * chance.randrange(2, 6) + unit[: chance.randrange(len(unit) + 1)]
    if kind == 3:
        return ["a"] * chance.randrange(300)
    a, b = ["a"], ["a", "b"]
    while len(b) < 200:
        a, b = b, b + a
    return b * chance.randrange(1, 4)


@pytest.fixture(scope="module")
def wordy(spark):
    chance = random.Random(4)
    texts = [None, "", " \t\n ", "one", "\x1cno break\x85here ", "x " * 100_000, " ".join(map(str, range(20_000)))]
    texts += [" ".join(repetitive(chance)) for _ in range(250)]
    rows = [(i, t, 1, "z") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "a b " * 30, 1, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string")


@pytest.mark.parametrize("chunk", [50, runs.CHUNK_WORDS])
def test_runs_and_what_they_collapse_to(wordy, chunk):
    expected = []
    for r in wordy.collect():
        words = (r["text"] or "").encode().split()
        found = [(0, 100_000, 1)] if len(words) == 100_000 else [] if len(words) == 20_000 else runs_of(words)
        dropped = {i for start, length, period in found for i in range(start + period, start + length)}
        expected.append((r["doc_id"], len(words), found, " ".join(w.decode() for i, w in enumerate(words) if i not in dropped)))
    rows = runs.periodic_runs(wordy, chunk_words=chunk).collect()
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows]
    order = lambda r: (str(r[0]), r[1])
    assert sorted(got, key=order) == sorted(expected, key=order)


def test_runs_of_no_rows(wordy):
    assert runs.periodic_runs(wordy.limit(0)).collect() == []


def test_wavelet_tree_counts_and_finds():
    chance = np.random.default_rng(2)
    values = chance.permutation(500)
    tree = runs.WaveletTree(values, 500)
    low = chance.integers(0, 400, 300)
    high = low + chance.integers(1, 100, 300)
    bound = chance.integers(0, 501, 300)
    assert tree.below(low, high, bound).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, bound, strict=True)]
    nth = chance.integers(0, high - low)
    assert tree.pick(low, high, nth).tolist() == [sorted(values[a:b])[k] for a, b, k in zip(low, high, nth, strict=True)]


def test_query_of_runs(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").where(F.length("text") < 6000).collect()}
    seen = 0
    for r in queries.QUERIES["op11_periodic_runs"](spark, SF_DIR).collect():
        if r["doc_id"] not in docs:
            continue
        words = (docs[r["doc_id"]] or "").encode().split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = runs_of(words)
        dropped = {i for start, length, period in found for i in range(start + period, start + length)}
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        listed = "".join(f"{s},{le},{q}\n" for s, le, q in sorted(found, key=lambda x: (x[0], x[2])))
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
        seen += len(found)
    assert seen > 5


def mined(rows):
    """The answer from all pairs."""
    usable = [(i, m, [math.floor(256 * x) for x in v]) for i, m, v in rows if None not in (i, m, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in usable:
        if i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j, m) for j, m, w in usable if j != i), key=lambda t: t[:2])
        for score, j, _ in [t for t in scored if t[2] == label][:5]:
            window = [t for t in scored if t[2] != label and 50 * -score <= 100 * -t[0] <= 95 * -score]
            out += [(i, j, rank, t[1], -score, -t[0]) for rank, t in enumerate(window[:3], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    chance = np.random.default_rng(3)
    rows = []
    for i in range(700):
        v = [float(x) for x in chance.normal(size=chance.choice([0, 3, 8, 19], p=[0.02, 0.08, 0.1, 0.8]))]
        if v and i % 37 == 0:
            v[0] = None
        if v and i % 41 == 0:
            v[-1] = float("nan")
        if v and i % 43 == 0:
            v[-1] = float("-inf")
        # A hundred rows of one vector: ties.
        v = [0.5, -0.25, 1.0] if 100 < i < 200 else v
        rows.append((None if i == 333 else i - 20, None if i % 29 == 0 else int(chance.integers(3)), None if i % 53 == 0 else v))
    return [*rows, rows[140], rows[140], (5000, 1, [3000.0, -3000.0, 2.5])]


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, vectors, monkeypatch, small):
    """Also in many small blocks and cells."""
    if small:
        for name, value in (("BLOCK_ROWS", 50), ("BLOCK_ANCHORS", 3), ("CELL_ROW_BLOCKS", 2), ("CELL_ANCHOR_BLOCKS", 2)):
            monkeypatch.setattr(negatives, name, value)
    df = spark.createDataFrame([(*r, 7, 8) for r in vectors], "vec_id long, label int, embedding array<double>, id int, rank int")
    assert sorted(tuple(r) for r in negatives.hard_negatives(df).collect()) == mined(vectors)
    assert negatives.hard_negatives(df.limit(0)).collect() == []


def test_scores_by_lookups():
    chance = np.random.default_rng(5)
    for dims, most in ((1, 1), (8, 2), (13, 1 << 20), (64, 300)):
        rows, anchors = (chance.integers(-most, most, (40, dims)) for _ in range(2))
        got = negatives.scores(negatives.bit_planes(rows), negatives.subset_sums(anchors))
        assert (got == rows @ anchors.T).all()


@pytest.fixture(scope="module")
def documents(spark):
    chance = random.Random(6)
    texts = [None, "", " ", "a", "<|endoftext|> it's\r\n\n\x1c\x85\xa0 漢字 🎉", "word " * 2047, "word " * 2048, "word " * 9000]
    texts += ["x1 " * chance.choice([3, 40, 300, 400, 600, 700, 900]) for _ in range(400)]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)]
    rows += [rows[30]] * 20 + [(None, "no id", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, id int, length int")


def library():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("limits, over", [({}, 1.01), ({"partition_ids": 20_000}, 1.05)])
def test_pieces_are_whole_and_sequences_gapless(documents, limits, over):
    """Partitions of ten sequences lose more than those of two thousand."""
    encode = library()
    rows = repacking.repack(documents, RANK_FILE, public_tokenizers.PATTERN, **limits).collect()
    expected = Counter()
    for r in documents.collect():
        ids = np.array([*encode(r["text"]), 0], "<u4")
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            expected[r["doc_id"], piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    least = repacking.lower_bound(np.bincount([r["length"] for r in rows], minlength=2049), 2048)
    assert least <= len(sequences) <= over * least + 1


def test_packing_of_no_rows(documents):
    assert repacking.repack(documents.limit(0), RANK_FILE, public_tokenizers.PATTERN).collect() == []


def test_sequences_have_the_ids(spark, documents, folder):
    repacking.token_pieces(documents, RANK_FILE, public_tokenizers.PATTERN).write.parquet(f"{folder}/pieces")
    pieces = spark.read.parquet(f"{folder}/pieces")
    placed = repacking.place(pieces.withColumn("ids_crc32", F.crc32("ids")))
    found = [r for r in repacking.sequences(pieces, placed).collect()]
    parts = Counter(zlib.crc32(bytes(r["ids"][4 * a : 4 * b])) for r in found for a, b in zip([0, *r["segment_ends"]], r["segment_ends"], strict=False))
    assert parts == Counter(r["ids_crc32"] for r in placed.collect())


def test_exchanged_texts_save_sequences(spark):
    """Partitions of 20 sequences, of sizes that leave gaps: with exchanges they come near one partition's result."""
    chance = random.Random(8)
    rows = [(i, 0, 0, chance.choice([90, 130, 210, 333, 401, 512, 590]), 0, i) for i in range(6000)]
    pieces = spark.createDataFrame(rows, "id long, piece int, start long, length int, ids_crc32 long, piece_no long")
    alone = repacking.place(pieces, 1000, partition_ids=1 << 40)
    apart = repacking.place(pieces, 1000, partition_ids=20_000)
    count = lambda df: df.select("sequence_id").distinct().count()
    least = repacking.lower_bound(np.bincount([r[3] for r in rows], minlength=1001), 1000)
    assert least <= count(alone) <= 1.03 * least
    assert count(apart) <= 1.02 * count(alone)


def fewest(sizes, room):
    """Exhaustive."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i]:
                put(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        put(i + 1, [*rooms, room - sizes[i]])

    put(0, [])
    return best


def test_bound_never_passes_the_optimum():
    chance = random.Random(9)
    tight = 0
    for _ in range(300):
        room = chance.choice([5, 7, 10, 12, 20, 30])
        sizes = [chance.randint(1, room) for _ in range(chance.randrange(8))]
        best, bound = fewest(sizes, room), repacking.lower_bound(np.bincount(sizes, minlength=room + 1).astype(int), room)
        assert bound <= best
        tight += bound == best
    assert tight > 290


def test_library_and_rank_encoder_agree():
    chance, encode = random.Random(5), library()
    own = packing.encoding(RANK_FILE, public_tokenizers.PATTERN)
    parts = ["a", "the", "It's", "I'll", "42", "!", "...", " ", " ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "漢字", "é", "🎉", "<|endoftext|>", "'s", "_"]
    for _ in range(3000):
        text = "".join(chance.choice(parts) for _ in range(chance.randrange(14)))
        assert own.encode_to_numpy(text, disallowed_special=()).tolist() == encode(text)
