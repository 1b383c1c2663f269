"""License scan, byte-pair codec, quality rules and shards against brute force, on awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from string import ascii_lowercase

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cinderlog.llm import bpe, licenses, packing, quality, sharding

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AWKWARD = [
    None,
    "",
    " \n\t ",
    "a",
    "Released under the MIT License.\nReleased under the MIT License.",
    "x\nLicensed under the Apache\nLicense, Version 2.0 and cc BY-nc",
    "under the mit license " * 300,
    "é É ÉÀ ß 漢字 🎉 \x1c\x85\xa0 'll 's  two  spaces\n\n  end ",
    "same line\nsame line\nother\n\nsame line",
    "w " * 60,
    "### $$$ %%% word " * 40,
    "=" * 5000 + " " * 3001 + "x" * 2000,
    " ".join(f"word{i}" for i in range(5000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", 1, 2) for i, t in enumerate(AWKWARD)]
    rows += [rows[4], rows[4], (None, "no id here", "en", "s1", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, id int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


@pytest.fixture(scope="module")
def tokens():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK_FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_matches_replayed_merges(tokens):
    codec = bpe.codec(RANK_FILE, public_tokenizers.PATTERN)
    chance = random.Random(5)
    letters = "abcdefgh eiou  \n\t'sétß漢字🎉\x1c\x85\xa0 0123456789.,;:!?#$%THE the in on"
    cases = ["".join(chance.choice(letters) for _ in range(chance.randint(0, 60))) for _ in range(3000)]
    cases += [b"".join(codec.tokens[chance.randrange(50000)] for _ in range(8)).decode("utf8", "replace") for _ in range(1000)]
    cases += ["a" * 5000, " " * 3001 + "x", "=" * 4000 + "\n" * 99, "thethethe" * 500]
    for text in cases:
        ids = codec.encode(text)
        assert ids == tokens.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_codec_query(docs, empty, tokens):
    expected = Counter()
    for key, text in texts(docs):
        ids = tokens.encode_ordinary(text or "")
        expected[key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    got = bpe.round_trip(docs, RANK_FILE, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == expected
    encoded = bpe.encode_texts(docs, RANK_FILE, public_tokenizers.PATTERN)
    decoded = bpe.decode_ids(encoded, RANK_FILE, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], bytes(r["data"])) for r in decoded.collect()) == Counter((k, (t or "").encode()) for k, t in texts(docs))
    assert bpe.round_trip(empty, RANK_FILE, public_tokenizers.PATTERN).count() == 0


def license_row(text):
    text = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    words, places, labels, best = LICENSE_WORD.findall(text), [], set(), 0.0
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += here
        labels |= {label} if here else set()
    base = ",".join(sorted(labels))
    for i in range(len(words)):
        block = set(words[i : i + licenses.block_words()])
        for label, notice in licenses.NOTICES:
            wanted = set(notice.split())
            if len(wanted & block) >= licenses.needed(len(wanted), licenses.CONTAINMENT):
                labels.add(label)
                best = max(best, len(wanted & block) / len(wanted))
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, base, ",".join(sorted(labels)), 1.0 if places else best


def test_licenses(spark, docs, empty):
    notices = [(100 + i, f"Intro.\n{notice}\nMore text here.") for i, (_, notice) in enumerate(licenses.NOTICES)]
    cut = [(200 + i, " ".join(notice.split()[1:])) for i, (_, notice) in enumerate(licenses.NOTICES)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(notices + cut, "doc_id long, text string"))
    expected = Counter((key, *license_row(text)) for key, text in texts(more))
    assert Counter(tuple(r) for r in licenses.scan(more).collect()) == expected
    assert licenses.scan(empty).count() == 0


def test_notices_are_found_however_they_wrap(spark):
    """A few words a line, double-spaced, a word a line, with words between; spread over a long text they are none."""
    rows, expected = [], {}
    for no, (label, notice) in enumerate(licenses.NOTICES):
        words = notice.split()
        for kind, text in enumerate((
            "\n".join(" ".join(words[i : i + 4]) for i in range(0, len(words), 4)),
            "\n\n".join(" ".join(words[i : i + 5]) for i in range(0, len(words), 5)),
            "# " + "\n# ".join(words),
            " ".join(f"{w} zz zz zz" for w in words),
        )):
            rows.append((10 * no + kind, f"Head of it\n{text}\nzz"))
            expected[10 * no + kind] = label if kind < 3 else None
    found = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in found[k] for k, label in expected.items() if label)
    assert all("bsd" not in found[k] and "gpl" not in found[k] for k, label in expected.items() if not label)


def statistics(text):
    text = text or ""
    words, seen, repeated = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows, covered = Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), repeated, len(covered)


def test_quality_statistics(docs, empty):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality.judge(docs).collect()
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in rows) == Counter((k, *statistics(t)) for k, t in texts(docs))
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_outliers_are_rejected_and_others_stay(spark):
    chance = random.Random(2)
    plain = [(i, " ".join("".join(chance.choice("abcdeghi") for _ in range(chance.randint(2, 8))) for _ in range(chance.randint(60, 400)))) for i in range(400)]
    odd = [(1000 + i, " ".join(w + "###" for w in text.split())) for i, text in plain[:40]]
    df = spark.createDataFrame(plain + odd, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert all(kept[i] for i, _ in plain)
    assert not any(kept[i] for i, _ in odd)
    moved = {r["doc_id"]: r["distance"] for r in quality.judge(df.repartition(7)).collect()}
    assert moved == {r["doc_id"]: r["distance"] for r in quality.judge(df).collect()}


def test_every_statistic_can_reject(spark):
    chance = random.Random(3)

    def word(low, high):
        return "".join(chance.choice("abcdeghi") for _ in range(chance.randint(low, high)))

    plain = [(i, " ".join(word(2, 8) for _ in range(chance.randint(60, 400)))) for i in range(400)]
    phrase = " ".join(word(3, 8) for _ in range(8))
    odd = [
        (1000, " ".join(chance.choice(ascii_lowercase) for _ in range(150))),
        (1001, " ".join("https:" + word(30, 40) for _ in range(150))),
        (1002, " ".join(word(3, 8) for _ in range(104)) + f" {phrase}" * 12),
        (1003, " ".join(word(3, 8) + "#" * (i % 10 == 0) for i in range(200))),
        (1004, "\n".join(" ".join(word(3, 8) for _ in range(30)) + "\nab cd" for _ in range(14))),
        (1005, " ".join(word(3, 8) for _ in range(8000))),
    ]
    df = spark.createDataFrame(plain + odd, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    rows = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert [i for i, _ in odd if rows[i]["base_failed"] or rows[i]["kept"]] == []
    assert [i for i, _ in plain if not rows[i]["kept"]] == []


def jump_one(key, shards):
    state, at, after = key % 2**64, 0, 0
    while after < shards:
        at = after
        state = (state * 2862933555777941757 + 1) % 2**64
        after = int((at + 1) * (2.0**31 / ((state >> 33) + 1)))
    return at


def test_jump_hash_moves_into_the_new_shard_only():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    before = sharding.jump(keys, 40)
    assert before.tolist() == [jump_one(int(k), 40) for k in keys]
    after = sharding.jump(keys, 41)
    assert set(after[after != before]) == {40}


def test_shards(docs, empty):
    rows = sharding.assign(docs, 4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in texts(docs)
    )
    for shard in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["law"] == "key" and r["grown_shard"] in (r["shard"], 4) for r in rows)
    assert sharding.assign(empty, 4).count() == 0


def test_a_repeated_row_spreads_over_slots(spark):
    rows = spark.createDataFrame([(None, "same")] * 500 + [(5, "x")] * 500, "doc_id long, text string")
    found = sharding.assign(rows.withColumn("both_shards", F.lit(0)), 4, chunks=16).collect()
    assert len({(r["doc_id"], r["shard"]) for r in found}) == 2
    for key in (None, 5):
        same = [r["shard"] for r in found if r["doc_id"] == key]
        assert len(same) == 500
    for shard in {r["shard"] for r in found}:
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_long_pieces_are_not_remembered():
    seen = bpe.Memo(len, 10, longest=3)
    assert [seen[x] for x in ("ab", "abcd", "abc")] == [2, 4, 3] and set(seen) == {"ab", "abc"}


def test_best_fit_takes_the_least_room():
    chance = random.Random(3)
    for _ in range(200):
        length = chance.randint(1, 40)
        sizes = [chance.randint(1, length) for _ in range(chance.randint(0, 60))]
        rooms = []
        for size in sorted(sizes, reverse=True):
            fitting = [r for r in rooms if r >= size]
            room = min(fitting) if fitting else length
            if fitting:
                rooms.remove(room)
            rooms.append(room - size)
        rows = packing.best_fit(sizes, length)
        assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in row) for row in rows) == sorted(rooms)


def test_packed_rows_hold_every_id_once(docs, empty, tokens, folder):
    packed = packing.pack(docs, RANK_FILE, public_tokenizers.PATTERN, 50256, length=64)
    pieces = packing.unpack(packed).collect()
    got = Counter()
    for r in pieces:
        got[r["id"], r["start"], tuple(r["piece"])] += 1
    expected = Counter()
    for key, text in texts(docs):
        if ids := tokens.encode_ordinary(text or ""):
            ids.append(50256)
            for at in range(0, len(ids), 64):
                expected[key, at, tuple(ids[at : at + 64])] += 1
    assert got == expected
    for r in packed.collect():
        ends = r["segment_ends"]
        assert len(r["input_ids"]) == 64 and ends[-1] == r["n_ids"]
        for a, b in zip(ends, ends[1:], strict=False):
            assert r["position_ids"][a:b] == list(range(b - a))
    packing.write_matrices(packed, f"{folder}/rows")
    stored = packed.sparkSession.read.parquet(f"{folder}/rows").first()
    assert len(np.frombuffer(stored["input_ids"], "<u4")) == 64
    assert packing.pack(empty, RANK_FILE, public_tokenizers.PATTERN, 50256).count() == 0
