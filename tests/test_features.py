import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.functions.ordering import column_order
from cinderlog.operators import features

LEVELS = ["INFO", "ERROR", "WARNING", "CRITICAL", "DEBUG"]


def frame(spark, n=100):
    start = datetime.datetime(2025, 1, 20, 10, 0, 0)
    rows = [
        ("f", i, LEVELS[i % 5], f"test message number {i}", start + datetime.timedelta(seconds=i))
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "file string, n int, level string, message string, timestamp timestamp_ntz"
    )


def layered(spark, df, vocabulary):
    timed = features.time_features(df, column_order("n", 30))
    return features.layered_features(timed, vocabulary)


def test_shape(spark):
    df = frame(spark)
    vocabulary = features.fit_vocabulary(df, max_features=50)
    rows = layered(spark, df, vocabulary).collect()
    assert len(vocabulary.terms) == 50
    assert len(rows) == 100 and {r["features"]["size"] for r in rows} == {53}


def test_unseen_level(spark):
    df = frame(spark, 50)
    vocabulary = features.fit_vocabulary(df, max_features=50)
    odd = layered(spark, df.withColumn("level", F.lit("TRACE")), vocabulary).first()
    assert odd["features"]["values"][0] == 4.0


def test_vector_holds_the_same_numbers(spark):
    df = frame(spark, 20)
    vocabulary = features.fit_vocabulary(df, max_features=10)
    rows = layered(spark, df, vocabulary).withColumn(
        "v", features.as_vector(F.col("features"))
    ).collect()
    for r in rows:
        dense = np.zeros(13)
        dense[r["features"]["indices"]] = r["features"]["values"]
        assert np.array_equal(r["v"].toArray(), dense)


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(0, "Alpha alpha beta x"), (1, "beta"), (2, None)], "n int, message string")
    vocabulary = features.fit_vocabulary(df, max_features=10)
    assert vocabulary.documents == 3
    assert vocabulary.terms == ("alpha", "alpha alpha", "alpha beta", "beta")
    weights = {
        (r["n"], vocabulary.terms[r["idx"]]): r["weight"]
        for r in features.tfidf_entries(df, vocabulary, "n").collect()
    }
    rare, common = math.log(4 / 2) + 1, math.log(4 / 3) + 1
    raw = {"alpha": (1 + math.log(2)) * rare, "alpha alpha": rare, "alpha beta": rare, "beta": common}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    for term, weight in raw.items():
        assert weights[(0, term)] == pytest.approx(weight / norm, abs=1e-12)
    assert weights[(1, "beta")] == pytest.approx(1.0)
    assert not [k for k in weights if k[0] == 2]


def test_pruned_vocabulary_equals_the_full_count(spark):
    words = ["red", "green", "blue", "red green", "cyan", "pink", "plum"]
    df = spark.createDataFrame(
        [(i, " ".join(words[(i * k) % 7] for k in range(1, 6))) for i in range(200)], "n int, message string"
    )
    counts = (
        features.ngrams(df, "message")
        .select(F.explode("__grams").alias("t"))
        .groupBy("t")
        .count()
        .collect()
    )
    for size in (1, 3, 5, 8, 100):
        best = sorted(counts, key=lambda r: (-r["count"], r["t"]))[:size]
        fitted = features.fit_vocabulary(df, max_features=size)
        assert list(fitted.terms) == sorted(r["t"] for r in best)


def test_empty_vocabulary(spark):
    with pytest.raises(ValueError):
        features.fit_vocabulary(spark.createDataFrame([("a",), (None,)], "message string"))


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_time_features_across_chunks(spark, chunk):
    base = datetime.datetime(2025, 1, 1, 5, 0, 0)
    seconds = [None, None, 10, None, 5, 10000, None, 10001]
    rows = [
        ("f", i, None if s is None else base + datetime.timedelta(seconds=s))
        for i, s in enumerate(seconds)
    ] + [("empty", i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "file string, n int, timestamp timestamp_ntz")
    got = {
        (r["file"], r["n"]): (r["time_delta"], r["ts_hour"])
        for r in features.time_features(df, column_order("n", chunk)).collect()
    }
    assert [got[("f", i)][0] for i in range(8)] == [0, 0, 0, 0, 0, 3600, 0, 1]
    assert [got[("f", i)][1] for i in range(8)] == [5, 5, 5, 5, 5, 7, 7, 7]
    assert {got[("empty", i)] for i in range(3)} == {(0.0, 0)}


def test_many_words_that_tie_need_no_list(spark, monkeypatch):
    """Thousands of words tie with the last term: none is listed, and the vocabulary stays exact."""
    rows = [(f"alpha beta w{i:05d}x v{i:05d}x",) for i in range(3000)] + [("alpha gamma",)] * 2
    df = spark.createDataFrame(rows, "message string")
    counts = features.word_counts(df.select(features.tokens(F.col("message")).alias("__words")))
    assert features.frequent_words(counts, 6) is None
    fitted = features.fit_vocabulary(df, max_features=6)
    # Counts: alpha 3002, beta and "alpha beta" 3000, gamma and "alpha gamma" 2, then all that occur once.
    assert fitted.terms == ("alpha", "alpha beta", "alpha gamma", "beta", "beta w00000x", "gamma")
    monkeypatch.setattr(features, "LISTED_WORDS", 10_000)
    assert features.fit_vocabulary(df, max_features=6) == fitted
