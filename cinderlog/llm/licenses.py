"""License scan: fixed phrases, and an exact set-similarity join with license notices.

A text block is a stretch of ``block_words`` consecutive words (the longest notice's number of
words by the containment), wherever lines break; the last ones of a text are shorter.  Every
block counts that starts with a word of some notice: one that starts elsewhere shares no more
than the block from its first such word.  A block matches a notice when it holds at least
``CONTAINMENT`` of the notice's distinct words.  The join is exact and looks at few pairs:

* words are ordered by how many documents hold them, rarest first;
* prefix filter: of a notice with ``size`` words that needs ``need`` of them, a matching
  block shares one of the first ``size - need + 1``, and the block's own first
  ``held - need + 1`` words hold one of those;
* length filter: the block holds at least ``need`` words of any notice;
* positional filter: the words after the shared one, on either side, must still suffice.

Only words that occur in notices can be shared, so only those are kept of a block, and
only of documents that hold enough of one notice somewhere.

Definitions: a null text is the empty text (no words, no labels, score 0); repeated rows
are scanned each on its own; an empty table gives an empty table.  Only the named id and
text columns are read, so further columns can't clash with the results.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.sources.staging import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count wherever their words stand consecutively.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Wordings of public license notices, with their labels.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "this work is licensed under a creative commons attribution license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form without prior written permission"),
)

CONTAINMENT = 0.85


def normalised(text: Column) -> Column:
    """Words of a text in lower case (A-Z only), each with one space before and one after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NO_WORD, " ")), F.lit(" "))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _held(words: Column, values: list[str]) -> Column:
    """The given values that occur among the words, in the given order."""
    return F.array_intersect(_strings(values), words)


def needed(size: int, containment: float) -> int:
    return math.ceil(round(containment * size, 9))


def block_words(notices=NOTICES, containment: float = CONTAINMENT) -> int:
    """Words of a block: as many as the longest notice has, with as many others as the containment lets in."""
    return math.ceil(round(max(len(words.split()) for _, words in notices) / containment, 9))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", notices=NOTICES, containment: float = CONTAINMENT) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row."""
    spark = df.sparkSession
    sets = [(label, sorted(set(words.split()))) for label, words in notices]
    vocabulary = sorted({w for _, words in sets for w in words})
    held = _described(df, key, text, sets, vocabulary, containment)
    span = block_words(notices, containment)
    held = materialize(held, "licenses")

    # How many documents hold each word: a table as long as the notices' vocabulary at most.
    counts = {r["word"]: r["n"] for r in held.select(F.explode("doc_words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    index, needs = [], []
    for no, (label, words) in enumerate(sets):
        words = sorted(words, key=rank.get)
        need = needed(len(words), containment)
        needs.append(need)
        index += [(w, no, label, at, len(words), need, words) for at, w in enumerate(words[: len(words) - need + 1])]
    schema = "word string, notice int, label string, at int, size int, need int, words array<string>"
    prefixes = spark.createDataFrame(index, schema)

    blocks = held.where(F.col("places").isNotNull()).select("row", F.posexplode(_blocks(F.col("places"), span, min(needs))).alias("block", "words"))
    blocks = blocks.select("row", "block", _held(F.col("words"), order).alias("own"))
    first = F.slice("own", 1, F.size("own") - min(needs) + 1)
    probes = blocks.select("row", "block", "own", F.posexplode(first).alias("own_at", "word"))
    size, rest = F.size("own"), F.least(F.col("size") - F.col("at"), F.size("own") - F.col("own_at"))
    pairs = probes.join(F.broadcast(prefixes), "word").where(
        (size >= F.col("need")) & (F.col("own_at") <= size - F.col("need")) & (rest >= F.col("need"))
    )
    shared = F.size(F.array_intersect("own", "words"))
    matches = (
        pairs.withColumn("shared", shared)
        .where(F.col("shared") >= F.col("need"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("label")).alias("more"), F.max(F.col("shared") / F.col("size")).alias("best"))
    )
    labels = F.array_sort(F.array_union(F.col("base"), F.coalesce("more", F.array().cast("array<string>"))))
    return held.join(matches, "row", "left").select(
        F.col("id").alias(key),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _blocks(places: Column, span: int, least: int) -> Column:
    """The distinct notice words of each block with at least so many; places are (word number, word) in order."""

    def block(i):
        start = F.get(places, i - 1)["at"]
        near = F.filter(F.slice(places, i, span), lambda x: x["at"] < start + span)
        return F.array_distinct(F.transform(near, lambda x: x["word"]))

    return F.filter(F.transform(F.sequence(F.lit(1), F.size(places)), block), lambda words: F.size(words) >= least)


def _described(df: DataFrame, key: str, text: str, sets, vocabulary: list[str], containment: float) -> DataFrame:
    """One row for every input row: phrase places, and the notices' words that it holds."""
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", normalised(F.col("text")).alias("flat"))
    flat = F.col("flat")
    spaces = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    n_words = F.when(F.trim(flat) == "", F.lit(0)).otherwise(spaces - 1).cast("long")

    def places(w: Column, phrase: str) -> Column:
        parts = phrase.split()
        starts = F.sequence(F.lit(0), F.size(w) - 1)

        def here(i):
            same = F.get(w, i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                same = same & (F.get(w, i + k) == part)
            return F.coalesce(same, F.lit(False))

        return F.filter(starts, here)

    found = [flat.contains(f" {phrase} ") for phrase, _ in PHRASES]
    any_found = found[0] | found[1] | found[2]
    words = F.split(F.trim(flat), " ")
    listed = F.transform(F.array(words), lambda w: F.flatten(F.array(*[places(w, phrase) for phrase, _ in PHRASES])))[0]
    hits = F.when(any_found, listed)
    base = F.array_compact(F.array(*[F.when(f, F.lit(label)) for f, (_, label) in zip(found, PHRASES, strict=True)]))
    doc_words = _held(words, vocabulary)

    # A document without enough of any notice's words has no block with enough of them.
    def enough(held: Column) -> Column:
        tests = [F.size(F.array_intersect(held, _strings(w))) >= needed(len(w), containment) for _, w in sets]
        return F.exists(F.array(*tests), lambda x: x)

    rows = rows.select("id", "flat", n_words.alias("n_words"), hits.alias("hits"), F.array_sort(F.array_distinct(base)).alias("base"), doc_words.alias("doc_words"))
    held = F.col("doc_words")
    least = min(needed(len(w), containment) for _, w in sets)
    numbered = F.transform(F.split(F.trim("flat"), " "), lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    notice_words = F.filter(numbered, lambda x: x["word"].isin(vocabulary))
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "n_words",
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("hits").cast("long").alias("first_word"),
        F.array_max("hits").cast("long").alias("last_word"),
        "base",
        "doc_words",
        F.when((F.size(held) >= least) & enough(held), notice_words).alias("places"),
    )
