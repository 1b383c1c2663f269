"""Feature engineering: TF-IDF of 1- and 2-grams, time features, row layouts.

A row's features are a struct ``{size, indices, values}`` in the form of a sparse
vector, so expressions and Arrow functions can read it; :func:`as_vector` turns it
into an MLlib vector where an MLlib model needs one.
"""

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.functions import text
from cinderlog.functions.ordering import CHUNK, RowOrder
from cinderlog.functions.regex import py
from cinderlog.sources.staging import materialize

# The token pattern (greedy, so it needs no word borders), vocabulary sizes and numeric feature names.
TOKEN = r"\w\w+"
TRAINER_TERMS = 1000
CLASS_TERMS = 100
SERVED_NUMERIC = ("level_encoded", "log_hour")
LAYERED_NUMERIC = ("level_encoded", "time_delta_sec", "hour")
MAX_DELTA_SECONDS = 3600.0

# Words that are listed to spare pairs, as a multiple of the vocabulary's size.
LISTED_WORDS = 4

VECTOR_JSON = T.StructType([T.StructField("v", VectorUDT())])


def tokens(message: Column) -> Column:
    lowered = F.lower(F.coalesce(message, F.lit("")))
    return F.regexp_extract_all(lowered, F.lit(py(TOKEN)), F.lit(0))


def with_bigrams(words: Column) -> Column:
    """The words followed by every pair of neighbours."""
    n = F.size(words)
    pairs = F.zip_with(
        F.slice(words, 1, n - 1),
        F.slice(words, 2, n - 1),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.when(n > 1, F.concat(words, pairs)).otherwise(words)


def ngrams(df: DataFrame, message: str, name: str = "__grams") -> DataFrame:
    worded = df.withColumn("__words", tokens(F.col(message)))
    return worded.withColumn(name, with_bigrams(F.col("__words"))).drop("__words")


@dataclass(frozen=True)
class Vocabulary:
    """Fitted terms in index order, with document counts and idf weights."""

    terms: tuple[str, ...]
    doc_counts: tuple[int, ...]
    documents: int

    @property
    def idf(self) -> tuple[float, ...]:
        return tuple(
            math.log((1 + self.documents) / (1 + df)) + 1.0 for df in self.doc_counts
        )

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, *row) for i, row in enumerate(zip(self.terms, self.doc_counts, self.idf))
        ]
        return spark.createDataFrame(rows, "idx int, term string, df long, idf double")

    @staticmethod
    def from_rows(rows, documents: int) -> "Vocabulary":
        ordered = sorted(rows, key=lambda r: r["term"].encode())
        return Vocabulary(
            tuple(r["term"] for r in ordered),
            tuple(int(r["df"]) for r in ordered),
            documents,
        )


def word_counts(worded: DataFrame, words: str = "__words") -> DataFrame:
    return (
        worded.select(F.explode(words).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def frequent_words(counts: DataFrame, max_features: int) -> list[str] | None:
    """Words that a term of the vocabulary can hold, or NULL for "any".

    A pair of words is never more frequent than either word.  So once
    ``max_features`` words reach some count, no term below that count is kept,
    and a pair with a rarer word need not even be built.  The list only saves work: pairs with rarer
    words never reach the vocabulary.  So where too many words tie with the last one to be
    listed, every pair is counted, and nothing is listed.
    """
    top = counts.orderBy(F.desc("tf"), "term").limit(max_features).collect()
    if len(top) < max_features:
        return None
    most = LISTED_WORDS * max_features
    reached = counts.where(F.col("tf") >= top[-1]["tf"]).select("term").limit(most + 1).collect()
    return [r["term"] for r in reached] if len(reached) <= most else None


def pair_counts(worded: DataFrame, frequent: list[str] | None, words: str = "__words") -> DataFrame:
    """Counts of neighbouring words, both of them frequent."""
    kept = F.col(words)
    if frequent is not None:
        kept = F.transform(kept, lambda w: F.when(w.isin(*frequent), w))
    n = F.size("__kept")
    pairs = F.zip_with(
        F.slice("__kept", 1, F.greatest(n - 1, F.lit(0))),
        F.slice("__kept", 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return (
        worded.select(kept.alias("__kept"))
        .select(F.explode(F.array_compact(pairs)).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def document_counts(
    df: DataFrame, terms: list[str], message: str = "message"
) -> tuple[list[int], int]:
    """Documents holding each term, and documents in all, in one pass."""
    counter = CountVectorizerModel.from_vocabulary(
        terms, inputCol="__grams", outputCol="__counts"
    )
    found = F.unwrap_udt("__counts")["indices"]
    rows = (
        counter.transform(ngrams(df.select(message), message))
        .select(F.explode(F.concat(found, F.array(F.lit(-1)))).alias("idx"))
        .groupBy("idx")
        .count()
        .collect()
    )
    counts = {r["idx"]: r["count"] for r in rows}
    return [counts.get(i, 0) for i in range(len(terms))], counts.get(-1, 0)


def fit_vocabulary(
    df: DataFrame, message: str = "message", max_features: int = TRAINER_TERMS
) -> Vocabulary:
    """Most frequent terms of a corpus; at equal counts the smaller term wins.

    Three passes with map-side combine: words, pairs of frequent words, document
    counts of the chosen terms.  Only the first has as many groups as there are
    words; pairs are bounded by the square of the frequent words.
    """
    worded = df.select(tokens(F.col(message)).alias("__words"))
    # Read three times below.
    words = materialize(word_counts(worded), "word-counts")
    pairs = pair_counts(worded, frequent_words(words, max_features))
    top = (
        words.unionByName(pairs)
        .orderBy(F.desc("tf"), "term")
        .limit(max_features)
        .collect()
    )
    if not top:
        raise ValueError("no message holds a word: the vocabulary is empty")
    terms = sorted((r["term"] for r in top), key=str.encode)
    doc_counts, documents = document_counts(df, terms, message)
    return Vocabulary(tuple(terms), tuple(doc_counts), documents)


def tfidf(df: DataFrame, vocabulary: Vocabulary, message: str = "message") -> DataFrame:
    """Add ``tfidf {indices, values}``: sublinear tf, idf, unit length.

    Everything stays in the row: no explode, no join, no shuffle.
    """
    counter = CountVectorizerModel.from_vocabulary(
        list(vocabulary.terms), inputCol="__grams", outputCol="__counts"
    )
    idf = F.lit(np.array(vocabulary.idf))
    counted = counter.transform(ngrams(df, message)).withColumn(
        "__c", F.unwrap_udt("__counts")
    )
    weighted = counted.withColumn(
        "__w",
        F.zip_with(
            "__c.indices",
            "__c.values",
            lambda i, tf: (F.lit(1.0) + F.ln(tf)) * idf[i],
        ),
    )
    # Inside a lambda the norm would be summed up anew for every element.
    length = F.sqrt(F.aggregate("__w", F.lit(0.0), lambda acc, w: acc + w * w))
    lengths = F.array_repeat(length, F.size("__w"))
    return weighted.withColumn(
        "tfidf",
        F.struct(
            F.col("__c.indices").alias("indices"),
            F.zip_with("__w", lengths, lambda w, n: w / n).alias("values"),
        ),
    ).drop("__grams", "__counts", "__c", "__w")


def tfidf_entries(
    df: DataFrame, vocabulary: Vocabulary, *key: str, message: str = "message"
) -> DataFrame:
    """TF-IDF in tidy form: one row per (key, term index)."""
    entries = F.arrays_zip("tfidf.indices", "tfidf.values")
    return (
        tfidf(df.select(*key, message), vocabulary, message)
        .select(*key, F.explode(entries).alias("e"))
        .select(*key, F.col("e.indices").alias("idx"), F.col("e.values").alias("weight"))
    )


def _assemble(
    df: DataFrame, vocabulary: Vocabulary, numeric: list[Column], message: str
) -> DataFrame:
    shift = len(numeric)
    return (
        tfidf(df, vocabulary, message)
        .withColumn(
            "features",
            F.struct(
                F.lit(shift + len(vocabulary.terms)).alias("size"),
                F.concat(
                    F.array(*[F.lit(i) for i in range(shift)]),
                    F.transform("tfidf.indices", lambda i: i + F.lit(shift)),
                ).alias("indices"),
                F.concat(
                    F.array(*[c.cast("double") for c in numeric]), F.col("tfidf.values")
                ).alias("values"),
            ),
        )
        .drop("tfidf")
    )


def served_features(
    df: DataFrame, vocabulary: Vocabulary, message: str = "message"
) -> DataFrame:
    """Layout ``[level_code, hour/23, tfidf...]`` from ``level`` and ``hour``."""
    numeric = [text.level_code(F.col("level")), text.scale_hour(F.col("hour"))]
    return _assemble(df, vocabulary, numeric, message)


def layered_features(
    df: DataFrame, vocabulary: Vocabulary, message: str = "message"
) -> DataFrame:
    """Layout ``[level_code, time_delta, ts_hour, tfidf...]``."""
    numeric = [text.level_code(F.col("level")), F.col("time_delta"), F.col("ts_hour")]
    return _assemble(df, vocabulary, numeric, message)


def as_vector(features: Column) -> Column:
    """MLlib vector of a feature struct.

    Spark has no expression from arrays to a sparse vector; reading the vector
    type from JSON keeps the step on the JVM, and doubles survive it exactly.
    """
    body = F.struct(
        F.struct(
            F.lit(0).alias("type"),
            features["size"].alias("size"),
            features["indices"].alias("indices"),
            features["values"].alias("values"),
        ).alias("v")
    )
    return F.from_json(F.to_json(body), VECTOR_JSON)["v"]


def feature_names(
    spark: SparkSession, vocabulary: Vocabulary, numeric: tuple[str, ...] = SERVED_NUMERIC
) -> DataFrame:
    names = [*numeric, *vocabulary.terms]
    return spark.createDataFrame(list(enumerate(names)), "idx int, name string")


def time_features(
    df: DataFrame, order: RowOrder, file: str = "file", timestamp: str = "timestamp"
) -> DataFrame:
    """Add ``time_delta`` (0 to 3600 s since the line before) and ``ts_hour``.

    Missing timestamps take the last one before them, leading ones the first in
    the file; a file without any gets zeros.  Windows stay inside one chunk of a
    file: what crosses a chunk border is read from a table of chunk summaries.
    """
    ts = F.col(timestamp)
    placed = df.withColumns({CHUNK: order.chunk, "__within": order.within})
    has_ts = ts.isNotNull()
    chunks = placed.groupBy(file, CHUNK).agg(
        F.max_by(timestamp, F.when(has_ts, F.col("__within"))).alias("__last"),
        F.min_by(timestamp, F.when(has_ts, F.col("__within"))).alias("__first"),
    )
    by_file = Window.partitionBy(file).orderBy(CHUNK)
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borders = chunks.select(
        F.col(file).alias("__file"),
        F.col(CHUNK).alias("__border"),
        F.last("__last", ignorenulls=True).over(before).alias("__carried"),
        F.first("__first", ignorenulls=True).over(everywhere).alias("__head"),
        (F.row_number().over(by_file) == 1).alias("__starts"),
    )
    local = Window.partitionBy(file, CHUNK).orderBy("__within")
    so_far = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        placed.join(
            borders,
            F.col(file).eqNullSafe(F.col("__file"))
            & F.col(CHUNK).eqNullSafe(F.col("__border")),
        )
        .withColumn("__reached", F.coalesce("__carried", "__head"))
        .withColumn(
            "__ts", F.coalesce(F.last(ts, ignorenulls=True).over(so_far), "__reached")
        )
    )
    previous = F.coalesce(
        F.lag("__ts").over(local), F.when(~F.col("__starts"), F.col("__reached"))
    )
    seconds = F.expr("timestampdiff(MICROSECOND, __previous, __ts)") / F.lit(1e6)
    clipped = F.least(F.greatest(seconds, F.lit(0.0)), F.lit(MAX_DELTA_SECONDS))
    return filled.withColumn("__previous", previous).withColumns(
        {
            "time_delta": F.coalesce(clipped, F.lit(0.0)),
            "ts_hour": F.coalesce(F.hour("__ts"), F.lit(0)),
        }
    ).select(*df.columns, "time_delta", "ts_hour")
