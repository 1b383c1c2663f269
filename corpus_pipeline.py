"""Raw documents to token ids, in stages that each read what the one before wrote.

Rejected documents go; of near duplicates (five-word shingles, similarity of 0.8 or more) the
one with the smallest id stays; strings of 50 bytes that an earlier document has are cut out;
documents with a benchmark passage go; what is left is encoded, decoded and described.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm import bpe, decontaminate, neardup, quality, suffixes
from cinderlog.llm.workers import with_workers
from cinderlog.sources.staging import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


@with_workers
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have too few words and go; repeated rows are judged each on its own."""
    return quality.keep_good(docs)


@with_workers
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an id and texts without words stay; rows with equal id and text become one."""
    return neardup.keep_one(docs, percent=80)


@with_workers
def own_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts change, and so do their lengths; null texts become empty, rows without an id stay as they are."""
    return suffixes.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


@with_workers
def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts hold no item and stay; repeated rows are judged each on its own."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@with_workers
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left, as digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_documents),
    ("near_duplicates", one_of_each_group),
    ("repeated_strings", own_strings),
    ("benchmark_leaks", clean_of_benchmark),
    ("byte_pair_codec", token_ids),
]

#: The stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
