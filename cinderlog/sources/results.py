"""Scored lines on disk, by session.

A folder has parts, each written by one append, and a log of commits that names them.  A part
counts once it is committed: readers never see the rest.  An append scores its input once, into
its own part; which sessions it holds is read from there.  It commits under the number after the
last part that it has compared itself with, so of two writers with one session only one succeeds.
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.functions.ordering import RowOrder, number_rows
from cinderlog.sources import commits

BUCKETS = 256
SESSIONS_SHOWN = 5


class SessionStored(ValueError):
    """A session of an append is stored already; its line numbers would occur twice."""


def _bucket(session_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(buckets)).cast("int")


def _log(path: str) -> str:
    return f"{path}/commits"


def _rows(path: str, part: str) -> str:
    return f"{path}/rows/part={part}"


def committed_parts(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, part) of all commits that count, one a write: an overwrite hides what came before it."""
    rows = sorted((r["sequence"], json.loads(r["value"])) for r in commits.entries(spark, _log(path)).collect())
    start = max((n for n, said in rows if said["replaces"]), default=0)
    return [(n, said["part"]) for n, said in rows if n >= start]


def _sessions(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/sessions/{p}" for p in parts])


def write_results(
    scored: DataFrame,
    order: RowOrder,
    path: str,
    mode: str = "append",
    buckets: int = BUCKETS,
) -> int:
    """Store scored lines by session, numbered in line order inside each session; returns the commit's number.

    The dense number turns a page into a range filter that parquet statistics
    can serve, instead of one sort per page request.  Sessions share a bounded
    number of directories; rebalancing splits the ones a big session fills.  An append with a session
    that is stored already raises :class:`SessionStored` and changes nothing; ``overwrite`` hides all
    earlier parts at once.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode is append or overwrite, not {mode}")
    spark, part = scored.sparkSession, uuid.uuid4().hex
    (
        number_rows(scored, order, group=("session_id",))
        .withColumn("bucket", _bucket(F.col("session_id"), buckets))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "session_id", "row_no")
        .write.partitionBy("bucket")
        .parquet(_rows(path, part))
    )
    own = spark.read.parquet(_rows(path, part)).select("session_id").distinct()
    own.write.parquet(f"{path}/sessions/{part}")
    said = json.dumps({"part": part, "replaces": mode == "overwrite"})
    if mode == "overwrite":
        return commits.commit(spark, _log(path), said)
    compared = 0
    while True:
        last = commits.head(spark, _log(path))
        others = [p for n, p in committed_parts(spark, path) if compared < n <= last]
        if others:
            both = _sessions(spark, path, [part]).join(_sessions(spark, path, others), "session_id", "left_semi")
            stored = [r["session_id"] for r in both.orderBy("session_id").limit(SESSIONS_SHOWN).collect()]
            if stored:
                raise SessionStored(f"sessions are stored already: {', '.join(map(str, stored))}")
        compared = last
        if commits.try_commit(spark, _log(path), last + 1, said):
            return last + 1


def read_results(
    spark: SparkSession, path: str, session_id: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Committed results; one session costs one directory of each part, and its row groups."""
    parts = [part for _, part in committed_parts(spark, path)]
    if not parts:
        raise FileNotFoundError(f"nothing is committed under {path}")
    results = spark.read.option("basePath", f"{path}/rows").parquet(*[_rows(path, p) for p in parts])
    if session_id is not None:
        wanted = F.lit(session_id)
        results = results.where(
            (F.col("bucket") == _bucket(wanted, buckets)) & (F.col("session_id") == wanted)
        )
    return results.drop("part", "bucket")
