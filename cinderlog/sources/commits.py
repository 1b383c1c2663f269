"""Numbered entries that are created only if absent: an order of commits without clocks or locks."""

import os
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "log string, sequence long, value string"
DIGITS = 12


def entries(spark: SparkSession, *folders: str) -> DataFrame:
    """(log, sequence, value) of all entries of log folders; patterns may name several.

    An entry without content belongs to a writer that is still at it, or died: its number is
    taken, but it says nothing.
    """
    try:
        files = spark.read.option("wholetext", "true").text(list(folders))
    except AnalysisException:
        return spark.createDataFrame([], ENTRY)
    path = F.split(F.col("_metadata.file_path"), "/")
    name = F.element_at(path, -1)
    # File paths are shown percent-encoded, and so are folder names themselves.
    log = F.url_decode(F.url_decode(F.element_at(path, -2)))
    rows = files.where(name.rlike(f"^[0-9]{{{DIGITS}}}$") & (F.col("value") != ""))
    return rows.select(log.alias("log"), name.cast("long").alias("sequence"), "value")


def head(spark: SparkSession, folder: str) -> int:
    """The last number taken, whether its entry has content yet or not; 0 for none."""
    fs, place = _file_system(spark, folder)
    if not fs.exists(place):
        return 0
    names = [status.getPath().getName() for status in fs.listStatus(place)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def try_commit(spark: SparkSession, folder: str, sequence: int, value: str) -> bool:
    """Create one entry; False, and nothing is changed, if that number is taken."""
    path = f"{folder}/{sequence:0{DIGITS}d}"
    if re.match("(file:)?/", path):
        return _create_locally(re.sub("^file:/+", "/", path), value)
    fs, place = _file_system(spark, path)
    try:
        # Atomic where the store has an order of its own (HDFS, conditional puts of object stores).
        stream = fs.create(place, False)
    except Exception as taken:
        if fs.exists(place):
            return False
        raise taken
    stream.write(bytearray(value.encode()))
    stream.close()
    return True


def commit(spark: SparkSession, folder: str, value: str) -> int:
    """Append an entry under the next free number, and return that."""
    sequence = head(spark, folder) + 1
    while not try_commit(spark, folder, sequence, value):
        sequence += 1
    return sequence


def _create_locally(path: str, value: str) -> bool:
    """A link to a finished file: it appears whole, or not at all if the name is taken."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    draft = os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}")
    with open(draft, "w", encoding="utf-8") as out:
        out.write(value)
    try:
        os.link(draft, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(draft)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place
