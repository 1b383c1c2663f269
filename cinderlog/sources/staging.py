"""Tables that cut a plan: written once to shared storage, then read back."""

import tempfile
import threading
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder the cluster names for checkpoints; local sessions get one of their own."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {SETTING} to a folder that every executor can reach")
    return _own_folder(spark.sparkContext.applicationId)


@lru_cache(maxsize=None)
def _own_folder(application: str) -> str:
    """One folder for each local application; a single process reads and writes it."""
    return tempfile.mkdtemp(prefix="cinderlog-")


def new_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    return f"{(folder or shared_folder(spark)).rstrip('/')}/cinderlog/{name}-{uuid.uuid4().hex}"


#: Tables to be removed, by thread: jobs that run side by side have their own.
_open = threading.local()


def _scratch() -> list[list[str]]:
    if not hasattr(_open, "tables"):
        _open.tables = []
    return _open.tables


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside are removed at the end, but for those stored with ``keep``: these go with the scratch around it, if any.

    For steps whose result is stored itself: nothing that is read later may rest on the others.
    """
    _scratch().append([])
    try:
        yield
    finally:
        for path in _scratch().pop():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(
    df: DataFrame, name: str, *partition_by: str, folder: str | None = None, keep: bool = False, **options: str
) -> DataFrame:
    """The rows as a stored table: lost executors cost a re-read, not a re-run.

    Inside :func:`scratch` the table goes with it, or with the one around that if ``keep`` is set.
    """
    spark = df.sparkSession
    path = new_path(spark, name, folder)
    around = _scratch()[: len(_scratch()) - 1] if keep else _scratch()
    if around:
        around[-1].append(path)
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
