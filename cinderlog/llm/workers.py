"""Lets Python workers import this library from where the driver has it."""

import os
from functools import wraps

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark: SparkSession) -> None:
    """Add the driver's copy to the workers' path; on a cluster where it isn't there, the installed one is used."""
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def with_workers(run):
    """A query or stage that sees to it first."""

    @wraps(run)
    def started(spark: SparkSession, *rest):
        reachable(spark)
        return run(spark, *rest)

    return started
