"""The training table on disk, and reading one back with missing columns filled."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.schemas import NORMAL

# What a missing column of a baseline becomes.
BASELINE_DEFAULTS = {"level": "INFO", "message": "-1", "label": NORMAL, "hour": -1}
BASELINE_TYPES = {"level": "string", "message": "string", "label": "string", "hour": "int"}


def write_training_rows(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Training rows as parquet, one directory per dataset."""
    rows.write.mode(mode).partitionBy("dataset").parquet(path)


def write_training_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def fill_baseline(rows: DataFrame, *keep: str) -> DataFrame:
    """``level, message, label, hour`` of a baseline, absent columns defaulted."""
    return rows.select(
        *keep,
        *[
            (F.col(name) if name in rows.columns else F.lit(default))
            .cast(BASELINE_TYPES[name])
            .alias(name)
            for name, default in BASELINE_DEFAULTS.items()
        ],
    )


def read_baseline(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Baseline rows of one dataset; the other datasets' directories are pruned."""
    return spark.read.parquet(path).where(F.col("dataset") == dataset)
