"""Closing the loop: approved corrections and a baseline sample refit the models."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.functions import text
from cinderlog.operators import prep
from cinderlog.plans.training import train_rows
from cinderlog.sources.models import ModelNotFound, current_version, load_current, publish
from cinderlog.sources.training import fill_baseline

DATASETS = ("BGL", "HDFS")

RESULT = (
    "dataset string, success boolean, skipped boolean, corrections_used long, "
    "new_f1_score double, version string, previous_version string, reason string"
)


def group_corrections(corrections: DataFrame) -> DataFrame:
    """Add the dataset whose model a correction belongs to."""
    return corrections.withColumn("dataset", text.route_correction(F.col("raw_log")))


def _row_key(origin: str, key: Sequence[str]) -> Column:
    return F.concat_ws("-", F.lit(origin), *[F.col(k).cast("string") for k in key])


def training_frame(
    corrections: DataFrame,
    baseline: DataFrame | None,
    correction_key: Sequence[str],
    baseline_key: Sequence[str],
    base_rows: int = prep.BASELINE_ROWS,
    seed: int = prep.SEED,
) -> DataFrame:
    """Baseline sample and corrections of one dataset, identified by ``row_key``."""
    sampled = None
    if baseline is not None:
        picked = prep.sample_rows(baseline, *baseline_key, n=base_rows, seed=seed)
        sampled = fill_baseline(
            picked.withColumn("row_key", _row_key("baseline", baseline_key)), "row_key"
        )
    extra = prep.correction_rows(corrections).withColumn(
        "row_key", _row_key("correction", correction_key)
    )
    return prep.combine_training(sampled, extra, "row_key")


def retrain(
    spark: SparkSession,
    root: str,
    corrections: DataFrame,
    baselines: dict[str, DataFrame],
    correction_key: Sequence[str],
    baseline_key: Sequence[str],
    base_rows: int = prep.BASELINE_ROWS,
    seed: int = prep.SEED,
    **settings,
) -> DataFrame:
    """Refit and publish a new version of every dataset with corrections.

    The vocabulary is kept.  A dataset whose fit fails keeps its published
    version; its row in the result says why.
    """
    grouped = group_corrections(corrections)
    used = {r["dataset"]: r["count"] for r in grouped.groupBy("dataset").count().collect()}
    results = []
    for dataset in DATASETS:
        count = used.get(dataset, 0)
        if count == 0:
            continue
        previous = current_version(spark, root, dataset)
        try:
            bundle = load_current(spark, root, dataset)
        except ModelNotFound:
            results.append((dataset, False, True, count, None, None, None, "model not loaded"))
            continue
        try:
            rows = training_frame(
                grouped.where(F.col("dataset") == dataset),
                baselines.get(dataset),
                correction_key,
                baseline_key,
                base_rows,
                seed,
            )
            fitted, report = train_rows(
                rows, dataset, "row_key", vocabulary=bundle.vocabulary, seed=seed, **settings
            )
            f1 = report.where(F.col("class") == "weighted avg").first()["f1"]
            version = publish(spark, root, fitted)
            results.append(
                (dataset, True, False, count, round(float(f1), 4), version, previous, None)
            )
        except Exception as error:
            results.append((dataset, False, False, count, None, None, previous, str(error)))
    return spark.createDataFrame(results, RESULT)


def retrain_status(results: DataFrame) -> DataFrame:
    """One row: ok when any dataset was refitted."""
    any_success = F.coalesce(F.bool_or("success"), F.lit(False))
    return results.agg(
        F.when(any_success, "ok").otherwise("partial_failure").alias("status"),
        F.coalesce(F.sum("corrections_used"), F.lit(0)).alias("total_input"),
    )
