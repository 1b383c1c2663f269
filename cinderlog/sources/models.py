"""Fitted models on disk: immutable versions and a log of published ones."""

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.operators.explain import Explainer
from cinderlog.operators.features import LAYERED_NUMERIC, SERVED_NUMERIC, Vocabulary
from cinderlog.operators.forest import ForestTable
from cinderlog.operators.iforest import IsolationForestModel
from cinderlog.operators.scorer import share_models
from cinderlog.sources import commits

NUMERIC = {"served": SERVED_NUMERIC, "layered": LAYERED_NUMERIC}


class ModelNotFound(LookupError):
    """A dataset has no published model, or a version lacks a part."""


@dataclass
class ModelBundle:
    """Everything that scores the lines of one dataset."""

    dataset: str
    layout: str
    vocabulary: Vocabulary
    iso: IsolationForestModel
    forest: ForestTable
    classes: list[str]
    path: str | None = None
    _explainer: Explainer | None = field(default=None, repr=False)
    _shared: Broadcast | None = field(default=None, repr=False)

    @property
    def names(self) -> list[str]:
        return [*NUMERIC[self.layout], *self.vocabulary.terms]

    def explainer(self, spark: SparkSession) -> Explainer:
        if self._explainer is None:
            self._explainer = Explainer(self.forest, self.names)
        return self._explainer

    def shared(self, spark: SparkSession) -> Broadcast:
        """Both forests on the workers, sent once."""
        if self._shared is None:
            self._shared = share_models(spark, self.iso, self.forest, self.classes)
        return self._shared


def save_bundle(spark: SparkSession, bundle: ModelBundle, path: str) -> ModelBundle:
    bundle.vocabulary.to_frame(spark).write.parquet(f"{path}/vocabulary")
    spark.createDataFrame(bundle.iso.nodes).write.parquet(f"{path}/iso_nodes")
    bundle.forest.to_frame(spark).write.parquet(f"{path}/forest_nodes")
    about = [
        (
            bundle.dataset,
            bundle.layout,
            bundle.vocabulary.documents,
            bundle.iso.sample,
            bundle.iso.size,
            bundle.iso.offset,
            bundle.classes,
        )
    ]
    spark.createDataFrame(
        about,
        "dataset string, layout string, documents long, sample int, size int, "
        "offset double, classes array<string>",
    ).write.parquet(f"{path}/about")
    bundle.path = path
    return bundle


def load_bundle(spark: SparkSession, path: str) -> ModelBundle:
    try:
        about = spark.read.parquet(f"{path}/about").first()
        terms = spark.read.parquet(f"{path}/vocabulary").collect()
        nodes = spark.read.parquet(f"{path}/iso_nodes").orderBy("tree", "node").toPandas()
        forest = ForestTable.from_frame(spark.read.parquet(f"{path}/forest_nodes"), about["size"])
    except AnalysisException as error:
        raise ModelNotFound(f"no complete model at {path}") from error
    return ModelBundle(
        about["dataset"],
        about["layout"],
        Vocabulary.from_rows(terms, about["documents"]),
        IsolationForestModel(nodes, about["sample"], about["size"], about["offset"]),
        forest,
        list(about["classes"]),
        path,
    )


def published_versions(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, sequence, version, published_at) of all published versions.

    Numbers are taken by creating an entry that must not exist, so no two publishers share one and
    clocks decide nothing; ``published_at`` is only told.
    """
    said = F.from_json("value", "version string, published_at timestamp")
    return commits.entries(spark, f"{root}/published/*").select(
        F.col("log").alias("dataset"), "sequence", said["version"].alias("version"), said["published_at"].alias("published_at")
    )


def current_version(spark: SparkSession, root: str, dataset: str) -> str | None:
    row = (
        published_versions(spark, root)
        .where(F.col("dataset") == dataset)
        .agg(F.max_by("version", "sequence").alias("version"))
        .first()
    )
    return row["version"]


def point_to(spark: SparkSession, root: str, dataset: str, version: str) -> int:
    """Make a stored version the current one, under the next free number of its dataset."""
    said = json.dumps({"version": version, "published_at": datetime.now(timezone.utc).isoformat()})
    return commits.commit(spark, f"{root}/published/{quote(dataset, safe='')}", said)


def version_path(root: str, dataset: str, version: str) -> str:
    return f"{root}/{dataset}/version={version}"


def publish(spark: SparkSession, root: str, bundle: ModelBundle) -> str:
    """Store a new version completely, then point to it; older ones stay as backups."""
    version = uuid.uuid4().hex
    save_bundle(spark, bundle, version_path(root, bundle.dataset, version))
    point_to(spark, root, bundle.dataset, version)
    return version


def load_current(spark: SparkSession, root: str, dataset: str) -> ModelBundle:
    version = current_version(spark, root, dataset)
    if version is None:
        raise ModelNotFound(f"no published model for {dataset} under {root}")
    return load_bundle(spark, version_path(root, dataset, version))


def load_available(
    spark: SparkSession, root: str, datasets: tuple[str, ...] = ("BGL", "HDFS")
) -> dict[str, ModelBundle]:
    """Current models of the datasets that have one."""
    return {
        dataset: load_current(spark, root, dataset)
        for dataset in datasets
        if current_version(spark, root, dataset) is not None
    }
