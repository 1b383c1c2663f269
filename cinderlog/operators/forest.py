"""Random forest on MLlib, with weights, prediction columns and evaluation."""

import statistics
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.functions import kernels
from cinderlog.functions.ordering import hash_order, number_rows
from cinderlog.operators.features import as_vector
from cinderlog.sources.staging import materialize, new_path

cloudpickle.register_pickle_by_value(kernels)

# Forest settings.
TREES = 200
DEPTH = 15
SEED = 42
FOLDS = 5
# Bagging depends on where rows lie, so the layout is a setting, not a matter of size.
PARTITIONS = 64

MAX_CLASSES = 1000

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, shares array<double>"
)


def read_nodes(spark: SparkSession, forest_path: str) -> DataFrame:
    """Node table of a forest that MLlib stored: children, splits and class weights."""
    nodes = spark.read.parquet(f"{forest_path}/data")
    n = F.col("nodeData")
    return nodes.select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        n["leftChild"].alias("left"),
        n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        n["impurityStats"].alias("stats"),
    )


@dataclass
class ForestTable:
    """A fitted forest as its node table, which any engine can walk.

    A row goes left where its value is at most the threshold; leaves have feature -1.  ``shares``
    are a node's class shares, ``cover`` the weight of the rows it was fitted on.  The forest's
    probabilities are the mean of the shares of the leaves that a row reaches.  The table has at
    most ``trees * 2 ** (depth + 1)`` nodes, whatever the size of the data.
    """

    nodes: pd.DataFrame
    size: int
    _flat: dict | None = field(default=None, repr=False, compare=False)

    @staticmethod
    def from_model(spark: SparkSession, model: RandomForestClassificationModel) -> "ForestTable":
        path = new_path(spark, "forest")
        model.write().save(path)
        nodes = read_nodes(spark, path)
        cover = F.aggregate("stats", F.lit(0.0), lambda total, x: total + x)
        inner = F.col("left") >= 0
        table = nodes.withColumn("cover", cover).select(
            "tree",
            "node",
            F.when(inner, F.col("feature")).otherwise(-1).cast("int").alias("feature"),
            F.when(inner, F.col("threshold")).otherwise(0.0).alias("threshold"),
            "left",
            "right",
            F.transform("stats", lambda x: x / F.col("cover")).alias("shares"),
            "cover",
        )
        return ForestTable.from_frame(table, model.numFeatures)

    @staticmethod
    def from_frame(nodes: DataFrame, size: int) -> "ForestTable":
        return ForestTable(nodes.orderBy("tree", "node").toPandas(), size)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.nodes.assign(shares=self.nodes["shares"].map(list)), f"{NODE_SCHEMA}, cover double"
        )

    def flat(self) -> dict:
        """Node arrays for :mod:`kernels`."""
        if self._flat is None:
            n = self.nodes
            columns = [n[c].to_numpy() for c in ("tree", "feature", "threshold", "left", "right")]
            shares = np.stack([np.asarray(x, dtype=float) for x in n["shares"]])
            self._flat = kernels.flat_forest(*columns, shares) | {"size": self.size}
        return self._flat


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` of every class."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    # The second step sees one row per class.
    packed = counts.agg(
        F.sum("rows").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.collect_list(F.struct("label", "rows")).alias("classes"),
    )
    return packed.select("n", "k", F.explode("classes").alias("c")).select(
        F.col("c.label").alias("label"),
        F.col("c.rows").alias("rows"),
        (F.col("n") / (F.col("k") * F.col("c.rows"))).alias("weight"),
    )


def _lookup(column: Column, table: dict) -> Column:
    out = None
    for key, value in table.items():
        out = (F if out is None else out).when(column == key, F.lit(value))
    return out


def fit_forest(
    rows: DataFrame,
    *key: str,
    label: str = "label",
    features: str = "features",
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = SEED,
    partitions: int = PARTITIONS,
) -> tuple[RandomForestClassificationModel, list[str]]:
    """Fitted forest and its classes in index (alphabetical) order.

    Bagging depends on where rows lie, so rows are laid out by key over a fixed
    number of partitions first: the same rows give the same forest.
    """
    weights = class_weights(rows, label).orderBy("label").limit(MAX_CLASSES + 1).collect()
    if not 2 <= len(weights) <= MAX_CLASSES:
        raise ValueError(f"a classifier needs 2 to {MAX_CLASSES} classes, got {len(weights)}")
    classes = [w["label"] for w in weights]
    index = {name: float(i) for i, name in enumerate(classes)}
    balance = {w["label"]: w["weight"] for w in weights}
    frame = (
        rows.select(
            *key,
            as_vector(F.col(features)).alias("vector"),
            _lookup(F.col(label), index).alias("target"),
            _lookup(F.col(label), balance).alias("weight"),
        )
        .repartition(partitions, *key)
        .sortWithinPartitions(*key)
    )
    classifier = RandomForestClassifier(
        featuresCol="vector",
        labelCol="target",
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="sqrt",
        seed=seed,
        maxMemoryInMB=1024,
        cacheNodeIds=False,
    )
    # The fit passes over its input once for splits and again for bagging.
    frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return classifier.fit(frame), classes
    finally:
        frame.unpersist()


def best_class(probabilities: Column, classes: list[str]) -> Column:
    """Most probable class; the first in order when several tie."""
    names = F.array(*[F.lit(c) for c in classes])
    place = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(names, place)


def predict(
    df: DataFrame,
    model: RandomForestClassificationModel | ForestTable,
    classes: list[str],
    features: str = "features",
) -> DataFrame:
    """Add ``rf_class``, ``rf_confidence`` and ``rf_probabilities`` by class; null features have none."""
    spark = df.sparkSession
    table = model if isinstance(model, ForestTable) else ForestTable.from_model(spark, model)
    shared = spark.sparkContext.broadcast(table.flat())

    @F.arrow_udf("array<double>")
    def probabilities(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for indices, values in batches:
            asked = np.flatnonzero(indices.is_valid().to_numpy(zero_copy_only=False))
            means = kernels.mean_leaf_values(indices.take(pa.array(asked)), values.take(pa.array(asked)), shared.value)
            rows = np.empty(len(indices), dtype=object)
            rows[asked] = list(means)
            yield pa.array(rows, pa.list_(pa.float64()))

    # Stops the optimizer from copying the call into pushed-down filters.
    scored = df.withColumn(
        "__p", probabilities.asNondeterministic()(F.col(features)["indices"], F.col(features)["values"])
    )
    return scored.withColumns(
        {
            "rf_class": best_class(F.col("__p"), classes),
            "rf_confidence": F.array_max("__p"),
            "rf_probabilities": F.when(
                F.col("__p").isNotNull(),
                F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), F.col("__p")),
            ),
        }
    ).drop("__p")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def evaluate(rows: DataFrame, label: str = "label", predicted: str = "rf_class") -> DataFrame:
    """Classification report: a row per class, then accuracy and two averages.

    One pass counts (label, prediction) pairs; the rest works on that small table.
    """
    cells = rows.groupBy(F.col(label).alias("truth"), F.col(predicted).alias("guess")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.col("truth") == F.col("guess")
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("truth").alias("class"),
                    F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("guessed"),
                ),
                F.struct(
                    F.col("guess").alias("class"),
                    F.lit(0).cast("long").alias("tp"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("guessed"),
                ),
            )
        ).alias("s")
    )
    per_class = (
        sides.groupBy(F.col("s.class").alias("class"))
        .agg(
            F.sum("s.tp").alias("tp"),
            F.sum("s.support").alias("support"),
            F.sum("s.guessed").alias("guessed"),
        )
        .withColumns(
            {
                "precision": _ratio(F.col("tp"), F.col("guessed")),
                "recall": _ratio(F.col("tp"), F.col("support")),
                "f1": _ratio(2.0 * F.col("tp"), F.col("guessed") + F.col("support")),
            }
        )
    )

    def weighted(metric: str) -> Column:
        return _ratio(F.sum(F.col(metric) * F.col("support")), F.sum("support"))

    metrics = ("precision", "recall", "f1")
    accuracy = _ratio(F.sum("tp"), F.sum("support"))
    summary = per_class.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"),
                *[accuracy.alias(m) for m in metrics],
                F.sum("support").alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("class"),
                *[F.avg(m).alias(m) for m in metrics],
                F.sum("support").alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("class"),
                *[weighted(m).alias(m) for m in metrics],
                F.sum("support").alias("support"),
            ),
        ).alias("s")
    ).select(F.inline("s"))
    return per_class.select("class", *metrics, "support").unionByName(summary)


def weighted_f1(rows: DataFrame, label: str = "label", predicted: str = "rf_class") -> float:
    report = evaluate(rows, label, predicted)
    return float(report.where(F.col("class") == "weighted avg").first()["f1"])


def fold_rows(rows: DataFrame, *key: str, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold``: every label spread evenly over the folds."""
    numbered = number_rows(rows, hash_order(seed, *key), group=("label",), name="__n")
    return numbered.withColumn("fold", (F.col("__n") % folds).cast("int")).drop("__n")


def cross_validate(
    rows: DataFrame, *key: str, folds: int = FOLDS, seed: int = SEED, **settings
) -> tuple[float, float]:
    """Mean and population deviation of the weighted F1 over stratified folds.

    Folds are fitted at the same time from one stored table: their jobs share the cluster.
    """
    folded = materialize(fold_rows(rows, *key, folds=folds, seed=seed), "folds")

    def score(fold: int) -> float:
        model, classes = fit_forest(
            folded.where(F.col("fold") != fold), *key, seed=seed, **settings
        )
        held_out = predict(folded.where(F.col("fold") == fold), model, classes)
        return weighted_f1(held_out)

    with ThreadPoolExecutor(max_workers=folds) as pool:
        scores = list(pool.map(inheritable_thread_target(rows.sparkSession)(score), range(folds)))
    return statistics.fmean(scores), statistics.pstdev(scores)
