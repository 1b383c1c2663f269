"""Both forests of every dataset in one Arrow function: one pass over the rows."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.functions import kernels
from cinderlog.operators.forest import ForestTable
from cinderlog.operators.iforest import IsolationForestModel

cloudpickle.register_pickle_by_value(kernels)

OUTPUT = "if_decision double, rf_class string, rf_confidence double"


def share_models(
    spark: SparkSession, iso: IsolationForestModel, forest: ForestTable, classes: list[str]
) -> Broadcast:
    """What a worker needs to score the rows of one dataset: two node tables, whose sizes are settings."""
    if iso.size != forest.size:
        raise ValueError(f"the forests read {iso.size} and {forest.size} features")
    return spark.sparkContext.broadcast(
        {
            "iso": iso._forest(),
            "norm": iso.norm,
            "offset": iso.offset,
            "forest": forest.flat(),
            "classes": np.array([*classes, None], dtype=object),
            "size": forest.size,
        }
    )


def with_model_outputs(
    df: DataFrame, shared: dict[str, Broadcast], only_odd: bool = False, model: str = "model", features: str = "features"
) -> DataFrame:
    """Add ``if_decision, if_prediction, rf_class, rf_confidence`` by the models that ``model`` names.

    Rows with null features, or of a model that is not among ``shared``, get nulls and cost nothing
    but their place in a batch.  With ``only_odd`` the class forest is asked only about rows that
    the isolation forest calls odd; the others have no class and confidence 0.
    """

    @F.arrow_udf(OUTPUT)
    def score(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, indices, values in batches:
            decision, confidence = np.full(len(names), np.nan), np.full(len(names), np.nan)
            classes, given = np.full(len(names), None, dtype=object), indices.is_valid().to_numpy(zero_copy_only=False)
            names = names.to_numpy(zero_copy_only=False)
            for name, models in shared.items():
                rows = np.flatnonzero(given & (names == name))
                if not len(rows):
                    continue
                at = pa.array(rows)
                decision[rows], number, confidence[rows] = kernels.both_forests(
                    indices.take(at), values.take(at), models.value, only_odd
                )
                classes[rows] = models.value["classes"][number]
            scored = pa.array(decision, from_pandas=True)
            yield pa.StructArray.from_arrays(
                [scored, pa.array(classes, pa.string()), pa.array(confidence, from_pandas=True)],
                ["if_decision", "rf_class", "rf_confidence"],
            )

    # Stops the optimizer from copying the call into pushed-down filters.
    call = score.asNondeterministic()(F.col(model), F.col(features)["indices"], F.col(features)["values"])
    odd = F.col("__scores.if_decision") < 0
    return df.withColumn("__scores", call).select(
        *df.columns,
        "__scores.*",
        F.when(odd, -1).when(~odd, 1).alias("if_prediction"),
    )
