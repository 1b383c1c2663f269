"""Isolation forest: trees grown in parallel on hash samples, scored with Arrow.

Follows Liu, Ting and Zhou (2008).  Only the sampled rows, at most trees x 256,
ever leave their partition; scoring is a projection without a shuffle.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import pyspark.cloudpickle as cloudpickle
from cinderlog.functions import kernels
from cinderlog.functions.hashing import digest, hash_unit
from cinderlog.functions.quantile import exact_quantiles
from cinderlog.sources.staging import materialize

cloudpickle.register_pickle_by_value(kernels)

# Forest settings of the trainer and of the model class.
TRAINER_TREES = 200
CLASS_TREES = 100
CLASS_CONTAMINATION = 0.05
MAX_SAMPLE = 256
SEED = 42

OVERSAMPLING = 2

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, path double"
)


def _grow(seed: int, sample: int):
    limit = max(1, math.ceil(math.log2(max(sample, 2))))

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        rows = rows.sort_values("code", kind="stable")
        lengths = rows["indices"].map(len).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        indices = np.concatenate([np.asarray(i, dtype=np.int64) for i in rows["indices"]])
        values = np.concatenate([np.asarray(v, dtype=float) for v in rows["values"]])
        used, compact = np.unique(indices, return_inverse=True)
        dense = kernels.densify(
            np.arange(len(rows)), offsets, compact, values, len(used)
        )
        nodes = kernels.grow_isolation_tree(dense, limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(
            nodes, columns=["node", "feature", "threshold", "left", "right", "path"]
        )
        inner = out["feature"].to_numpy() >= 0
        out.loc[inner, "feature"] = used[out.loc[inner, "feature"].to_numpy(dtype=np.int64)]
        out.insert(0, "tree", tree)
        return out

    return grow


class IsolationForest(Estimator):
    """Fits on a ``features`` struct column; ``key`` names the row's identity."""

    def __init__(
        self,
        *key: str,
        trees: int = TRAINER_TREES,
        contamination: float = CLASS_CONTAMINATION,
        max_sample: int = MAX_SAMPLE,
        seed: int = SEED,
        features: str = "features",
    ):
        super().__init__()
        self.key = key
        self.trees = trees
        self.contamination = contamination
        self.max_sample = max_sample
        self.seed = seed
        self.features = features

    def samples(self, dataset: DataFrame, rows: int) -> DataFrame:
        """Exactly ``min(256, rows)`` distinct rows for every tree."""
        sample = min(self.max_sample, rows)
        wanted = OVERSAMPLING * self.trees * sample
        code = digest(self.seed, *[F.col(k) for k in self.key])
        coded = dataset.select(
            code.alias("code"),
            F.col(self.features)["indices"].alias("indices"),
            F.col(self.features)["values"].alias("values"),
        )
        # One rule at any size: thin the rows by hash, then let every tree draw its own.
        thin = min(1.0, wanted / rows)
        picked = coded.where(hash_unit("row", F.col("code")) < thin)
        share = min(1.0, OVERSAMPLING * sample / (rows * thin))
        cut = int(share * (1 << 30))
        joins = F.filter(
            F.sequence(F.lit(0), F.lit(self.trees - 1)),
            lambda t: F.pmod(F.xxhash64("code", t), F.lit(1 << 30)) < cut,
        )
        drawn = picked.select("*", F.explode(joins).alias("tree"))
        by_tree = Window.partitionBy("tree").orderBy(F.xxhash64("tree", "code"), "code")
        return drawn.withColumn("__rn", F.row_number().over(by_tree)).where(
            F.col("__rn") <= sample
        ).drop("__rn")

    def _fit(self, dataset: DataFrame) -> "IsolationForestModel":
        rows = dataset.count()
        if rows == 0:
            raise ValueError("an isolation forest needs at least one row")
        sample = min(self.max_sample, rows)
        nodes = (
            self.samples(dataset, rows)
            .groupBy("tree")
            .applyInPandas(_grow(self.seed, sample), NODE_SCHEMA)
        )
        size = dataset.select(F.col(self.features)["size"]).first()[0]
        # At most trees x (2 x 256 - 1) nodes.
        table = nodes.orderBy("tree", "node").toPandas()
        model = IsolationForestModel(table, sample, size, 0.0, self.features)
        return model.with_offset(model.fit_offset(dataset, self.contamination))


class IsolationForestModel(Model):
    def __init__(
        self, nodes: pd.DataFrame, sample: int, size: int, offset: float, features: str = "features"
    ):
        super().__init__()
        self.nodes = nodes
        self.sample = sample
        self.size = size
        self.offset = offset
        self.features = features
        self._shared = None

    def with_offset(self, offset: float) -> "IsolationForestModel":
        return IsolationForestModel(self.nodes, self.sample, self.size, offset, self.features)

    def _forest(self) -> dict:
        """Flat node arrays; children are positions in the arrays."""
        nodes = self.nodes.sort_values(["tree", "node"], kind="stable")
        columns = [nodes[c].to_numpy() for c in ("tree", "feature", "threshold", "left", "right", "path")]
        return kernels.flat_forest(*columns) | {"size": int(self.size)}

    @property
    def norm(self) -> float:
        """Expected path length of a sample of the fitted size."""
        return max(float(kernels.average_path(self.sample)), 1e-12)

    def score(self) -> Column:
        """Anomaly score in [-1, 0): lower is odder."""
        if self._shared is None:
            spark = SparkSession.active()
            self._shared = spark.sparkContext.broadcast(self._forest())
        shared, norm = self._shared, self.norm

        @F.arrow_udf("double")
        def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            forest = shared.value
            for indices, values in batches:
                paths = kernels.mean_leaf_values(indices, values, forest)
                yield pa.array(-np.exp2(-paths / norm))

        features = F.col(self.features)
        # Stops the optimizer from copying the call into pushed-down filters.
        return score.asNondeterministic()(features["indices"], features["values"])

    def fit_offset(self, dataset: DataFrame, contamination: float) -> float:
        """Score below which the given share of the training rows lies; scores are stored, not worked out for each pass."""
        scores = materialize(dataset.select(self.score().alias("s")), "iso-scores")
        return float(exact_quantiles(scores, F.col("s"), [contamination])[0])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Add ``if_decision`` and ``if_prediction`` (-1 odd, 1 usual)."""
        decided = dataset.withColumn("if_decision", self.score() - F.lit(self.offset))
        return decided.withColumn(
            "if_prediction", F.when(F.col("if_decision") < 0, -1).otherwise(1)
        )
