"""Attributions of a random-forest prediction to its features.

Follows the path-dependent tree SHAP of Lundberg et al. (2020).  An attribution is a sum over the
forest's leaves, so rows and leaves are dealt into a grid: a task holds a bounded number of each,
adds up its leaves' shares for its rows, and the partial sums of a row are added by key.  Neither
the whole forest nor all of a row's sums need to fit anywhere.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions import kernels
from cinderlog.operators.forest import ForestTable
from cinderlog.sources.staging import materialize

cloudpickle.register_pickle_by_value(kernels)

# How much of an explanation is shown.
TOP_FEATURES = 5
RAISING_SHOWN = 3
LOWERING_SHOWN = 2

# Most leaves and about as many rows as a task of the grid holds.
CELL_LEAVES = 1 << 15
CELL_ROWS = 1 << 10

RAISES = "increases_risk"
LOWERS = "decreases_risk"

LEAVES = "tree int, leaf int, feature array<int>, low array<double>, high array<double>, cover array<double>, value array<double>"
PARTIAL = "feature_key string, feature array<int>, phi array<double>"


def _leaves(nodes: pa.Table) -> pa.Table:
    """Leaves of one tree, each with the interval and the share of rows of every feature on its path."""
    nodes = nodes.sort_by("node")
    left, right, feature = (nodes[c].to_numpy() for c in ("left", "right", "feature"))
    threshold, cover, shares = nodes["threshold"].to_numpy(), nodes["cover"].to_numpy(), nodes["shares"].to_pylist()
    found, waiting = [], [(0, {})]
    while waiting:
        node, path = waiting.pop()
        if feature[node] < 0:
            found.append((list(path), *(list(x) for x in zip(*path.values(), strict=True)), shares[node]) if path else ([], [], [], [], shares[node]))
            continue
        split = int(feature[node])
        low, high, part = path.get(split, (-math.inf, math.inf, 1.0))
        for child, bounds in (
            (left[node], (low, min(high, threshold[node]))),
            (right[node], (max(low, threshold[node]), high)),
        ):
            narrowed = (*bounds, part * cover[child] / cover[node])
            waiting.append((int(child), {**path, split: narrowed}))
    n = len(found)
    columns = [pa.array(np.full(n, nodes["tree"][0].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32))]
    kinds = [pa.list_(pa.int32()), *[pa.list_(pa.float64())] * 4]
    columns += [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
    return pa.table(columns, [c.split()[0] for c in LEAVES.split(", ")])


def leaf_table(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, feature, low, high, cover, value): trees are taken apart in parallel, each by one task."""
    return nodes.groupBy("tree").applyInArrow(_leaves, LEAVES)


@dataclass
class Explainer:
    """Explains by a forest's node table; ``names`` are its features'."""

    forest: ForestTable
    names: list[str]
    _stored: DataFrame | None = None

    @property
    def base(self) -> np.ndarray:
        """Mean class shares of the roots."""
        nodes = self.forest.nodes
        return np.mean([np.asarray(x, dtype=float) for x in nodes.loc[nodes["node"] == 0, "shares"]], axis=0)

    def leaves(self, like: DataFrame) -> DataFrame:
        if self._stored is None:
            nodes = self.forest.to_frame(like.sparkSession)
            self._stored = materialize(leaf_table(nodes), "leaves")
        return self._stored

    def partial_sums(self, rows: DataFrame, cell_leaves: int = CELL_LEAVES, cell_rows: int = CELL_ROWS) -> DataFrame:
        """(feature_key, feature, phi) for each row and part of the leaves; ``phi`` has a row of classes for each feature."""
        leaves = self.leaves(rows)
        rows = materialize(rows.select("feature_key", "indices", "values"), "to-explain")
        across = max(1, -(-leaves.count() // cell_leaves))
        down = max(1, -(-rows.count() // cell_rows))
        size = self.forest.size
        trees = int(self.forest.nodes["tree"].nunique())

        def dealt(df: DataFrame, own: str, n: int, key: tuple[str, ...], other: str, copies: int) -> DataFrame:
            place = F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
            return df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).groupBy("across", "down")

        def cell(leaves: pa.Table, rows: pa.Table) -> pa.Table:
            keys, features, sums = rows["feature_key"].to_pylist(), [], []
            if len(leaves) and len(rows):
                for feature, phi in kernels.shap_rows(rows["indices"], rows["values"], kernels.padded_leaves(leaves), size, trees):
                    features.append(feature)
                    sums.append(phi.ravel())
            else:
                keys = []
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()))
            return pa.table([pa.array(c, k) for c, k in zip((keys, features, sums), kinds, strict=True)], ["feature_key", "feature", "phi"])

        left = dealt(leaves, "across", across, ("tree", "leaf"), "down", down)
        return left.cogroup(dealt(rows, "down", down, ("feature_key",), "across", across)).applyInArrow(cell, PARTIAL)

    def contributions(self, rows: DataFrame, **cells: int) -> DataFrame:
        """(feature_key, feature, phi array of classes): all attributions that are not zero for every class."""
        classes = len(self.base)
        entry = F.explode(F.transform("feature", lambda f, i: F.struct(f.alias("feature"), F.slice("phi", i * classes + 1, classes).alias("phi")))).alias("e")
        entries = self.partial_sums(rows, **cells).select("feature_key", entry).select("feature_key", "e.*")
        sums = [F.sum(F.get("phi", F.lit(c))) for c in range(classes)]
        return entries.groupBy("feature_key", "feature").agg(F.array(*sums).alias("phi"))

    def explain(self, rows: DataFrame, top: int = TOP_FEATURES, **cells: int) -> DataFrame:
        """(feature_key, names, shap, base) of distinct rows ``feature_key, indices, values``.

        The class with the largest attributions is explained, by its ``top`` features; of equal
        attributions the later feature comes first.  A row has at most as many entries as the forest
        has features.
        """
        classes, base = len(self.base), self.base.tolist()
        found = self.contributions(rows, **cells).groupBy("feature_key").agg(
            F.collect_list(F.struct("feature", "phi")).alias("entries"),
            *[F.sum(F.abs(F.get("phi", F.lit(c)))).alias(f"total{c}") for c in range(classes)],
        )
        totals = F.array(*[F.col(f"total{c}") for c in range(classes)])
        chosen = (F.array_position(totals, F.array_max(totals)) - 1).cast("int")
        ranked = F.array_sort(
            F.transform("entries", lambda e: F.struct((-F.abs(F.get(e["phi"], F.col("chosen")))).alias("by"), (-e["feature"]).alias("then"), F.get(e["phi"], F.col("chosen")).alias("shap")))
        )
        shown = found.withColumn("chosen", chosen).withColumn("shown", F.slice(ranked, 1, top))
        names = F.array(*[F.lit(n) for n in self.names])
        explained = shown.select(
            "feature_key",
            F.transform("shown", lambda x: F.get(names, -x["then"])).alias("names"),
            F.transform("shown", lambda x: x["shap"]).alias("shap"),
            F.get(F.array(*[F.lit(b) for b in base]), F.col("chosen")).alias("base"),
        )
        return explained


def explanation_text(top_features: Column) -> Column:
    """Sentence naming the features that raise and lower the risk most."""

    def named(keep, shown: int) -> Column:
        picked = F.slice(F.filter(top_features, keep), 1, shown)
        return F.concat_ws(", ", F.transform(picked, lambda f: f["feature"]))

    raising = named(lambda f: f["shap_value"] > 0, RAISING_SHOWN)
    lowering = named(lambda f: f["shap_value"] < 0, LOWERING_SHOWN)
    parts = F.concat_ws(
        ". ",
        F.when(raising != "", F.concat(F.lit("Features raising the risk: "), raising)),
        F.when(lowering != "", F.concat(F.lit("Features lowering the risk: "), lowering)),
    )
    return F.when(parts != "", F.concat(parts, F.lit("."))).otherwise(
        "No explanation available."
    )


def explanation(names: Column, shap: Column, base: Column) -> Column:
    """Explanation struct from raw attributions; values rounded to 4 digits."""
    features = F.zip_with(
        names,
        shap,
        lambda name, value: F.struct(
            name.alias("feature"),
            F.round(value, 4).alias("shap_value"),
            F.when(value > 0, RAISES).otherwise(LOWERS).alias("direction"),
        ),
    )
    return F.struct(
        features.alias("top_features"),
        F.round(base, 4).alias("base_value"),
        explanation_text(features).alias("explanation_text"),
    )


def feature_key(dataset: Column, features: Column) -> Column:
    """Identity of a feature row within its dataset's model."""
    return F.sha2(
        F.concat_ws("|", dataset, F.to_json(F.struct(features.alias("f")))), 256
    )
