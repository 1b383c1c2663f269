import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.functions import kernels
from cinderlog.operators import explain, forest, iforest

SCHEMA = "id int, label string, features struct<size:int,indices:array<int>,values:array<double>>"


def matrix(spark, x, labels=None):
    rows = [
        (i, labels[i] if labels else "Normal", (x.shape[1], list(range(x.shape[1])), [float(v) for v in row]))
        for i, row in enumerate(x)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def gaussian(spark):
    x = np.random.default_rng(0).normal(size=(200, 53))
    return matrix(spark, x).persist()


def test_isolation_forest_outputs(spark, gaussian):
    model = iforest.IsolationForest("id", trees=30).fit(gaussian)
    rows = model.transform(gaussian).collect()
    assert {r["if_prediction"] for r in rows} == {-1, 1}
    assert sum(r["if_prediction"] == -1 for r in rows) == 10
    assert all(-1 <= r["if_decision"] <= 1 for r in rows)


def test_trees_do_not_depend_on_partitions(spark, gaussian):
    one, other = (
        iforest.IsolationForest("id", trees=10).fit(gaussian.repartition(p)) for p in (1, 7)
    )
    assert one.nodes.equals(other.nodes)
    assert one.offset == pytest.approx(other.offset, abs=1e-12)


def test_outliers_score_lower(spark):
    x = np.random.default_rng(3).normal(size=(500, 6))
    x[:5] += 12
    df = matrix(spark, x)
    model = iforest.IsolationForest("id", trees=50, contamination=0.02).fit(df)
    rows = {r["id"]: r["if_decision"] for r in model.transform(df).collect()}
    assert max(rows[i] for i in range(5)) < np.median(list(rows.values()))


def test_samples_are_exact(spark):
    df = spark.range(5000).select(
        F.col("id").cast("int"),
        F.struct(F.lit(1).alias("size"), F.array(F.lit(0)).alias("indices"), F.array(F.rand(1)).alias("values")).alias("features"),
    )
    for trees, rows in ((3, 5000), (40, 5000)):
        drawn = iforest.IsolationForest("id", trees=trees).samples(df, rows)
        counts = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("code").alias("d"))
        assert [(r["n"], r["d"]) for r in counts.collect()] == [(256, 256)] * trees


def test_path_lengths_against_a_walk():
    rng = np.random.default_rng(1)
    dense = rng.normal(size=(64, 3))
    nodes = kernels.grow_isolation_tree(dense, 6, rng)
    table = {n[0]: n for n in nodes}
    ordered = sorted(nodes)
    flat = {
        "roots": np.array([0]),
        "feature": np.array([n[1] for n in ordered]),
        "threshold": np.array([n[2] for n in ordered]),
        "left": np.array([n[3] for n in ordered]),
        "right": np.array([n[4] for n in ordered]),
        "value": np.array([n[5] for n in ordered]),
    }

    def walk(row):
        node = table[0]
        while node[1] >= 0:
            node = table[node[3] if row[node[1]] <= node[2] else node[4]]
        return node[5]

    assert np.allclose(kernels.leaf_values(dense, flat)[:, 0], [walk(r) for r in dense])


def test_average_path():
    assert kernels.average_path([1, 2]).tolist() == [0.0, 1.0]
    assert kernels.average_path(256) == pytest.approx(10.2448, abs=1e-3)


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    labels = ["BruteForce" if r[0] + r[1] > 1 else "SQLi" if r[2] > 1 else "Normal" for r in x]
    df = matrix(spark, x, labels).persist()
    model, classes = forest.fit_forest(df, "id", trees=12, depth=4)
    path = str(tmp_path_factory.mktemp("forest") / "m")
    model.write().overwrite().save(path)
    return df, model, classes, path, x, labels


def test_forest_beats_the_majority_class(spark, fitted):
    df, model, classes, _, _, labels = fitted
    rows = forest.predict(df, model, classes).collect()
    right = np.mean([r["rf_class"] == r["label"] for r in rows])
    assert right > max(labels.count(c) for c in set(labels)) / len(labels)
    assert classes == sorted(set(labels))
    for r in rows:
        assert 0 <= r["rf_confidence"] <= 1
        assert r["rf_probabilities"][r["rf_class"]] == r["rf_confidence"]


@pytest.fixture(scope="module")
def explained(spark, fitted):
    """Explainer and all attributions of 50 rows as matrices, from one cell and from many."""
    df, model, classes, _, _, _ = fitted
    explainer = explain.Explainer(forest.ForestTable.from_model(spark, model), [f"f{i}" for i in range(5)])
    rows = df.where("id < 50").select(F.col("id").cast("string").alias("feature_key"), "features.indices", "features.values")

    def matrices(**cells):
        out = {}
        for r in explainer.contributions(rows, **cells).collect():
            out.setdefault(int(r["feature_key"]), np.zeros((5, len(classes))))[r["feature"]] = r["phi"]
        return out

    return explainer, rows, matrices(), matrices(cell_leaves=20, cell_rows=7)


def test_attributions_do_not_depend_on_cells(explained):
    _, _, whole, parts = explained
    assert set(whole) == set(parts) == set(range(50))
    assert all(np.allclose(whole[i], parts[i], atol=1e-12) for i in whole)


def test_attributions_add_up(fitted, explained):
    df, model, classes, _, _, _ = fitted
    explainer, _, phi, _ = explained
    for r in forest.predict(df.where("id < 50"), model, classes).collect():
        total = explainer.base + phi[r["id"]].sum(axis=0)
        assert np.allclose(total, [r["rf_probabilities"][c] for c in classes], atol=1e-9)


def test_explanations_show_the_largest_attributions(explained):
    explainer, rows, phi, _ = explained
    for r in explainer.explain(rows, top=3).collect():
        own = phi[int(r["feature_key"])]
        chosen = int(np.abs(own).sum(axis=0).argmax())
        order = np.argsort(np.abs(own[:, chosen]), kind="stable")[::-1][:3]
        assert r["names"] == [f"f{i}" for i in order]
        assert np.allclose(r["shap"], own[order, chosen], atol=1e-12) and r["base"] == pytest.approx(explainer.base[chosen])


def test_attributions_equal_shapley_values(spark, fitted, explained):
    """Against the definition: average marginal contribution over all coalitions."""
    _, _, _, path, x, _ = fitted
    explainer, _, phi, _ = explained
    nodes = forest.read_nodes(spark, path)
    trees = [
        {r["node"]: r for r in g} for _, g in itertools.groupby(
            nodes.orderBy("tree", "node").collect(), key=lambda r: r["tree"])
    ]

    def value(node, tree, row, known):
        r = tree[node]
        stats = np.array(r["stats"])
        if r["left"] < 0:
            return stats / stats.sum()
        if r["feature"] in known:
            child = r["left"] if row[r["feature"]] <= r["threshold"] else r["right"]
            return value(child, tree, row, known)
        left, right = sum(tree[r["left"]]["stats"]), sum(tree[r["right"]]["stats"])
        return (
            left * value(r["left"], tree, row, known) + right * value(r["right"], tree, row, known)
        ) / (left + right)

    for i, row in enumerate(x[:3]):
        worth = {
            s: np.mean([value(0, t, row, set(s)) for t in trees], axis=0)
            for k in range(6) for s in itertools.combinations(range(5), k)
        }
        exact = np.zeros((5, len(explainer.base)))
        for j in range(5):
            for s in worth:
                if j not in s:
                    weight = math.factorial(len(s)) * math.factorial(4 - len(s)) / math.factorial(5)
                    exact[j] += weight * (worth[tuple(sorted((*s, j)))] - worth[s])
        assert np.allclose(phi[i], exact, atol=1e-9)


def test_cross_validation(spark, fitted):
    df, *_ = fitted
    mean, deviation = forest.cross_validate(df, "id", folds=3, trees=5, depth=3)
    assert 0 < mean <= 1 and deviation >= 0


def test_distinct_rows_share_work():
    offsets = np.array([0, 2, 4, 6, 6])
    indices = np.array([0, 1, 0, 1, 0, 2])
    values = np.array([1.0, 2.0, 1.0, 2.0, 1.0, 2.0])
    firsts, copy = kernels.distinct_rows(offsets, indices, values)
    assert firsts.tolist() == [0, 2, 3] and copy.tolist() == [0, 0, 1, 2]


def test_isolation_scores_fit_a_forest_on_every_vector(spark, folder, monkeypatch):
    """The query fits a forest besides walking the one that follows from a rule."""
    from checks import models

    rows = [(i, i % 10, [float((i * 7 + j * 3) % 11 - 5) for j in range(64)]) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    fitted, fit = [], iforest.IsolationForest._fit
    monkeypatch.setattr(iforest.IsolationForest, "_fit", lambda self, data: (fitted.append((self.trees, data.count())), fit(self, data))[1])
    found = models.isolation_scores(spark, folder).collect()
    assert fitted == [(50, 120)]
    assert len(found) == 120 and all(r["in_range"] for r in found)
