"""From raw lines to a fitted bundle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.ordering import RowOrder
from cinderlog.operators import features, forest, iforest, prep
from cinderlog.sources.models import ModelBundle
from cinderlog.sources.staging import materialize


def training_contamination(rows: DataFrame) -> float:
    ratio = prep.anomaly_summary(rows).first()
    if ratio["anomaly_ratio"] is None:
        raise ValueError("the training table is empty")
    return float(ratio["contamination"])


def fit_models(
    featured: DataFrame,
    *key: str,
    seed: int = prep.SEED,
    trees: int = forest.TREES,
    depth: int = forest.DEPTH,
    iso_trees: int = iforest.TRAINER_TREES,
):
    """Both forests on a feature table, and the report of the held-out rows.

    The split is stored: fitting a forest reads its rows once per tree level.
    The rare-class merge comes before the contamination only for the classifier;
    merging never turns an anomaly into Normal, so the ratio is the same.
    """
    contamination = training_contamination(featured)
    iso = iforest.IsolationForest(
        *key, trees=iso_trees, contamination=contamination, seed=seed
    ).fit(featured)
    split = materialize(prep.split_rows(prep.merge_rare(featured), *key, seed=seed), "split")
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    fitted, classes = forest.fit_forest(train, *key, trees=trees, depth=depth, seed=seed)
    model = forest.ForestTable.from_model(featured.sparkSession, fitted)
    report = forest.evaluate(forest.predict(test, model, classes))
    return iso, model, classes, report


def train_rows(
    rows: DataFrame,
    dataset: str,
    *key: str,
    terms: int = features.TRAINER_TERMS,
    vocabulary: features.Vocabulary | None = None,
    layout: str = "served",
    **settings,
) -> tuple[ModelBundle, DataFrame]:
    """Fit a bundle on a training table; returns it with its evaluation report.

    The feature table is stored once, because every fit reads it several times.
    """
    fitted = vocabulary or features.fit_vocabulary(rows, max_features=terms)
    build = features.served_features if layout == "served" else features.layered_features
    featured = materialize(
        build(rows, fitted).select(*key, "label", "features"), f"features-{dataset}"
    )
    iso, model, classes, report = fit_models(featured, *key, **settings)
    return ModelBundle(dataset, layout, fitted, iso, model, classes), report


def train_lines(
    lines: DataFrame,
    dataset: str,
    order: RowOrder,
    *key: str,
    raw: str = "raw",
    seed: int = prep.SEED,
    limits: prep.Limits = prep.Limits(),
    **settings,
) -> tuple[ModelBundle, DataFrame, DataFrame]:
    """Whole trainer: prepare, store, fit. Returns bundle, report, training table."""
    rows = materialize(
        prep.prepare(lines, dataset, order, *key, raw=raw, seed=seed, limits=limits), f"train-{dataset}"
    )
    bundle, report = train_rows(rows, dataset, *key, seed=seed, **settings)
    return bundle, report, rows
