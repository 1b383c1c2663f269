"""Fitted models: training, scoring, explanations, retraining.

Scoring is checked value by value on bundles whose trees follow from a rule (``checks.fixed``), which
SQL walks by itself.  What depends on fitted trees is checked by labels that the features decide, by
sample sizes and counts.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import fixed
from checks.lines import PARSED, PARSER, _lines, respelled
from checks.registry import check, routed
from checks.training import STANDARD_TIME, _order, time_sql
from checks.views import documents, table, view
from cinderlog.functions import text
from cinderlog.functions.ordering import column_order
from cinderlog.functions.quantile import exact_quantiles
from cinderlog.operators import explain, features, forest, iforest, parse, scorer
from cinderlog.operators.rules import is_short_circuit
from cinderlog.plans import retrain, scoring, training
from cinderlog.sources import corrections, models, staging

# Small forests keep the checks quick; the data is whole.
SMALL = {"trees": 20, "depth": 8, "iso_trees": 20}
TERMS = 200
DATASETS = ("BGL", "HDFS")

_trained: dict = {}


def trained(spark, d):
    """Published bundles, reports and training tables of both datasets, per session."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _trained:
        root = staging.new_path(spark, "models")
        reports, tables = {}, {}
        lines = _lines(spark, d).select("line_no", "raw")
        for dataset in DATASETS:
            bundle, report, rows = training.train_lines(
                lines, dataset, _order(), "line_no", terms=TERMS, **SMALL
            )
            models.publish(spark, root, bundle)
            reports[dataset], tables[dataset] = staging.materialize(report, "report"), rows
        _trained[at] = (root, models.load_available(spark, root), reports, tables)
    return _trained[at]


def _featured(spark, d, dataset="BGL"):
    _, bundles, _, tables = trained(spark, d)
    return features.served_features(tables[dataset], bundles[dataset].vocabulary)


def _embeddings(spark, d):
    """Dense numeric vectors in the layout of a feature struct."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    n = F.size("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id",
        "label",
        F.struct(
            n.alias("size"), F.sequence(F.lit(0), n - 1).alias("indices"), values.alias("values")
        ).alias("features"),
    )


@check(
    "M1_forest_samples",
    sql="SELECT CAST(range AS INTEGER) AS tree, (SELECT least(256, count(*)) FROM embeddings) AS rows FROM range(50)",
)
def forest_samples(spark, d):
    rows = _embeddings(spark, d)
    estimator = iforest.IsolationForest("vec_id", trees=50)
    drawn = estimator.samples(rows, rows.count())
    return drawn.groupBy("tree").agg(F.count_distinct("code").alias("rows"))


DENSE = [("vectors", 64, 5)]
VECTOR_CELLS = "SELECT vec_id AS key, unnest(range(len(embedding))) AS feature, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"
VECTOR_OUTPUTS = fixed.outputs_sql("SELECT vec_id AS key, 'vectors' AS model FROM embeddings", VECTOR_CELLS, fixed.nodes_sql(DENSE, dense=True))


@check(
    "M2_isolation_scores",
    sql=f"""WITH RECURSIVE {VECTOR_OUTPUTS}
    SELECT key AS vec_id, round(if_decision, 9) AS if_decision, CASE WHEN if_decision < 0 THEN -1 ELSE 1 END AS if_prediction, true AS in_range FROM iso""",
)
def isolation_scores(spark, d):
    """Scores of a forest that follows from a rule, whose trees SQL walks, and of one that is fitted to all vectors."""
    _, size, salt = DENSE[0]
    rows = _embeddings(spark, d)
    scored = fixed.isolation_forest(size, salt, dense=True).transform(rows)
    ruled = scored.select("*", F.round("if_decision", 9).alias("decision"), F.col("if_prediction").alias("prediction"))
    # A vector without some of its values is scored, but there is nothing to split it by.
    whole = rows.where((F.col("features.size") > 0) & F.forall("features.values", lambda x: x.isNotNull()))
    fitted = ruled if whole.isEmpty() else iforest.IsolationForest("vec_id", trees=50).fit(whole).transform(ruled)
    agrees = (F.col("if_decision") < 0) == (F.col("if_prediction") == -1)
    return fitted.select(
        "vec_id",
        F.col("decision").alias("if_decision"),
        F.col("prediction").alias("if_prediction"),
        (F.col("if_decision").between(-1.0, 1.0) & agrees).alias("in_range"),
    )


@check(
    "M3_offset_share",
    sql="""SELECT 0.1::DOUBLE AS contamination, ceil(0.1::DOUBLE * (count(*) - 1)) AS most, true AS within FROM embeddings""",
)
def offset_share(spark, d):
    """No more rows fall below the offset than the contamination says."""
    rows = _embeddings(spark, d)
    model = iforest.IsolationForest("vec_id", trees=50, contamination=0.1).fit(rows)
    return (
        model.transform(rows)
        .agg(
            F.ceil(F.lit(0.1) * (F.count(F.lit(1)) - 1)).cast("double").alias("most"),
            F.count_if(F.col("if_prediction") == -1).alias("odd"),
        )
        .select(
            F.lit(0.1).alias("contamination"),
            "most",
            ((F.col("odd") <= F.col("most")) & (F.col("odd") > 0)).alias("within"),
        )
    )


def _decided(spark, d):
    """Log lines whose label their parsed level decides, with few other features."""
    parsed = parse.parse_generic(_lines(spark, d))
    label = F.when(F.col("level") == "ERROR", "AppError").when(F.col("level").isin("WARNING", "CRITICAL"), "SystemFailure").otherwise("Normal")
    rows = parsed.select("line_no", text.mask("message").alias("message"), "level", F.lit(-1).alias("hour"), label.alias("label"))
    vocabulary = features.fit_vocabulary(rows, max_features=1)
    return staging.materialize(
        features.served_features(rows, vocabulary).select("line_no", "label", "features"), "decided"
    )


DECIDED = f"""
WITH levels AS (SELECT line_no, {respelled('raw_level', PARSER)} AS level FROM ({PARSED}) p),
decided AS (SELECT line_no, CASE WHEN level = 'ERROR' THEN 'AppError' WHEN level IN ('WARNING', 'CRITICAL') THEN 'SystemFailure' ELSE 'Normal' END AS label FROM levels)
"""


@check("M5_decided_labels", "log_lines", f"{DECIDED} SELECT line_no, label AS rf_class FROM decided")
def decided_labels(spark, d):
    """A fitted forest finds the label of every line, as one feature decides it."""
    rows = _decided(spark, d)
    model, classes = forest.fit_forest(rows, "line_no", trees=40, depth=8)
    return forest.predict(rows, model, classes).select("line_no", "rf_class")


@check(
    "M5_document_classifier",
    sql="SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS truth, 1.0::DOUBLE AS total FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def document_classifier(spark, d):
    """TF-IDF of documents against their quality label."""
    docs = documents(spark, d).select("doc_id", F.col("text").alias("message"))
    rows = docs.join(table(spark, d, "labels"), "doc_id").select(
        "doc_id",
        "message",
        F.lit("INFO").alias("level"),
        F.lit(-1).alias("hour"),
        F.col("quality").cast("string").alias("label"),
    )
    vocabulary = features.fit_vocabulary(rows, max_features=TERMS)
    featured = staging.materialize(
        features.served_features(rows, vocabulary).select("doc_id", "label", "features"), "docs"
    )
    model, classes = forest.fit_forest(featured, "doc_id", trees=20, depth=5)
    total = F.aggregate(F.map_values("rf_probabilities"), F.lit(0.0), lambda a, x: a + x)
    return forest.predict(featured, model, classes).select(
        "doc_id", F.col("label").alias("truth"), F.round(total, 9).alias("total")
    )


PROBABILITIES = ", ".join(f"round(m{c}, 9) AS p_{name.lower()}" for c, name in enumerate(fixed.CLASSES))


@check(
    "M6_predictions",
    sql=f"WITH RECURSIVE {VECTOR_OUTPUTS} SELECT key AS vec_id, rf_class, round(rf_confidence, 9) AS rf_confidence, {PROBABILITIES} FROM classed",
)
def predictions(spark, d):
    """Class, confidence and all probabilities by a forest that follows from a rule; SQL walks the same trees."""
    _, size, salt = DENSE[0]
    table_of = fixed.class_forest(size, salt, dense=True)
    scored = forest.predict(_embeddings(spark, d), table_of, fixed.CLASSES)
    shown = [F.round(F.col("rf_probabilities")[name], 9).alias(f"p_{name.lower()}") for name in fixed.CLASSES]
    return scored.select("vec_id", "rf_class", F.round("rf_confidence", 9).alias("rf_confidence"), *shown)


@check("M7_cross_validation", sql="SELECT 1.0::DOUBLE AS f1_mean, 0.0::DOUBLE AS f1_std")
def cross_validation(spark, d):
    """Held-out labels that one feature decides are all found, in every fold."""
    mean, deviation = forest.cross_validate(_decided(spark, d), "line_no", trees=40, depth=8)
    return spark.createDataFrame([(round(mean, 9), round(deviation, 9))], "f1_mean double, f1_std double")


@check(
    "M7_stratified_folds",
    sql="""
    SELECT label, CAST(i AS INTEGER) AS fold, n // 5 + CASE WHEN i BETWEEN 1 AND n % 5 THEN 1 ELSE 0 END AS rows
    FROM (SELECT CAST(label AS VARCHAR) AS label, count(*) AS n FROM embeddings GROUP BY 1) c, (SELECT range AS i FROM range(5)) f
    """,
)
def stratified_folds(spark, d):
    rows = _embeddings(spark, d).withColumn("label", F.col("label").cast("string"))
    return forest.fold_rows(rows, "vec_id").groupBy("label", "fold").agg(
        F.count(F.lit(1)).alias("rows")
    )


@check("M8_training_report", sql=None)
def training_report(spark, d):
    _, _, reports, _ = trained(spark, d)
    bgl, hdfs = (reports[n].withColumn("dataset", F.lit(n)) for n in DATASETS)
    return bgl.unionByName(hdfs)


@check("M9_attributions", sql=fixed.attributions_sql(explain.TOP_FEATURES))
def attributions(spark, d):
    """Attributions of every vector by trees of two levels, for which SQL has a closed form; rows and leaves meet in small cells."""
    explainer = explain.Explainer(fixed.two_level_forest(), [f"d{i}" for i in range(64)])
    rows = _embeddings(spark, d).select(F.col("vec_id").cast("string").alias("feature_key"), "features.indices", "features.values")
    shown = explainer.explain(rows, cell_leaves=20, cell_rows=300)
    places = F.posexplode(F.arrays_zip("names", "shap")).alias("at", "e")
    return shown.select("feature_key", "base", places).select(
        F.col("feature_key").cast("long").alias("vec_id"),
        (F.col("at") + 1).alias("place"),
        F.col("e.names").alias("feature"),
        F.round("e.shap", 9).alias("shap"),
        F.round("base", 9).alias("base"),
    )


@check("M9_explained_lines", sql=None)
def explained_lines(spark, d):
    """Sentences for every distinct feature row of the training lines of both datasets, by fitted forests."""
    _, bundles, _, tables = trained(spark, d)
    sentences = []
    for dataset, bundle in bundles.items():
        featured = features.served_features(tables[dataset], bundle.vocabulary)
        distinct = (
            featured.withColumn("feature_key", explain.feature_key(F.lit(dataset), F.col("features")))
            .groupBy("feature_key")
            .agg(F.any_value("features").alias("f"))
            .select("feature_key", "f.indices", "f.values")
        )
        shown = bundle.explainer(spark).explain(distinct)
        text_of = explain.explanation(F.col("names"), F.col("shap"), F.col("base"))["explanation_text"]
        sentences.append(shown.select(F.lit(dataset).alias("dataset"), "feature_key", text_of.alias("explanation_text")))
    return sentences[0].unionByName(sentences[1])


SERVED = "WITH RECURSIVE " + fixed.served_sql("SELECT line_no AS key, raw FROM log_lines")


@check("K10_served_scoring", "log_lines", f"{SERVED} SELECT key AS line_no, {fixed.SERVED_COLUMNS} FROM served")
def served_scoring(spark, d):
    """Every column of every line: rules, both forests of either dataset, overrides, rounding."""
    lines = _lines(spark, d).select("line_no", "raw")
    return scoring.score_served(lines, fixed.bundles(), "line_no").select("line_no", *fixed.SERVED_LIST)


@check(
    "K10_staged_explained_scoring",
    "log_lines",
    f"{SERVED} SELECT key AS line_no, final_risk_score, NOT hit AND r3 >= 0.5 AS is_explained FROM (SELECT s.*, hit, r3 FROM served s JOIN final f ON s.key = f.key) x",
)
def explained_scoring(spark, d):
    """Staged scoring: exactly the risky lines without a rule are explained."""
    lines = _lines(spark, d).select("line_no", "raw")
    scored = scoring.score_served(lines, fixed.bundles(), "line_no", explained=True, stage=True)
    return scored.select(
        "line_no", "final_risk_score", F.col("shap_explanation").isNotNull().alias("is_explained")
    )


LAYERED_OUTPUTS = fixed.layered_sql(
    f"SELECT p.line_no AS key, raw, message, {respelled('raw_level', PARSER)} AS level, time_delta, ts_hour FROM ({PARSED}) p JOIN times t ON p.line_no = t.line_no"
)


@check(
    "K10_layered_scoring",
    "log_lines",
    f"WITH RECURSIVE times AS ({time_sql(STANDARD_TIME)}), {LAYERED_OUTPUTS} SELECT key AS line_no, {fixed.LAYERED_COLUMNS} FROM layered",
)
def layered_scoring(spark, d):
    """Parsed files layer by layer, by a bundle of the layered layout."""
    lines = _lines(spark, d).select("line_no", "file_id", "raw")
    scored = scoring.score_layered(
        lines, fixed.bundle("BGL", "layered"), column_order("line_no", 900), "line_no", file="file_id"
    )
    rounded = {c: F.round(c, 9) for c in ("if_anomaly_score", "rf_confidence", "final_risk_score")}
    return scored.withColumns(rounded).select("line_no", *fixed.LAYERED_LIST)


@check(
    "M14_model_selection",
    "log_lines",
    f"""
    SELECT dataset_routed, count(*) AS lines FROM (
      SELECT CASE WHEN {routed('raw')} = 'BGL' THEN 'BGL' ELSE 'BGL (Fallback)' END AS dataset_routed FROM log_lines) r GROUP BY 1
    """,
)
def model_selection(spark, d):
    """Without an HDFS model its lines fall back to the BGL one."""
    lines = _lines(spark, d).select("line_no", "raw")
    scored = scoring.score_served(lines, {"BGL": fixed.bundle("BGL")}, "line_no")
    return scored.where(F.col("final_risk_score").isNotNull()).groupBy("dataset_routed").agg(
        F.count(F.lit(1)).alias("lines")
    )


@check(
    "S10_model_round_trip",
    "log_lines",
    f"""{SERVED} SELECT a.key AS line_no, a.model AS dataset, round(if_decision, 9) AS if_decision, rf_class, round(c.rf_confidence, 9) AS rf_confidence
    FROM asked a JOIN iso i ON a.key = i.key JOIN classed c ON a.key = c.key WHERE NOT hit""",
)
def model_round_trip(spark, d):
    """Published, reloaded bundles score every line as the trees that were stored do."""
    root = staging.new_path(spark, "stored-models")
    for bundle in fixed.bundles().values():
        models.publish(spark, root, bundle)
    bundles = models.load_available(spark, root)
    routed_lines = scoring.route_lines(_lines(spark, d).select("line_no", "raw"), ["line_no"], set(bundles))
    prepared = routed_lines.where(~is_short_circuit(F.col("rule.score"))).withColumns(
        {"words": text.mask(F.col("message")), "hour": F.col("extracted_hour")}
    )
    featured = scoring.features_by_model(prepared, bundles, "words", F.lit(True))
    shared = {name: bundle.shared(spark) for name, bundle in bundles.items()}
    return scorer.with_model_outputs(featured, shared).select(
        "line_no",
        F.col("model").alias("dataset"),
        F.round("if_decision", 9).alias("if_decision"),
        "rf_class",
        F.round("rf_confidence", 9).alias("rf_confidence"),
    )


@check(
    "M11_retrain",
    "corrections_json",
    """
    WITH items AS (SELECT unnest(CAST(payload AS JSON[])) AS item FROM corrections_json),
    given AS (SELECT coalesce(nullif(item->>'rawLog', ''), nullif(item->>'raw_log', ''), nullif(item->>'RawLog', '')) AS raw_log FROM items)
    SELECT CASE WHEN (regexp_matches(raw_log, '^[0-9]') AND contains(raw_log, 'dfs.')) OR contains(raw_log, 'blk_') THEN 'HDFS' ELSE 'BGL' END AS dataset,
      count(*) AS corrections_used, true AS success, false AS skipped, true AS new_version FROM given WHERE raw_log IS NOT NULL GROUP BY 1
    """,
)
def retrained(spark, d):
    """Corrections and a baseline sample give every dataset a new version."""
    _, bundles, _, tables = trained(spark, d)
    root = staging.new_path(spark, "retrained")
    for bundle in bundles.values():
        models.publish(spark, root, models.load_bundle(spark, bundle.path))
    given = corrections.read_corrections(view(spark, d, "corrections_json"))
    results = retrain.retrain(
        spark, root, given, tables, ["payload_id", "item_no"], ["line_no"], **SMALL
    )
    renewed = (F.col("version") != F.col("previous_version")) & F.col("new_f1_score").between(0, 1)
    return results.select(
        "dataset", "corrections_used", "success", "skipped", renewed.alias("new_version")
    )


SHARES = (0.0, 0.01, 0.05, 0.37, 0.5, 0.999, 1.0)


@check(
    "M3_exact_quantiles",
    "model_out",
    " UNION ALL ".join(
        f"SELECT CAST({s} AS DOUBLE) AS share, quantile_cont(iso_decision + line_no * CAST(1e-7 AS DOUBLE), {s}) AS value FROM model_out" for s in SHARES
    ),
)
def score_quantiles(spark, d):
    """Quantiles of scores that hardly ever repeat, by narrowing bins."""
    value = F.col("iso_decision") + F.col("line_no") * F.lit(1e-7)
    found = exact_quantiles(view(spark, d, "model_out"), value, list(SHARES))
    return spark.createDataFrame(list(zip(SHARES, found, strict=True)), "share double, value double")


@check(
    "M12_published_versions",
    "log_lines",
    f"""
    SELECT dataset, CAST(place AS BIGINT) AS sequence, version, place = 3 AS current
    FROM (SELECT DISTINCT {routed('raw')} AS dataset FROM log_lines) d,
      (VALUES (1, 'first'), (2, 'second'), (3, 'first')) v(place, version)
    """,
)
def published_versions(spark, d):
    """Two versions of every dataset in the lines are published, then the first one again."""
    root = staging.new_path(spark, "published")
    routes = view(spark, d, "log_lines").select(text.route_dataset(F.col("raw")).alias("dataset")).distinct().collect()
    for route in routes:
        for version in ("first", "second", "first"):
            models.point_to(spark, root, route["dataset"], version)
    log = models.published_versions(spark, root)
    now = {r["dataset"]: models.current_version(spark, root, r["dataset"]) for r in routes}
    last = F.col("sequence") == F.max("sequence").over(Window.partitionBy("dataset"))
    current = F.create_map(*[F.lit(x) for pair in now.items() for x in pair])[F.col("dataset")]
    return log.select("dataset", "sequence", "version", (last & (F.col("version") == current)).alias("current"))


@check(
    "M13_retrain_status",
    "corrections_json",
    """
    WITH items AS (SELECT unnest(CAST(payload AS JSON[])) AS item FROM corrections_json)
    SELECT 'partial_failure' AS status, count(*) AS total_input FROM items
    WHERE coalesce(nullif(item->>'rawLog', ''), nullif(item->>'raw_log', ''), nullif(item->>'RawLog', '')) IS NOT NULL
    """,
)
def retrain_status(spark, d):
    """Without any published model every dataset is skipped."""
    given = corrections.read_corrections(view(spark, d, "corrections_json"))
    results = retrain.retrain(
        spark, staging.new_path(spark, "empty"), given, {}, ["payload_id", "item_no"], ["line_no"]
    )
    return retrain.retrain_status(results)
