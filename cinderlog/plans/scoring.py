"""Scoring whole sessions: rules, both models and fusion in one plan."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions import risk, text
from cinderlog.functions.ordering import RowOrder
from cinderlog.operators import explain, features, parse, scorer
from cinderlog.operators.rules import DEFAULT_RULES, Rule, is_short_circuit, rule_outcome
from cinderlog.schemas import SCORED_COLUMNS, SHAP
from cinderlog.sources.models import ModelBundle
from cinderlog.sources.staging import materialize


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def rule_hits(routed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Result rows of lines that a rule settles."""
    score = F.col("rule.score")
    threat = F.col("rule.threat_type")
    return routed.where(is_short_circuit(score)).select(
        *key,
        "level",
        "message",
        "raw_log",
        "dataset_routed",
        "extracted_hour",
        F.lit(True).alias("is_known_threat"),
        threat.alias("threat_type"),
        threat.alias("matched_rule"),
        F.lit(-1).alias("if_prediction"),
        F.lit(1.0).alias("if_anomaly_score"),
        threat.alias("predicted_class"),
        F.lit(1.0).alias("rf_confidence"),
        score.alias("final_risk_score"),
        risk.served_level(score).alias("risk_level"),
    )


def _fused(scored: DataFrame) -> DataFrame:
    """Add ``anomaly``, ``risk`` and ``class`` from model outputs; null where there are none."""
    level, message, known = F.col("level"), F.col("message"), F.col("rf_class").isNotNull()
    base = risk.served_base_risk(F.col("rf_class"), F.col("anomaly"), F.col("rf_confidence"))
    return (
        scored.withColumn("anomaly", risk.anomaly_probability(F.col("if_decision")))
        .withColumn("risk", F.when(known, risk.override_risk(base, level, message)))
        .withColumn(
            "risk",
            risk.unscored_rule_bonus(
                F.col("risk"), F.col("rule.threat_type"), F.col("rule.score")
            ),
        )
        .withColumn("class", F.when(known, risk.override_class(F.col("rf_class"), level, message)))
    )


def fuse_served(scored: DataFrame, key: Sequence[str], *keep: str) -> DataFrame:
    """Result rows from model outputs ``if_decision, if_prediction, rf_class, rf_confidence``."""
    return _fused(scored).select(
        *key,
        "level",
        "message",
        "raw_log",
        "dataset_routed",
        "extracted_hour",
        F.lit(False).alias("is_known_threat"),
        risk.threat_of(F.col("class")).alias("threat_type"),
        F.col("rule.threat_type").alias("matched_rule"),
        "if_prediction",
        F.round("anomaly", 4).alias("if_anomaly_score"),
        F.col("class").alias("predicted_class"),
        F.round("rf_confidence", 4).alias("rf_confidence"),
        F.round("risk", 4).alias("final_risk_score"),
        risk.served_level(F.col("risk")).alias("risk_level"),
        *keep,
    )


def settle(scored: DataFrame, key: Sequence[str], *keep: str) -> DataFrame:
    """Result rows of all lines: by rule where one settles the line, else by the models, else without scores."""
    rule_score, threat = F.col("rule.score"), F.col("rule.threat_type")
    hit, known = is_short_circuit(rule_score), F.col("rf_class").isNotNull()

    def by_case(settled: Column, modelled: Column) -> Column:
        return F.when(hit, settled).when(known, modelled)

    return _fused(scored).select(
        *key,
        "level",
        "message",
        "raw_log",
        "dataset_routed",
        "extracted_hour",
        hit.alias("is_known_threat"),
        by_case(threat, risk.threat_of(F.col("class"))).alias("threat_type"),
        by_case(threat, threat).alias("matched_rule"),
        by_case(F.lit(-1), F.col("if_prediction")).alias("if_prediction"),
        by_case(F.lit(1.0), F.round("anomaly", 4)).alias("if_anomaly_score"),
        by_case(threat, F.col("class")).alias("predicted_class"),
        by_case(F.lit(1.0), F.round("rf_confidence", 4)).alias("rf_confidence"),
        by_case(rule_score, F.round("risk", 4)).alias("final_risk_score"),
        by_case(risk.served_level(rule_score), risk.served_level(F.col("risk"))).alias("risk_level"),
        *keep,
    )


def route_lines(
    lines: DataFrame,
    key: Sequence[str],
    loaded: set[str],
    rules: Sequence[Rule] = DEFAULT_RULES,
    raw: str = "raw",
    level: Column | None = None,
    message: Column | None = None,
) -> DataFrame:
    """Lines with route, hour, rule outcome and the dataset whose model applies."""
    line = F.col(raw)
    return (
        lines.select(
            *key,
            (F.lit("INFO") if level is None else level).alias("level"),
            (line if message is None else message).alias("message"),
            line.alias("raw_log"),
            text.route_with_fallback(line, loaded).alias("dataset_routed"),
        )
        .withColumns(
            {
                "extracted_hour": text.extract_hour(
                    F.col("raw_log"), F.col("dataset_routed")
                ),
                "rule": rule_outcome(F.col("message"), rules),
                "model": F.when(
                    F.col("dataset_routed") == text.FALLBACK_DATASET, "BGL"
                ).otherwise(F.col("dataset_routed")),
            }
        )
    )


def apply_models(rows: DataFrame, bundle: ModelBundle, only_odd: bool = False) -> DataFrame:
    """Add both models' outputs to rows with a ``features`` struct; null features give nulls."""
    shared = {bundle.dataset: bundle.shared(rows.sparkSession)}
    named = rows.withColumn("__model", F.lit(bundle.dataset))
    return scorer.with_model_outputs(named, shared, only_odd, model="__model").drop("__model")


def features_by_model(
    rows: DataFrame, bundles: dict[str, ModelBundle], words: str, needed: Column
) -> DataFrame:
    """Add ``features`` by the vocabulary that ``model`` names; null where ``needed`` is not true.

    Texts are null where a vocabulary does not apply, so a line is split into words for its own only.
    """
    built = []
    for dataset, bundle in sorted(bundles.items()):
        mine = needed & (F.col("model") == dataset)
        rows = rows.withColumn("__words_of", F.when(mine, F.col(words)))
        rows = features.served_features(rows, bundle.vocabulary, "__words_of").withColumnRenamed("features", f"__features_{dataset}")
        built.append(F.when(mine, F.col(f"__features_{dataset}")))
    none = "struct<size:int,indices:array<int>,values:array<double>>"
    found = F.coalesce(*built) if built else F.lit(None).cast(none)
    return rows.withColumn("features", found).drop("__words_of", *[f"__features_{d}" for d in bundles])


def attach_explanations(
    scored: DataFrame, bundles: dict[str, ModelBundle], key: Sequence[str]
) -> DataFrame:
    """Fill ``shap_explanation`` for rows at medium risk and above.

    Attributions depend on the feature row alone and cost far more than anything
    else, so they are computed once per distinct row over the whole table.  The
    scored rows are stored first: the two readers below must not score twice.
    """
    spark = scored.sparkSession
    rows = materialize(
        scored.withColumn(
            "feature_key",
            F.when(F.col("__wanted"), explain.feature_key(F.col("model"), F.col("features"))),
        ).withColumn("features", F.when(F.col("__wanted"), F.col("features"))),
        "scored",
    )
    wanted = (
        rows.where("feature_key IS NOT NULL").select("feature_key", "model", "features").distinct()
    )
    explained = _union(
        [
            bundle.explainer(spark).explain(
                wanted.where(F.col("model") == dataset).select(
                    "feature_key", "features.indices", "features.values"
                )
            )
            for dataset, bundle in sorted(bundles.items())
        ]
    ).select(
        "feature_key",
        explain.explanation(F.col("names"), F.col("shap"), F.col("base")).alias(
            "shap_explanation"
        ),
    )
    # Kept apart, so that rows without an explanation are not all one join key.
    plain = rows.where("feature_key IS NULL").withColumn(
        "shap_explanation", F.lit(None).cast(SHAP)
    )
    joined = rows.where("feature_key IS NOT NULL").join(explained, "feature_key", "left")
    return _union([plain.select(*key, *SCORED_COLUMNS), joined.select(*key, *SCORED_COLUMNS)])


def score_served(
    lines: DataFrame,
    bundles: dict[str, ModelBundle],
    *key: str,
    rules: Sequence[Rule] = DEFAULT_RULES,
    raw: str = "raw",
    explained: bool = False,
    parse_first: bool = False,
    level: str | None = None,
    mask: bool = True,
    stage: bool = False,
) -> DataFrame:
    """Score raw lines as the service does, all datasets in one pass without a shuffle.

    By default the whole line is the message at level INFO; ``level`` names a
    column with the caller's level, ``parse_first`` takes level and message from
    the parsed line.  Lines that a rule settles and lines without any loaded model carry
    no features, so no model runs on them; the latter keep their row without scores.
    ``stage`` stores the routed lines first, for inputs that cost more than a scan.
    """
    given = F.col(level) if level else None
    message = None
    if parse_first:
        lines = parse.parse_generic(lines, raw)
        given, message = F.col("level"), F.col("message")
    routed = route_lines(lines, key, set(bundles), rules, raw, given, message)
    if stage:
        routed = materialize(routed, "routed")
    words = text.mask(F.col("message")) if mask else F.col("message")
    unsettled = ~is_short_circuit(F.col("rule.score"))
    prepared = routed.withColumns({"__text": F.when(unsettled, words), "hour": F.col("extracted_hour")})
    featured = features_by_model(prepared, bundles, "__text", unsettled).drop("__text", "hour")
    shared = {dataset: bundle.shared(lines.sparkSession) for dataset, bundle in bundles.items()}
    modelled = scorer.with_model_outputs(featured, shared)
    if not explained or not bundles:
        return settle(modelled, key, F.lit(None).cast(SHAP).alias("shap_explanation")).select(*key, *SCORED_COLUMNS)
    wanted = F.coalesce(F.col("rf_class").isNotNull() & risk.wants_explanation(F.col("risk")), F.lit(False))
    settled = settle(modelled, key, "model", "features", wanted.alias("__wanted"))
    return attach_explanations(settled, bundles, key)


def score_layered(
    lines: DataFrame,
    bundle: ModelBundle,
    order: RowOrder,
    *key: str,
    file: str = "file",
    raw: str = "raw",
    rules: Sequence[Rule] = DEFAULT_RULES,
    explained: bool = False,
    mask: bool = True,
    strict: bool = False,
    accepted_only: bool = False,
) -> DataFrame:
    """Score parsed files layer by layer: rules, isolation forest, random forest.

    ``strict`` raises if any file has too many unparsed lines; ``accepted_only`` leaves such files out.

    Each layer sees only what the one before let through: lines that a rule settles have no
    features, and the class forest is asked only about rows that the isolation forest calls odd.
    """
    if accepted_only:
        parsed, _ = parse.quality_gate(lines, file, raw)
    else:
        parsed = parse.parse_generic(lines, raw)
    if strict:
        parsed = parse.require_quality(parsed, file)
    timed = features.time_features(parsed, order, file)
    matched = timed.select(
        *key,
        "level",
        "service",
        "message",
        F.col(raw).alias("raw_log"),
        "time_delta",
        "ts_hour",
        rule_outcome(F.col("message"), rules).alias("rule"),
    )
    known = F.col("rule.is_known_threat")
    words = text.mask(F.col("message")) if mask else F.col("message")
    featured = features.layered_features(
        matched.withColumn("__text", F.when(~known, words)), bundle.vocabulary, "__text"
    ).withColumn("features", F.when(~known, F.col("features")))
    modelled = apply_models(featured, bundle, only_odd=True)
    usual = F.col("if_prediction") == 1
    threat = F.col("rule.threat_type")
    fused = modelled.withColumn(
        "anomaly", risk.anomaly_probability(F.col("if_decision"))
    ).withColumn(
        "risk",
        risk.layered_risk(known, F.col("if_prediction"), F.col("anomaly"), F.col("rf_confidence")),
    )
    wanted = ~known & ~usual & risk.wants_explanation(F.col("risk"))
    scored = fused.select(
        *key,
        "level",
        "service",
        "message",
        "raw_log",
        known.alias("is_known_threat"),
        F.when(known, threat).alias("threat_type"),
        F.when(known, F.col("rule.matched_rule")).alias("matched_rule"),
        F.when(known, 1).otherwise(F.col("if_prediction")).alias("if_prediction"),
        F.when(known, 0.0).otherwise(F.col("anomaly")).alias("if_anomaly_score"),
        risk.layered_class(known, threat, F.col("if_prediction"), F.col("rf_class")).alias("predicted_class"),
        F.when(known, 1.0).otherwise(F.col("rf_confidence")).alias("rf_confidence"),
        F.col("risk").alias("final_risk_score"),
        risk.layered_level(F.col("risk"), known).alias("risk_level"),
        F.lit(bundle.dataset).alias("model"),
        "features",
        F.coalesce(wanted, F.lit(False)).alias("__wanted"),
    )
    if not explained:
        return scored.drop("model", "features", "__wanted").withColumn("shap_explanation", F.lit(None).cast(SHAP))
    columns = [c for c in scored.columns if c not in ("model", "features", "__wanted")]
    return _explain_layered(scored, bundle, key).select(*columns, "shap_explanation")


def _explain_layered(
    scored: DataFrame, bundle: ModelBundle, key: Sequence[str]
) -> DataFrame:
    filler = {c: F.lit(None).cast("string") for c in ("dataset_routed", "extracted_hour")}
    return attach_explanations(
        scored.withColumns(filler), {bundle.dataset: bundle}, [*key, "service"]
    )
