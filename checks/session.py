"""Risk fusion and session analytics, on stand-in model outputs."""

from pyspark.sql import functions as F

from checks import fixed
from checks.lines import TRIMMED
from checks.registry import check, hour, routed, rule
from checks.views import view
from cinderlog.functions import risk
from cinderlog.functions.ordering import column_order
from cinderlog.operators import explain, rules, session
from cinderlog.operators.rules import Rule
from cinderlog.plans import files, scoring
from cinderlog.sources import models, results, staging

# Oracle pieces -----------------------------------------------------------------

# The cut points and sentences below.
ANOMALY = (
    "least(greatest(1::DOUBLE - (least(greatest(iso_decision, -0.5::DOUBLE), 0.5::DOUBLE) + 0.5::DOUBLE),"
    " 0::DOUBLE), 1::DOUBLE)"
)
SEVERE = (
    "(level IN ('ERROR', 'CRITICAL', 'FATAL') OR contains(lower(message), 'outofmemory')"
    " OR contains(lower(message), 'corrupted'))"
)
SUSPICIOUS = "(level IN ('WARN', 'WARNING') OR contains(lower(message), 'missing'))"

FUSED = f"""
fused AS (
  SELECT *, CASE WHEN {SEVERE} THEN greatest(base, 0.85::DOUBLE) WHEN {SUSPICIOUS} THEN greatest(base, 0.65::DOUBLE) ELSE base END AS risk,
    CASE WHEN {SEVERE} THEN 'SystemFailure' WHEN {SUSPICIOUS} AND rf_class = 'Normal' THEN 'SystemFailure' ELSE rf_class END AS class
  FROM (SELECT *, CASE WHEN rf_class = 'Normal' THEN anomaly * 0.3::DOUBLE ELSE 0.4::DOUBLE * anomaly + 0.6::DOUBLE * rf_confidence END AS base
    FROM (SELECT m.*, l.raw AS message, {routed('l.raw')} AS dataset_routed, {ANOMALY} AS anomaly,
        {rule('l.raw', 2)} AS rule_threat, {rule('l.raw', 3)} AS rule_score
      FROM model_out m JOIN log_lines l ON m.line_no = l.line_no) j) b)
"""
LEVEL = "CASE WHEN {0} >= 0.8 THEN 'High' WHEN {0} >= 0.5 THEN 'Medium' ELSE 'Low' END"
SCORED = f"""WITH {FUSED},
scored AS (
  SELECT line_no, session_id, level, message, dataset_routed, {hour('message', 'dataset_routed')} AS extracted_hour,
    hit AS is_known_threat,
    CASE WHEN hit THEN rule_threat ELSE nullif(class, 'Normal') END AS threat_type,
    CASE WHEN hit THEN rule_threat END AS matched_rule,
    CASE WHEN hit OR iso_decision < 0 THEN -1 ELSE 1 END AS if_prediction,
    CASE WHEN hit THEN 1::DOUBLE ELSE round(anomaly, 4) END AS if_anomaly_score,
    CASE WHEN hit THEN rule_threat ELSE class END AS predicted_class,
    CASE WHEN hit THEN 1::DOUBLE ELSE round(rf_confidence, 4) END AS rf_confidence,
    CASE WHEN hit THEN rule_score ELSE round(risk, 4) END AS final_risk_score,
    CASE WHEN hit THEN {LEVEL.format('rule_score')} ELSE {LEVEL.format('risk')} END AS risk_level
  FROM (SELECT *, coalesce(rule_score >= 0.8, false) AS hit FROM fused) f)
"""
INPUTS = "model_out log_lines"

STATS = f"""{SCORED},
stats AS (
  SELECT session_id, count(*) AS total_logs, CAST(sum(CASE WHEN final_risk_score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS total_anomalies,
    round(sum(final_risk_score) / count(*), 4) AS avg_risk_score,
    count(*) FILTER (WHERE risk_level = 'Low') AS low, count(*) FILTER (WHERE risk_level = 'Medium') AS medium,
    count(*) FILTER (WHERE risk_level = 'High') AS high,
    min_by(dataset_routed, line_no) AS dataset_routed
  FROM scored GROUP BY session_id),
threats AS (SELECT session_id, threat_type, count(*) AS logs FROM scored WHERE threat_type <> '' GROUP BY 1, 2)
"""

ORDER = 1000


def order():
    return column_order("line_no", ORDER)


# Spark inputs ------------------------------------------------------------------


def model_rows(spark, d):
    """Model outputs next to the message and the rule outcome of their line."""
    lines = view(spark, d, "log_lines").select("line_no", "raw")
    routed_lines = scoring.route_lines(lines, ["line_no"], {"BGL", "HDFS"})
    outputs = view(spark, d, "model_out")
    return routed_lines.drop("level").join(
        outputs.withColumnRenamed("iso_decision", "if_decision").withColumn(
            "if_prediction", F.when(F.col("if_decision") < 0, -1).otherwise(1)
        ),
        "line_no",
    )


_scored = {}


def scored(spark, d):
    """Result rows: rule hits and fused rows, stored once per session."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _scored:
        rows = model_rows(spark, d)
        key = ["line_no", "session_id"]
        open_rows = rows.where(~rules.is_short_circuit(F.col("rule.score")))
        both = scoring.rule_hits(rows, key).unionByName(scoring.fuse_served(open_rows, key))
        _scored[at] = staging.materialize(both, "scored-lines")
    return _scored[at]


def stats(spark, d):
    return session.session_stats(scored(spark, d), "line_no")


# Risk fusion -------------------------------------------------------------------


@check(
    "M4_anomaly_probability",
    "model_out",
    f"SELECT line_no, round({ANOMALY}, 6) AS anomaly FROM model_out",
)
def anomaly_probabilities(spark, d):
    probability = risk.anomaly_probability(F.col("iso_decision"))
    return view(spark, d, "model_out").select("line_no", F.round(probability, 6).alias("anomaly"))


@check(
    "K1_base_risk", INPUTS, f"WITH {FUSED} SELECT line_no, round(base, 6) AS base FROM fused"
)
def base_risks(spark, d):
    outputs = view(spark, d, "model_out")
    base = risk.served_base_risk(
        F.col("rf_class"), risk.anomaly_probability(F.col("iso_decision")), F.col("rf_confidence")
    )
    return outputs.select("line_no", F.round(base, 6).alias("base"))


@check(
    "K2_override",
    INPUTS,
    f"WITH {FUSED} SELECT line_no, round(risk, 6) AS risk, class FROM fused",
)
def overrides(spark, d):
    rows = model_rows(spark, d)
    base = risk.served_base_risk(
        F.col("rf_class"), risk.anomaly_probability(F.col("if_decision")), F.col("rf_confidence")
    )
    level, message = F.col("level"), F.col("message")
    return rows.select(
        "line_no",
        F.round(risk.override_risk(base, level, message), 6).alias("risk"),
        risk.override_class(F.col("rf_class"), level, message).alias("class"),
    )


RESULT = (
    "line_no, level, message, dataset_routed, extracted_hour, is_known_threat, threat_type, matched_rule,"
    " if_prediction, if_anomaly_score, predicted_class, rf_confidence, final_risk_score, risk_level"
)


@check("K3_rule_rows", INPUTS, f"{SCORED} SELECT {RESULT} FROM scored WHERE is_known_threat")
def rule_rows(spark, d):
    lines = view(spark, d, "log_lines").select("line_no", "raw")
    levels = view(spark, d, "model_out").select("line_no", "level")
    routed_lines = scoring.route_lines(
        lines.join(levels, "line_no"), ["line_no"], {"BGL", "HDFS"}, level=F.col("level")
    )
    return scoring.rule_hits(routed_lines, ["line_no"]).drop("raw_log")


@check(
    "K4_served_level",
    INPUTS,
    f"WITH {FUSED} SELECT line_no, {LEVEL.format('base')} AS base_level, {LEVEL.format('risk')} AS risk_level FROM fused",
)
def served_levels(spark, d):
    rows = model_rows(spark, d)
    base = risk.served_base_risk(
        F.col("rf_class"), risk.anomaly_probability(F.col("if_decision")), F.col("rf_confidence")
    )
    return rows.select(
        "line_no",
        risk.served_level(base).alias("base_level"),
        risk.served_level(
            risk.override_risk(base, F.col("level"), F.col("message"))
        ).alias("risk_level"),
    )


@check("K5_result_rows", INPUTS, f"{SCORED} SELECT {RESULT}, session_id FROM scored")
def result_rows(spark, d):
    return scored(spark, d).drop("raw_log")


LAYERED = f"""
SELECT *, CASE WHEN hit THEN 1::DOUBLE WHEN iso_decision >= 0 THEN anomaly * 0.2::DOUBLE
    ELSE 0.4::DOUBLE * anomaly + 0.6::DOUBLE * rf_confidence END AS layered,
  CASE WHEN hit THEN rule_threat WHEN iso_decision >= 0 THEN 'Normal' ELSE rf_class END AS layered_class
FROM (SELECT *, rule_threat IS NOT NULL AS hit FROM fused) f
"""


def _layered(spark, d):
    rows = model_rows(spark, d).withColumn("hit", F.col("rule.is_known_threat"))
    anomaly = risk.anomaly_probability(F.col("if_decision"))
    return rows.withColumn(
        "layered",
        risk.layered_risk(F.col("hit"), F.col("if_prediction"), anomaly, F.col("rf_confidence")),
    )


@check(
    "K6_layered_risk",
    INPUTS,
    f"WITH {FUSED} SELECT line_no, round(layered, 6) AS risk, layered_class AS class FROM ({LAYERED}) k",
)
def layered_risks(spark, d):
    return _layered(spark, d).select(
        "line_no",
        F.round("layered", 6).alias("risk"),
        risk.layered_class(
            F.col("hit"), F.col("rule.threat_type"), F.col("if_prediction"), F.col("rf_class")
        ).alias("class"),
    )


@check(
    "K7_layered_level",
    INPUTS,
    f"""
    WITH {FUSED} SELECT line_no, CASE WHEN hit THEN 'Critical' ELSE {LEVEL.format('layered')} END AS risk_level
    FROM ({LAYERED}) k
    """,
)
def layered_levels(spark, d):
    return _layered(spark, d).select(
        "line_no", risk.layered_level(F.col("layered"), F.col("hit")).alias("risk_level")
    )


@check(
    "K8_explanation_gate",
    INPUTS,
    f"""
    WITH {FUSED} SELECT dataset_routed, class, count(*) AS lines FROM fused
    WHERE risk >= 0.5 AND NOT coalesce(rule_score >= 0.8, false) GROUP BY 1, 2
    """,
)
def explanation_gate(spark, d):
    rows = model_rows(spark, d).where(~rules.is_short_circuit(F.col("rule.score")))
    gate = risk.wants_explanation(F.col("risk")).alias("wanted")
    fused = scoring.fuse_served(rows, ["line_no"], gate).where("wanted")
    return fused.groupBy("dataset_routed", F.col("predicted_class").alias("class")).agg(
        F.count(F.lit(1)).alias("lines")
    )


UNSCORED = (Rule("Replica", "processed", "Traffic", "", None),)


@check(
    "K9_unscored_rule_bonus",
    INPUTS,
    f"""
    WITH {FUSED} SELECT line_no, matched_rule, round(CASE WHEN matched_rule IS NOT NULL THEN least(1::DOUBLE, risk + 0.15::DOUBLE) ELSE risk END, 4) AS risk
    FROM (SELECT *, CASE WHEN regexp_matches(message, '(?i)processed') THEN 'Traffic' END AS matched_rule FROM fused) f
    """,
)
def unscored_rule_bonus(spark, d):
    rows = model_rows(spark, d).withColumn("rule", rules.rule_outcome(F.col("message"), UNSCORED))
    return scoring.fuse_served(rows, ["line_no"]).select(
        "line_no", "matched_rule", F.col("final_risk_score").alias("risk")
    )


# Session analytics -------------------------------------------------------------


@check(
    "A1_session_stats",
    INPUTS,
    f"{STATS} SELECT session_id, total_logs, total_anomalies, avg_risk_score FROM stats",
)
def session_totals(spark, d):
    return stats(spark, d).select("session_id", "total_logs", "total_anomalies", "avg_risk_score")


@check(
    "A2_risk_distribution",
    INPUTS,
    f"""{STATS}
    SELECT session_id, 'Low' AS risk_level, low AS logs FROM stats UNION ALL
    SELECT session_id, 'Medium', medium FROM stats UNION ALL SELECT session_id, 'High', high FROM stats
    """,
)
def risk_distributions(spark, d):
    return session.risk_distribution(scored(spark, d))


@check("A2_risk_distribution_map", INPUTS, f"{STATS} SELECT session_id, low, medium, high FROM stats")
def risk_distribution_maps(spark, d):
    levels = F.col("risk_distribution")
    return stats(spark, d).select(
        "session_id",
        levels["Low"].alias("low"),
        levels["Medium"].alias("medium"),
        levels["High"].alias("high"),
    )


@check("A3_threat_counts", INPUTS, f"{STATS} SELECT session_id, threat_type, logs FROM threats")
def threat_totals(spark, d):
    return session.threat_counts(scored(spark, d))


@check("A3_threat_map", INPUTS, f"{STATS} SELECT session_id, threat_type, logs FROM threats")
def threat_maps(spark, d):
    return stats(spark, d).select("session_id", F.explode("threat_types").alias("threat_type", "logs"))


@check("A4_session_dataset", INPUTS, f"{STATS} SELECT session_id, dataset_routed FROM stats")
def session_datasets(spark, d):
    return session.session_dataset(scored(spark, d), "line_no")


@check(
    "A5_requested_sessions",
    INPUTS,
    f"""{STATS}, asked AS (SELECT DISTINCT concat('s', CAST(user_id % 11 AS STRING)) AS session_id FROM events)
    SELECT a.session_id, coalesce(total_logs, 0) AS total_logs FROM asked a LEFT JOIN stats s ON a.session_id = s.session_id
    """,
)
def requested_sessions(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    asked = events.select(
        F.concat(F.lit("s"), (F.col("user_id") % 11).cast("string")).alias("session_id")
    ).distinct()
    return session.requested_stats(stats(spark, d), asked).select("session_id", "total_logs")


@check(
    "A6_top_threats",
    INPUTS,
    f"""{STATS}
    SELECT session_id, place, threat_type, logs, round(logs * 100.0::DOUBLE / total_logs, 6) AS percent FROM (
      SELECT t.*, s.total_logs, CAST(row_number() OVER (PARTITION BY t.session_id ORDER BY logs DESC, threat_type) AS INTEGER) AS place
      FROM threats t JOIN stats s ON t.session_id = s.session_id) r WHERE place <= 5
    """,
)
def top_threats(spark, d):
    return session.top_threats(stats(spark, d)).withColumn("percent", F.round("percent", 6))


@check(
    "A7_share_legend",
    INPUTS,
    f"""{STATS}
    SELECT session_id, name, logs, round(logs * 100.0::DOUBLE / total_logs, 6) AS percent FROM (
      SELECT session_id, total_logs, 'Normal' AS name, total_logs - total_anomalies AS logs FROM stats UNION ALL
      SELECT session_id, total_logs, 'Suspicious', medium FROM stats UNION ALL
      SELECT session_id, total_logs, 'Critical', high FROM stats) l
    """,
)
def share_legend(spark, d):
    return session.share_legend(stats(spark, d)).withColumn("percent", F.round("percent", 6))


@check(
    "A8_session_kpis",
    INPUTS,
    f"""{STATS}
    SELECT session_id, total_logs, total_anomalies, round(total_anomalies * 100.0::DOUBLE / total_logs, 6) AS anomaly_rate,
      total_logs - total_anomalies AS normal_logs, CAST(trunc(avg_risk_score * 100) AS INTEGER) AS risk_percent FROM stats
    """,
)
def session_kpis(spark, d):
    return session.session_kpis(stats(spark, d)).withColumn("anomaly_rate", F.round("anomaly_rate", 6))


@check(
    "A9_level_filter",
    INPUTS,
    f"{SCORED} SELECT line_no, session_id, final_risk_score FROM scored WHERE risk_level = 'Medium'",
)
def level_filter(spark, d):
    return session.filter_level(scored(spark, d), "Medium").select(
        "line_no", "session_id", "final_risk_score"
    )


@check(
    "A9_level_counts",
    INPUTS,
    f"{STATS} SELECT session_id, total_logs AS all_logs, high, medium, low FROM stats",
)
def level_counts(spark, d):
    return session.level_counts(scored(spark, d))


def _stored_results(spark, d):
    path = staging.new_path(spark, "results")
    results.write_results(scored(spark, d), order(), path)
    return results.read_results(spark, path)


NUMBERED = (
    "SELECT session_id, line_no, risk_level, final_risk_score,"
    " row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS row_no FROM scored"
)


@check(
    "A10_result_page",
    INPUTS,
    f"{SCORED} SELECT * FROM ({NUMBERED}) n WHERE row_no > 100 AND row_no <= 150",
)
def result_page(spark, d):
    page = session.result_page(_stored_results(spark, d), page=3, limit=50)
    return page.select("session_id", "line_no", "risk_level", "final_risk_score", "row_no")


@check(
    "A10_recent_and_position",
    INPUTS,
    f"""{SCORED} SELECT session_id, line_no, row_no FROM ({NUMBERED}) n WHERE row_no <= 10 OR row_no = 43""",
)
def recent_and_position(spark, d):
    stored = _stored_results(spark, d)
    return session.recent_results(stored).unionByName(session.result_at(stored, 42)).select(
        "session_id", "line_no", "row_no"
    )


@check(
    "A11_incidents",
    INPUTS,
    f"""{SCORED}
    SELECT * FROM (SELECT session_id, line_no, predicted_class,
      CAST(row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS INTEGER) AS place
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS row_no FROM scored) n
      WHERE row_no <= 100 AND final_risk_score > 0.6) i WHERE place <= 10
    """,
)
def incident_list(spark, d):
    return session.incidents(scored(spark, d), order()).select(
        "session_id", "line_no", "predicted_class", "place"
    )


@check(
    "A12_report_headline",
    INPUTS,
    f"""{STATS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY logs DESC, threat_type) AS r FROM threats)
    SELECT s.session_id, total_logs, total_anomalies, CASE WHEN avg_risk_score < 0.5 THEN 'Moderate' ELSE 'High' END AS overall_risk,
      coalesce(threat_type, 'N/A') AS top_threat
    FROM stats s LEFT JOIN ranked t ON s.session_id = t.session_id AND t.r = 1
    """,
)
def report_headline(spark, d):
    return session.report_headline(stats(spark, d))


@check(
    "A13_report_vectors",
    INPUTS,
    f"""{STATS}
    SELECT session_id, place, threat_type, logs, CASE WHEN total_anomalies > 0 THEN logs * 100 // total_anomalies END AS percent FROM (
      SELECT t.*, s.total_anomalies, CAST(row_number() OVER (PARTITION BY t.session_id ORDER BY threat_type) AS INTEGER) AS place
      FROM threats t JOIN stats s ON t.session_id = s.session_id) r WHERE place <= 3
    """,
)
def report_vectors(spark, d):
    return session.report_vectors(stats(spark, d))


# Attributions that stand in for a model's, one list per line.
SHAP_SQL = """
shap AS (SELECT line_no, [
    {'feature': 'log_hour', 'shap_value': round(iso_decision, 4)},
    {'feature': 'error', 'shap_value': round(rf_confidence - 0.5::DOUBLE, 4)},
    {'feature': 'blk', 'shap_value': round(0.25::DOUBLE - rf_confidence, 4)},
    {'feature': 'num', 'shap_value': round(iso_decision * 2, 4)},
    {'feature': 'kernel', 'shap_value': round(0.75::DOUBLE - rf_confidence, 4)}] AS features FROM model_out)
"""


def shap_rows(spark, d):
    iso, conf = F.col("iso_decision"), F.col("rf_confidence")
    values = {
        "log_hour": iso,
        "error": conf - 0.5,
        "blk": 0.25 - conf,
        "num": iso * 2,
        "kernel": 0.75 - conf,
    }
    features = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), F.round(v, 4).alias("shap_value"))
            for n, v in values.items()
        ]
    )
    return view(spark, d, "model_out").select("line_no", features.alias("features"))


@check(
    "M10_explanation_text",
    "model_out",
    f"""WITH {SHAP_SQL}, parts AS (SELECT line_no,
      array_to_string(list_transform(list_filter(features, lambda f: f.shap_value > 0)[1:3], lambda f: f.feature), ', ') AS up,
      array_to_string(list_transform(list_filter(features, lambda f: f.shap_value < 0)[1:2], lambda f: f.feature), ', ') AS down FROM shap)
    SELECT line_no, CASE WHEN up <> '' AND down <> '' THEN 'Features raising the risk: ' || up || '. Features lowering the risk: ' || down || '.'
      WHEN up <> '' THEN 'Features raising the risk: ' || up || '.' WHEN down <> '' THEN 'Features lowering the risk: ' || down || '.'
      ELSE 'No explanation available.' END AS explanation_text FROM parts
    """,
)
def explanation_texts(spark, d):
    return shap_rows(spark, d).select(
        "line_no", explain.explanation_text(F.col("features")).alias("explanation_text")
    )


DRIVERS = """array_to_string(list_transform(list_filter(features, lambda f: f.shap_value > 0),
  lambda f: CASE WHEN f.feature = 'log_hour' THEN 'Anomalous Activity Time' ELSE f.feature END), ', ')"""


@check(
    "A15_risk_drivers",
    "model_out",
    f"WITH {SHAP_SQL} SELECT line_no, {DRIVERS} AS drivers FROM shap",
)
def risk_drivers(spark, d):
    return shap_rows(spark, d).select(
        "line_no", F.array_join(session.risk_drivers(F.col("features")), ", ").alias("drivers")
    )


LOW = (
    "'The model analyzed this log and determined it matches baseline system behavior."
    " No suspicious patterns or signatures were found.'"
)


@check(
    "A14_file_insight",
    INPUTS,
    f"""{SCORED}, {SHAP_SQL}
    SELECT s.line_no, CASE WHEN risk_level = 'Low' THEN {LOW}
        WHEN is_known_threat THEN 'The AI engine identified this event as a ' || predicted_class || '. Statistical anomalies detected in the log structure.'
        WHEN {DRIVERS} = '' THEN 'The AI engine identified this event as a ' || predicted_class || '.'
        ELSE 'The AI engine identified this event as a ' || predicted_class || '. Primary Risk Drivers: ' || {DRIVERS} END AS insight,
      CASE WHEN risk_level = 'Low' THEN 'System operating normally. No action required.'
        WHEN predicted_class = 'TemporalAnomaly' THEN 'Verify if this action was authorized outside business hours|Check user access logs for compromised credentials'
        WHEN predicted_class = 'SystemFailure' OR dataset_routed = 'HDFS' THEN 'Run HDFS fsck (File System Check)|Inspect DataNode health & memory usage'
        WHEN is_known_threat OR predicted_class <> 'Normal' THEN 'Block associated IP Address immediately|Isolate affected endpoints'
        ELSE 'Flag for manual analyst review' END AS actions
    FROM scored s JOIN shap h ON s.line_no = h.line_no
    """,
)
def file_insights(spark, d):
    rows = scored(spark, d).join(shap_rows(spark, d), "line_no")
    shown = F.when(~F.col("is_known_threat"), F.col("features"))
    level, predicted = F.col("risk_level"), F.col("predicted_class")
    actions = session.file_actions(
        level, predicted, F.col("dataset_routed"), F.col("is_known_threat")
    )
    return rows.select(
        "line_no",
        session.file_insight(level, predicted, shown).alias("insight"),
        F.array_join(actions, "|").alias("actions"),
    )


@check(
    "A14_single_insight",
    INPUTS,
    f"""{SCORED}
    SELECT line_no, CASE WHEN risk_level = 'Low' THEN {LOW}
        WHEN is_known_threat THEN 'Immediate action required: This log matches a ' || matched_rule || ' signature from the rule-based security layer.'
        WHEN line_no % 2 = 0 THEN 'Features raising the risk: x.'
        ELSE 'The system identified statistical anomalies in the log structure. Further investigation is recommended.' END AS insight,
      CASE WHEN risk_level = 'Low' THEN 'System operating normally. No action required.'
        WHEN predicted_class = 'TemporalAnomaly' THEN 'Verify if this action was authorized outside business hours'
        WHEN is_known_threat OR predicted_class <> 'Normal' THEN 'Block associated IP Address immediately'
        ELSE 'Flag for manual analyst review' END AS actions
    FROM scored
    """,
)
def single_insights(spark, d):
    rows = scored(spark, d)
    explained = F.when(F.col("line_no") % 2 == 0, F.lit("Features raising the risk: x."))
    level, known = F.col("risk_level"), F.col("is_known_threat")
    return rows.select(
        "line_no",
        session.single_insight(level, known, F.col("matched_rule"), explained).alias("insight"),
        F.array_join(
            session.single_actions(level, F.col("predicted_class"), known), "|"
        ).alias("actions"),
    )


FLAGSHIP = f"""{STATS}
SELECT session_id, total_logs, total_anomalies, avg_risk_score, low, medium, high, dataset_routed,
  coalesce((SELECT string_agg(threat_type || '=' || logs, ',' ORDER BY threat_type) FROM threats t WHERE t.session_id = s.session_id), '') AS threats
FROM stats s
"""


@check("K10_session_dashboard", INPUTS, FLAGSHIP)
def session_dashboard(spark, d):
    """Raw lines and model outputs to one dashboard row per session."""
    rows = model_rows(spark, d)
    key = ["line_no", "session_id"]
    open_rows = rows.where(~rules.is_short_circuit(F.col("rule.score")))
    both = scoring.rule_hits(rows, key).unionByName(scoring.fuse_served(open_rows, key))
    levels = F.col("risk_distribution")
    threats = F.array_sort(
        F.transform(F.map_entries("threat_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )
    return session.session_stats(both, "line_no").select(
        "session_id",
        "total_logs",
        "total_anomalies",
        "avg_risk_score",
        levels["Low"].alias("low"),
        levels["Medium"].alias("medium"),
        levels["High"].alias("high"),
        "dataset_routed",
        F.array_join(threats, ",").alias("threats"),
    )


UPLOADED = 7
LINES_OF_FILES = f"SELECT line_no AS key, {TRIMMED} AS raw FROM stored_lines WHERE {TRIMMED} <> ''"
DASHBOARD = (
    "session_id, total_logs, total_anomalies, avg_risk_score, low, medium, high, dataset_routed, threats"
)


@check(
    "K10_files_to_dashboard",
    "stored_lines",
    f"""WITH RECURSIVE {fixed.served_sql(LINES_OF_FILES)},
    lines_of AS (SELECT *, 's' || key % {UPLOADED} AS session_id FROM served),
    threats AS (SELECT session_id, threat_type, count(*) AS logs FROM lines_of WHERE threat_type <> '' GROUP BY 1, 2)
    SELECT session_id, count(*) AS total_logs, CAST(count(*) FILTER (WHERE final_risk_score >= {session.ANOMALY_FROM}) AS BIGINT) AS total_anomalies,
      round(sum(final_risk_score) / count(*), 4) AS avg_risk_score, count(*) FILTER (WHERE risk_level = 'Low') AS low,
      count(*) FILTER (WHERE risk_level = 'Medium') AS medium, count(*) FILTER (WHERE risk_level = 'High') AS high,
      arg_min(dataset_routed, key) AS dataset_routed,
      coalesce((SELECT string_agg(threat_type || '=' || logs, ',' ORDER BY threat_type) FROM threats t WHERE t.session_id = l.session_id), '') AS threats
    FROM lines_of l GROUP BY session_id
    """,
)
def files_to_dashboard(spark, d):
    """Text files of seven sessions, with blank and padded lines, to published models, stored results and their statistics."""
    root = staging.new_path(spark, "uploads")
    stored = view(spark, d, "stored_lines")
    for i in range(UPLOADED):
        part = stored.where(F.col("line_no") % UPLOADED == i).orderBy("line_no").select("value").coalesce(1)
        part.write.text(f"{root}/files/s{i}")
    for bundle in fixed.bundles().values():
        models.publish(spark, f"{root}/models", bundle)
    bundles = models.load_available(spark, f"{root}/models")
    stats_of = files.analyse_files(spark, f"{root}/files", bundles, f"{root}/results")
    levels = F.col("risk_distribution")
    threats = F.array_sort(
        F.transform(F.map_entries("threat_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )
    return stats_of.select(
        "session_id",
        "total_logs",
        "total_anomalies",
        "avg_risk_score",
        levels["Low"].alias("low"),
        levels["Medium"].alias("medium"),
        levels["High"].alias("high"),
        "dataset_routed",
        F.array_join(threats, ",").alias("threats"),
    )
