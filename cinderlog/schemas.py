"""Explicit schemas and the enumerations shared by the operators."""

from pyspark.sql import types as T

# Level names; the encoder numbers them in alphabetical order.
LEVELS = ("CRITICAL", "DEBUG", "ERROR", "INFO", "UNKNOWN", "WARNING")
LEVEL_CODES = {name: code for code, name in enumerate(LEVELS)}

# Labels an analyst may propose for a correction.
CORRECTION_LABELS = (
    "Normal",
    "BruteForce",
    "SQLInjection",
    "DDoS",
    "SystemFailure",
    "AppError",
    "HardwareFailure",
    "UnknownAnomaly",
)

NORMAL = "Normal"

TRAIN_ROWS = T.StructType(
    [
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("hour", T.IntegerType()),
    ]
)

SHAP = T.StructType(
    [
        T.StructField(
            "top_features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("feature", T.StringType()),
                        T.StructField("shap_value", T.DoubleType()),
                        T.StructField("direction", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("base_value", T.DoubleType()),
        T.StructField("explanation_text", T.StringType()),
    ]
)

# Columns of a scored line, after the caller's own key columns.
SCORED_COLUMNS = (
    "level",
    "message",
    "raw_log",
    "dataset_routed",
    "extracted_hour",
    "is_known_threat",
    "threat_type",
    "matched_rule",
    "if_prediction",
    "if_anomaly_score",
    "predicted_class",
    "rf_confidence",
    "final_risk_score",
    "risk_level",
    "shap_explanation",
)

ANALYSTS = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("username", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

FEEDBACKS = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("log_id", T.StringType()),
        T.StructField("raw_log", T.StringType()),
        T.StructField("predicted_class", T.StringType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("action_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("analyst_notes", T.StringType()),
        T.StructField("proposed_label", T.StringType()),
        T.StructField("analyst_id", T.IntegerType()),
    ]
)

CASES = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("feedback_id", T.IntegerType()),
        T.StructField("assigned_analyst_id", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("resolution_notes", T.StringType()),
        T.StructField("analyst_notes", T.StringType()),
        T.StructField("opened_at", T.TimestampType()),
        T.StructField("closed_at", T.TimestampType()),
    ]
)

# Payload objects are read as maps: their key spelling differs by sender.
CORRECTIONS_JSON = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
