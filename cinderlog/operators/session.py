"""Session analytics over scored lines."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions.ordering import RowOrder, first_n
from cinderlog.schemas import NORMAL

# Cut points and sizes used by the dashboards.
ANOMALY_FROM = 0.5
INCIDENT_ABOVE = 0.6
INCIDENT_WINDOW = 100
INCIDENTS_SHOWN = 10
TOP_THREATS = 5
VECTORS_SHOWN = 3
PAGE_SIZE = 100
RISK_LEVELS = ("Low", "Medium", "High")

# Texts shown for a scored line.
INSIGHT_LOW = (
    "The model analyzed this log and determined it matches baseline system behavior. "
    "No suspicious patterns or signatures were found."
)
INSIGHT_CLASS = "The AI engine identified this event as a "
INSIGHT_DRIVERS = "Primary Risk Drivers: "
INSIGHT_NO_FEATURES = "Statistical anomalies detected in the log structure."
INSIGHT_RULE = "Immediate action required: This log matches a "
INSIGHT_RULE_END = " signature from the rule-based security layer."
INSIGHT_STATISTICAL = (
    "The system identified statistical anomalies in the log structure. "
    "Further investigation is recommended."
)
ACTION_NONE = "System operating normally. No action required."
ACTION_HOURS = "Verify if this action was authorized outside business hours"
ACTION_ACCESS = "Check user access logs for compromised credentials"
ACTION_FSCK = "Run HDFS fsck (File System Check)"
ACTION_NODE = "Inspect DataNode health & memory usage"
ACTION_BLOCK = "Block associated IP Address immediately"
ACTION_ISOLATE = "Isolate affected endpoints"
ACTION_REVIEW = "Flag for manual analyst review"
HOUR_FEATURE = "log_hour"
HOUR_DRIVER = "Anomalous Activity Time"


def _count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def session_stats(scored: DataFrame, place: str = "row_no") -> DataFrame:
    """One row per session: totals, average risk, both distributions, dataset.

    ``place`` is a line's numeric position, such as the stored row number.
    Counts by (session, threat, dataset) first and by session second: one shuffle
    of partial sums, all of them numbers that hash aggregation updates in place,
    and a huge session is a handful of rows before it meets in a single task.
    """
    risk, level = F.col("final_risk_score"), F.col("risk_level")
    by_threat = scored.groupBy("session_id", "threat_type", "dataset_routed").agg(
        F.count(F.lit(1)).alias("n"),
        _count_where(risk >= ANOMALY_FROM).alias("anomalies"),
        F.sum(risk).alias("risk"),
        *[_count_where(level == name).alias(name) for name in RISK_LEVELS],
        F.min(place).alias("place"),
    )
    merged = by_threat.groupBy("session_id", "threat_type").agg(
        *[F.sum(c).alias(c) for c in ("n", "anomalies", "risk", *RISK_LEVELS)],
        F.min(F.struct("place", "dataset_routed")).alias("first"),
    )
    threat = F.when(
        F.col("threat_type") != "", F.struct(F.col("threat_type"), F.col("n"))
    )
    return (
        merged.groupBy("session_id")
        .agg(
            F.sum("n").alias("total_logs"),
            F.sum("anomalies").alias("total_anomalies"),
            F.round(F.sum("risk") / F.sum("n"), 4).alias("avg_risk_score"),
            F.map_from_arrays(
                F.array(*[F.lit(name) for name in RISK_LEVELS]),
                F.array(*[F.sum(name) for name in RISK_LEVELS]),
            ).alias("risk_distribution"),
            F.map_from_entries(F.array_sort(F.collect_list(threat))).alias("threat_types"),
            F.min("first").alias("first"),
        )
        .withColumn("dataset_routed", F.col("first.dataset_routed"))
        .drop("first")
    )


def requested_stats(stats: DataFrame, sessions: DataFrame) -> DataFrame:
    """Stats of the requested sessions; one without lines has a total of zero."""
    return sessions.select("session_id").join(stats, "session_id", "left").withColumn(
        "total_logs", F.coalesce("total_logs", F.lit(0))
    )


def risk_distribution(scored: DataFrame) -> DataFrame:
    """Per session and level, also for levels without a line."""
    counts = scored.groupBy("session_id").agg(
        *[_count_where(F.col("risk_level") == name).alias(name) for name in RISK_LEVELS]
    )
    return counts.unpivot("session_id", list(RISK_LEVELS), "risk_level", "logs")


def threat_counts(scored: DataFrame) -> DataFrame:
    return (
        scored.where(F.col("threat_type") != "")
        .groupBy("session_id", "threat_type")
        .agg(F.count(F.lit(1)).alias("logs"))
    )


def session_dataset(scored: DataFrame, place: str = "row_no") -> DataFrame:
    """Dataset of a session: that of its first line."""
    firsts = scored.groupBy("session_id", "dataset_routed").agg(F.min(place).alias("place"))
    return firsts.groupBy("session_id").agg(
        F.min_by("dataset_routed", "place").alias("dataset_routed")
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def _threats(stats: DataFrame, *keep: str) -> DataFrame:
    return stats.select(
        "session_id", *keep, F.explode("threat_types").alias("threat_type", "logs")
    )


def _ranked(threats: DataFrame, *order: Column) -> DataFrame:
    """Threats of one session compete; there are as many as threat types."""
    return threats.withColumn(
        "place", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))
    )


def top_threats(stats: DataFrame, n: int = TOP_THREATS) -> DataFrame:
    """Most frequent threats with their share of all lines."""
    ranked = _ranked(_threats(stats, "total_logs"), F.desc("logs"), F.asc("threat_type"))
    return ranked.where(F.col("place") <= n).select(
        "session_id",
        "place",
        "threat_type",
        "logs",
        _percent(F.col("logs"), F.col("total_logs")).alias("percent"),
    )


def share_legend(stats: DataFrame) -> DataFrame:
    """Normal, Suspicious and Critical lines with their share of all lines."""
    logs = {
        "Normal": F.col("total_logs") - F.col("total_anomalies"),
        "Suspicious": F.col("risk_distribution")["Medium"],
        "Critical": F.col("risk_distribution")["High"],
    }
    parts = F.array(
        *[F.struct(F.lit(name).alias("name"), n.alias("logs")) for name, n in logs.items()]
    )
    return stats.select("session_id", "total_logs", F.inline(parts)).select(
        "session_id", "name", "logs", _percent(F.col("logs"), F.col("total_logs")).alias("percent")
    )


def session_kpis(stats: DataFrame) -> DataFrame:
    return stats.select(
        "session_id",
        "total_logs",
        "total_anomalies",
        _percent(F.col("total_anomalies"), F.col("total_logs")).alias("anomaly_rate"),
        (F.col("total_logs") - F.col("total_anomalies")).alias("normal_logs"),
        (F.col("avg_risk_score") * 100).cast("int").alias("risk_percent"),
    )


def filter_level(scored: DataFrame, risk_level: str | None = None) -> DataFrame:
    """Lines of one risk level; all of them without one."""
    return scored.where(F.col("risk_level") == risk_level) if risk_level else scored


def level_counts(scored: DataFrame) -> DataFrame:
    level = F.col("risk_level")
    return scored.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("all_logs"),
        F.count_if(level == "High").alias("high"),
        F.count_if(level == "Medium").alias("medium"),
        F.count_if(level == "Low").alias("low"),
    )


def result_page(results: DataFrame, page: int = 1, limit: int = PAGE_SIZE) -> DataFrame:
    """One page of every session present, by stored line number."""
    start = (page - 1) * limit
    row = F.col("row_no")
    return results.where((row > start) & (row <= start + limit))


def recent_results(results: DataFrame, n: int = 10) -> DataFrame:
    return result_page(results, 1, n)


def result_at(results: DataFrame, index: int) -> DataFrame:
    """The line at a zero-based position of its session."""
    return results.where(F.col("row_no") == index + 1)


def incidents(
    scored: DataFrame,
    order: RowOrder,
    window: int = INCIDENT_WINDOW,
    shown: int = INCIDENTS_SHOWN,
) -> DataFrame:
    """Risky lines among the first ones of a session, in line order."""
    head = first_n(scored, order, window, group=("session_id",))
    by_line = Window.partitionBy("session_id").orderBy(order.key())
    return (
        head.where(F.col("final_risk_score") > INCIDENT_ABOVE)
        .withColumn("place", F.row_number().over(by_line))
        .where(F.col("place") <= shown)
    )


def report_headline(stats: DataFrame) -> DataFrame:
    """Overall risk word and most frequent threat of every session."""
    entries = F.transform(
        F.map_entries("threat_types"),
        lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("threat")),
    )
    return stats.select(
        "session_id",
        "total_logs",
        "total_anomalies",
        F.when(F.col("avg_risk_score") < 0.5, "Moderate").otherwise("High").alias("overall_risk"),
        F.coalesce(F.array_min(entries)["threat"], F.lit("N/A")).alias("top_threat"),
    )


def report_vectors(stats: DataFrame, n: int = VECTORS_SHOWN) -> DataFrame:
    """First threats in name order with their whole percentage of the anomalies."""
    ranked = _ranked(_threats(stats, "total_anomalies"), F.asc("threat_type"))
    whole = F.expr("try_divide(logs * 100, total_anomalies)")
    return ranked.where(F.col("place") <= n).select(
        "session_id",
        "place",
        "threat_type",
        "logs",
        F.floor(whole).cast("long").alias("percent"),
    )


def risk_drivers(top_features: Column) -> Column:
    """Names of the features that raise the risk."""
    return F.transform(
        F.filter(top_features, lambda f: f["shap_value"] > 0),
        lambda f: F.when(f["feature"] == HOUR_FEATURE, HOUR_DRIVER).otherwise(f["feature"]),
    )


def file_insight(risk_level: Column, predicted: Column, top_features: Column) -> Column:
    drivers = risk_drivers(top_features)
    has_features = F.coalesce(F.size(top_features) > 0, F.lit(False))
    detail = F.when(
        has_features,
        F.when(F.size(drivers) > 0, F.concat(F.lit(INSIGHT_DRIVERS), F.array_join(drivers, ", "))),
    ).otherwise(INSIGHT_NO_FEATURES)
    found = F.concat(F.lit(INSIGHT_CLASS), F.coalesce(predicted, F.lit("")), F.lit("."))
    return F.when(risk_level == "Low", INSIGHT_LOW).otherwise(F.concat_ws(" ", found, detail))


def single_insight(
    risk_level: Column, is_known_threat: Column, matched_rule: Column, explanation_text: Column
) -> Column:
    return (
        F.when(risk_level == "Low", INSIGHT_LOW)
        .when(
            is_known_threat,
            F.concat(
                F.lit(INSIGHT_RULE), F.coalesce(matched_rule, F.lit("")), F.lit(INSIGHT_RULE_END)
            ),
        )
        .when(F.regexp_replace(explanation_text, r"(?U)\s", "") != "", explanation_text)
        .otherwise(INSIGHT_STATISTICAL)
    )


def _texts(*texts: str) -> Column:
    return F.array(*[F.lit(t) for t in texts])


def file_actions(
    risk_level: Column, predicted: Column, dataset: Column, is_known_threat: Column
) -> Column:
    return (
        F.when(risk_level == "Low", _texts(ACTION_NONE))
        .when(predicted == "TemporalAnomaly", _texts(ACTION_HOURS, ACTION_ACCESS))
        .when(
            (predicted == "SystemFailure") | (dataset == "HDFS"), _texts(ACTION_FSCK, ACTION_NODE)
        )
        .when(is_known_threat | (predicted != NORMAL), _texts(ACTION_BLOCK, ACTION_ISOLATE))
        .otherwise(_texts(ACTION_REVIEW))
    )


def single_actions(risk_level: Column, predicted: Column, is_known_threat: Column) -> Column:
    return (
        F.when(risk_level == "Low", _texts(ACTION_NONE))
        .when(predicted == "TemporalAnomaly", _texts(ACTION_HOURS))
        .when(is_known_threat | (predicted != NORMAL), _texts(ACTION_BLOCK))
        .otherwise(_texts(ACTION_REVIEW))
    )
