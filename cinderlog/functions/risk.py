"""Risk fusion: model outputs to score, class and level."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderlog.schemas import NORMAL

RULE_CUTOFF = 0.8
HIGH = 0.80
MEDIUM = 0.50
EXPLAIN_FROM = 0.50


def anomaly_probability(decision: Column) -> Column:
    """Isolation-forest decision value turned into a probability of being odd."""
    clipped = F.least(F.greatest(decision, F.lit(-0.5)), F.lit(0.5))
    flipped = F.lit(1.0) - (clipped + F.lit(0.5))
    return F.least(F.greatest(flipped, F.lit(0.0)), F.lit(1.0))


def served_base_risk(predicted: Column, anomaly: Column, confidence: Column) -> Column:
    return F.when(predicted == NORMAL, anomaly * F.lit(0.3)).otherwise(
        F.lit(0.4) * anomaly + F.lit(0.6) * confidence
    )


def _severe(level: Column, message: Column) -> Column:
    text = F.lower(message)
    return (
        level.isin("ERROR", "CRITICAL", "FATAL")
        | text.contains("outofmemory")
        | text.contains("corrupted")
    )


def _suspicious(level: Column, message: Column) -> Column:
    return level.isin("WARN", "WARNING") | F.lower(message).contains("missing")


def override_risk(risk: Column, level: Column, message: Column) -> Column:
    """Risk floor for severe levels or keywords, a lower one for warnings."""
    return (
        F.when(_severe(level, message), F.greatest(risk, F.lit(0.85)))
        .when(_suspicious(level, message), F.greatest(risk, F.lit(0.65)))
        .otherwise(risk)
    )


def override_class(predicted: Column, level: Column, message: Column) -> Column:
    return (
        F.when(_severe(level, message), "SystemFailure")
        .when(_suspicious(level, message) & (predicted == NORMAL), "SystemFailure")
        .otherwise(predicted)
    )


def unscored_rule_bonus(risk: Column, threat: Column, rule_score: Column) -> Column:
    """Bonus for a rule that names a threat but carries no score."""
    hit = threat.isNotNull() & (threat != "") & rule_score.isNull()
    return F.when(hit, F.least(F.lit(1.0), risk + F.lit(0.15))).otherwise(risk)


def served_level(risk: Column) -> Column:
    return F.when(risk >= HIGH, "High").when(risk >= MEDIUM, "Medium").otherwise("Low")


def layered_level(risk: Column, rule_hit: Column) -> Column:
    return F.when(rule_hit, "Critical").otherwise(served_level(risk))


def threat_of(predicted: Column) -> Column:
    return F.nullif(predicted, F.lit(NORMAL))


def layered_risk(
    rule_hit: Column, if_prediction: Column, anomaly: Column, confidence: Column
) -> Column:
    return (
        F.when(rule_hit, F.lit(1.0))
        .when(if_prediction == 1, anomaly * F.lit(0.2))
        .otherwise(F.lit(0.4) * anomaly + F.lit(0.6) * confidence)
    )


def layered_class(
    rule_hit: Column, threat: Column, if_prediction: Column, predicted: Column
) -> Column:
    return (
        F.when(rule_hit, threat)
        .when(if_prediction == 1, F.lit(NORMAL))
        .otherwise(predicted)
    )


def wants_explanation(risk: Column) -> Column:
    return risk >= EXPLAIN_FROM
