"""Scalar expressions over a raw line: masking, hours, routing, labels, levels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderlog.functions.regex import py
from cinderlog.schemas import LEVEL_CODES, LEVELS

# Masks, in the order they apply.
MASKS = (
    (r"blk_-?\d+", "<BLK>"),
    (r"/?\d+\.\d+\.\d+\.\d+:\d+", "<IP>"),
    (r"\b\d+\b", "<NUM>"),
)

# Where each dataset keeps the hour.
HOUR_PATTERNS = {
    "HDFS": r"^\d{6}\s(\d{2})\d{4}",
    "BGL": r"\d{4}-\d{2}-\d{2}-(\d{2})\.\d{2}\.\d{2}",
}

UNKNOWN_HOUR = -1
FALLBACK_DATASET = "BGL (Fallback)"

# Level spellings.
PARSER_LEVELS = {
    "WARN": "WARNING",
    "FATAL": "CRITICAL",
    "SEVERE": "CRITICAL",
    "ERR": "ERROR",
    "DBG": "DEBUG",
    "INF": "INFO",
}
TRAINER_LEVELS = {
    "WARN": "WARNING",
    "FATAL": "CRITICAL",
    "ERR": "ERROR",
    "SEVERE": "CRITICAL",
}


def mask(text: Column) -> Column:
    """Replace block ids, ip:port pairs and bare numbers by placeholders."""
    for pattern, placeholder in MASKS:
        text = F.regexp_replace(text, py(pattern), placeholder)
    return text


def extract_hour(raw: Column, dataset: Column) -> Column:
    """Hour digits of a line in its dataset's format, -1 if there are none."""
    hour = None
    for name, pattern in HOUR_PATTERNS.items():
        digits = F.regexp_extract(raw, py(pattern), 1).try_cast("int")
        hour = (F if hour is None else hour).when(dataset == name, digits)
    return F.coalesce(hour, F.lit(UNKNOWN_HOUR))


def scale_hour(hour: Column) -> Column:
    """Hour over 23; an unknown hour sits in the middle."""
    return F.when(hour == UNKNOWN_HOUR, F.lit(0.5)).otherwise(hour / F.lit(23.0))


def route_dataset(raw: Column) -> Column:
    """Dataset whose model scores the line."""
    hdfs = (
        raw.rlike(py(r"^\d{6}\s+\d{6}\s+"))
        | raw.contains("dfs.DataNode")
        | raw.contains("Receiving block")
        | raw.contains("blk_")
    )
    return F.when(hdfs, "HDFS").otherwise("BGL")


def route_with_fallback(raw: Column, loaded: set[str]) -> Column:
    """Routed dataset, or the fallback label where that dataset has no model."""
    routed = route_dataset(raw)
    if not loaded:
        return F.lit(FALLBACK_DATASET)
    return F.when(routed.isin(*sorted(loaded)), routed).otherwise(FALLBACK_DATASET)


def _starts_with_digit(raw: Column) -> Column:
    return raw.rlike("^[0-9]")


def route_correction(raw: Column) -> Column:
    """Dataset whose model a correction retrains."""
    hdfs = (_starts_with_digit(raw) & raw.contains("dfs.")) | raw.contains("blk_")
    return F.when(hdfs, "HDFS").otherwise("BGL")


def route_correction_hour(raw: Column) -> Column:
    """Dataset format from which a correction's hour is read."""
    fixed_width = (F.length(raw) > 20) & (F.substring(raw, 7, 1) == " ")
    hdfs = _starts_with_digit(raw) & (raw.contains("dfs.") | fixed_width)
    return F.when(hdfs, "HDFS").otherwise("BGL")


def bgl_label(flag: Column) -> Column:
    """Training label for a BGL alert flag."""
    up = F.upper(flag)
    return (
        F.when(flag == "-", "Normal")
        .when(up.contains("FATAL") | up.contains("KERN"), "SystemFailure")
        .when(up.contains("APP"), "AppError")
        .when(up.contains("HARDWARE") | up.contains("HW"), "HardwareFailure")
        .otherwise("UnknownAnomaly")
    )


def hdfs_label(level: Column, message: Column) -> Column:
    """Training label for an HDFS line, from its level and masked message."""
    failed = (
        level.isin("ERROR", "CRITICAL", "WARNING")
        | message.contains("Exception")
        | message.contains("Error")
    )
    return F.when(failed, "SystemFailure").otherwise("Normal")


def _respell(level: Column, spellings: dict[str, str]) -> Column:
    upper = F.upper(level)
    out = None
    for spelling, name in spellings.items():
        out = (F if out is None else out).when(upper == spelling, name)
    return out.otherwise(upper)


def parser_level(level: Column) -> Column:
    return _respell(level, PARSER_LEVELS)


def trainer_level(level: Column) -> Column:
    return _respell(level, TRAINER_LEVELS)


def known_level(level: Column) -> Column:
    """The level itself, or UNKNOWN when the encoder has never heard of it."""
    return F.when(level.isin(*LEVELS), level).otherwise("UNKNOWN")


def level_code(level: Column) -> Column:
    known = known_level(level)
    out = None
    for name, code in LEVEL_CODES.items():
        out = (F if out is None else out).when(known == name, F.lit(code))
    return out
