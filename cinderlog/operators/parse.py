"""Line parsers: raw text to typed columns, one projection each."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions import text
from cinderlog.functions.regex import (
    SEPARATOR,
    group_array,
    packed_groups,
    py,
    strip,
    unpack_groups,
)
from cinderlog.sources.staging import materialize

# Log formats, tried in this order, most specific first.
STANDARD = r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})\s+(\w+)\s+\[([^\]]+)\]\s+(.+)$"
SYSLOG = r"^(\w{3}\s+\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+\S+\s+(\S+?)(?:\[\d+\])?:\s+(\w+)?\s*(.+)$"
SIMPLE = r"^(DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL)(?:\s+\[([^\]]+)\])?\s+(.+)$"
HDFS = r"^\d{6}\s+\d{6}\s+\d+\s+(\w+)\s+[^\s:]+:\s+(.+)$"
BGL = r"^(-|[A-Z0-9_]+)\s+\d+\s+\d{4}\.\d{2}\.\d{2}\s+\S+\s+\S+\s+(\S+)\s+\S+\s+(\S+)\s+(\w+)\s+(.+)$"

MAX_UNPARSED = 0.20

# The generic formats with their groups in the order date, time, level, service, message.
GENERIC_FORMATS = (
    (py(STANDARD), (1, 2, 3, 4, 5)),
    (py(SYSLOG), (1, 2, 4, 3, 5)),
    (py(SIMPLE, ignore_case=True), (0, 0, 1, 2, 3)),
)

FIELDS = ("date", "time", "level", "service", "message", "is_parsed")


class ParseQualityError(ValueError):
    """A file is empty, or too many of its lines fit no known format."""


def _groups(
    df: DataFrame, raw: str, formats: list[tuple[Column, str, tuple[int, ...]]]
) -> DataFrame:
    """Add ``__g``, the groups of the format whose condition holds."""
    line = F.col(raw)
    packed = groups = None
    for condition, pattern, order in formats:
        packed = (F if packed is None else packed).when(
            condition, packed_groups(line, pattern, order)
        )
        groups = (F if groups is None else groups).when(
            condition, group_array(line, pattern, order)
        )
    count = max(len(order) for *_, order in formats)
    return df.withColumn("__p", packed).withColumn(
        "__g",
        F.when(~line.contains(SEPARATOR), unpack_groups(F.col("__p"), count)).otherwise(groups),
    )


def generic_fields(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the fields of the first matching format, the line as message otherwise."""
    line = F.col(raw)
    number = None
    for i, (pattern, _) in enumerate(GENERIC_FORMATS):
        number = (F if number is None else number).when(line.rlike(pattern), F.lit(i))
    numbered = lines.withColumn("__format", number)
    found = _groups(
        numbered,
        raw,
        [(F.col("__format") == i, *f) for i, f in enumerate(GENERIC_FORMATS)],
    )
    is_parsed, g = F.col("__format").isNotNull(), F.col("__g")
    unknown = F.lit("UNKNOWN")
    level = F.upper(F.coalesce(F.nullif(g[2], F.lit("")), F.lit("INFO")))
    rest = [F.col(c) for c in lines.columns if c not in FIELDS]
    return found.select(
        *rest,
        g[0].alias("date"),
        g[1].alias("time"),
        F.when(is_parsed, level).otherwise(unknown).alias("level"),
        F.coalesce(F.nullif(g[3], F.lit("")), unknown).alias("service"),
        F.when(is_parsed, strip(g[4])).otherwise(line).alias("message"),
        is_parsed.alias("is_parsed"),
    )


def parse_generic(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``date, time, level, service, message, timestamp, is_parsed``."""
    return generic_fields(lines, raw).withColumns(
        {
            "level": text.parser_level(F.col("level")),
            "timestamp": F.try_to_timestamp(
                F.concat_ws(" ", F.col("date"), F.col("time")),
                F.lit("yyyy-MM-dd HH:mm:ss"),
            ).cast("timestamp_ntz"),
        }
    )


def file_quality(
    parsed: DataFrame, file: str = "file", max_unparsed: float = MAX_UNPARSED
) -> DataFrame:
    """Per file: lines, unparsed lines, their share and whether the file passes."""
    return (
        parsed.groupBy(file)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(~F.col("is_parsed")).alias("unparsed"),
        )
        .withColumn("unparsed_ratio", F.col("unparsed") / F.col("total"))
        .withColumn("accepted", F.col("unparsed_ratio") <= max_unparsed)
    )


def quality_gate(
    lines: DataFrame, file: str = "file", raw: str = "raw", max_unparsed: float = MAX_UNPARSED
) -> tuple[DataFrame, DataFrame]:
    """Parsed lines of the files that pass, and every file's verdict.

    Lines are parsed once, into a stored table that both results read; a bad file costs its own
    lines and nothing else.
    """
    parsed = materialize(parse_generic(lines, raw), "parsed")
    verdicts = materialize(file_quality(parsed, file, max_unparsed), "file-verdicts")
    passed = verdicts.where("accepted").select(F.col(file).alias("__passed"))
    return parsed.join(passed, parsed[file].eqNullSafe(F.col("__passed")), "left_semi"), verdicts


def require_quality(
    parsed: DataFrame, file: str = "file", max_unparsed: float = MAX_UNPARSED
) -> DataFrame:
    """The parsed lines, or an error naming the first files that do not pass."""
    summary = (
        file_quality(parsed, file, max_unparsed)
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.count_if(~F.col("accepted")).alias("rejected"),
            F.min(F.when(~F.col("accepted"), F.col(file).cast("string"))).alias("example"),
        )
        .first()
    )
    if summary["files"] == 0:
        raise ParseQualityError("no lines to parse")
    if summary["rejected"]:
        raise ParseQualityError(
            f"{summary['rejected']} of {summary['files']} files have too many "
            f"unparsed lines, e.g. {summary['example']}"
        )
    return parsed


def _captured(lines: DataFrame, raw: str, pattern: str, groups: int) -> DataFrame:
    """Matching lines with their groups; the filter sits right above the scan."""
    matcher = py(pattern)
    matching = lines.where(F.col(raw).rlike(matcher))
    return _groups(matching, raw, [(F.lit(True), matcher, tuple(range(1, groups + 1)))])


def parse_hdfs(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Lines in HDFS format with ``level, service, message``; others are skipped."""
    g = F.col("__g")
    return _captured(lines, raw, HDFS, 2).select(
        *lines.columns,
        text.trainer_level(g[0]).alias("level"),
        F.lit("HDFS").alias("service"),
        g[1].alias("message"),
    )


def parse_bgl(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Lines in BGL format with ``flag, node, service, level, message``."""
    g = F.col("__g")
    return _captured(lines, raw, BGL, 5).select(
        *lines.columns,
        g[0].alias("flag"),
        g[1].alias("node"),
        g[2].alias("service"),
        text.trainer_level(g[3]).alias("level"),
        g[4].alias("message"),
    )


TRAINING_FORMATS = {"HDFS": HDFS, "BGL": BGL}


def parse_counters(lines: DataFrame, dataset: str, raw: str = "raw") -> DataFrame:
    """One row: lines read, lines kept and lines skipped by a dataset's format."""
    kept = F.count_if(F.col(raw).rlike(py(TRAINING_FORMATS[dataset])))
    return lines.agg(F.count(F.lit(1)).alias("total"), kept.alias("kept")).withColumn(
        "skipped", F.col("total") - F.col("kept")
    )
