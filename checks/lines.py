"""Sources, parsers, text expressions and rules."""

import contextlib

from pyspark.sql import functions as F

from checks.registry import bgl_hour, check, hdfs_hour, hour, mask, routed, rule
from checks.views import documents, view
from cinderlog.functions import text
from cinderlog.functions.ordering import column_order, file_order
from cinderlog.operators import parse, rules
from cinderlog.sources import corrections, lines, results, soc, staging, training

# Oracle pieces -----------------------------------------------------------------

TRIMMED = "regexp_replace(value, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')"
# The log formats.
STANDARD = r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})\s+(\w+)\s+\[([^\]]+)\]\s+(.+)$"
SYSLOG = r"^(\w{3}\s+\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+\S+\s+(\S+?)(?:\[\d+\])?:\s+(\w+)?\s*(.+)$"
SIMPLE = r"(?i)^(DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL)(?:\s+\[([^\]]+)\])?\s+(.+)$"
HDFS = r"^\d{6}\s+\d{6}\s+\d+\s+(\w+)\s+[^\s:]+:\s+(.+)$"
BGL = r"^(-|[A-Z0-9_]+)\s+\d+\s+\d{4}\.\d{2}\.\d{2}\s+\S+\s+\S+\s+(\S+)\s+\S+\s+(\S+)\s+(\w+)\s+(.+)$"


def _pick(standard: str, syslog: str, simple: str, other: str) -> str:
    return (
        f"CASE WHEN regexp_matches(raw, '{STANDARD}') THEN {standard}"
        f" WHEN regexp_matches(raw, '{SYSLOG}') THEN {syslog}"
        f" WHEN regexp_matches(raw, '{SIMPLE}') THEN {simple} ELSE {other} END"
    )


def _g(pattern: str, i: int) -> str:
    return f"regexp_extract(raw, '{pattern}', {i})"


def _level(g: str) -> str:
    return f"upper(CASE WHEN {g} = '' THEN 'INFO' ELSE {g} END)"


def _service(g: str) -> str:
    return f"CASE WHEN {g} = '' THEN 'UNKNOWN' ELSE {g} END"


RAW_LEVEL = _pick(
    _level(_g(STANDARD, 3)), _level(_g(SYSLOG, 4)), _level(_g(SIMPLE, 1)), "'UNKNOWN'"
)
PARSED = f"""
SELECT *, {_pick(_g(STANDARD, 1), _g(SYSLOG, 1), "''", "NULL")} AS date,
  {_pick(_g(STANDARD, 2), _g(SYSLOG, 2), "''", "NULL")} AS time,
  {RAW_LEVEL} AS raw_level,
  {_pick(_service(_g(STANDARD, 4)), _service(_g(SYSLOG, 3)), _service(_g(SIMPLE, 2)), "'UNKNOWN'")} AS service,
  trim({_pick(_g(STANDARD, 5), _g(SYSLOG, 5), _g(SIMPLE, 3), "raw")}) AS message,
  {_pick("true", "true", "true", "false")} AS is_parsed
FROM log_lines
"""


def respelled(x: str, table: dict) -> str:
    whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items())
    return f"CASE upper({x}) {whens} ELSE upper({x}) END"


# Level spellings of the parser and of the trainer.
PARSER = {"WARN": "WARNING", "FATAL": "CRITICAL", "SEVERE": "CRITICAL", "ERR": "ERROR", "DBG": "DEBUG", "INF": "INFO"}
TRAINER = {"WARN": "WARNING", "FATAL": "CRITICAL", "ERR": "ERROR", "SEVERE": "CRITICAL"}


def _lines(spark, d):
    return view(spark, d, "log_lines")


def _text_files(spark, d):
    """The stored lines as text files, one folder per file id."""
    path = staging.new_path(spark, "text")
    view(spark, d, "stored_lines").select("file_id", "value").write.partitionBy("file_id").text(path)
    return path


# Sources -----------------------------------------------------------------------


@check(
    "S1_read_log_lines",
    "stored_lines",
    f"SELECT {TRIMMED} AS raw FROM stored_lines WHERE {TRIMMED} <> ''",
)
def read_log_lines(spark, d):
    return lines.read_log_lines(spark, _text_files(spark, d)).select("raw")


FILES_OF = 4


@check(
    "S1_numbered_lines",
    "stored_lines",
    f"""
    SELECT CAST(line_no % {FILES_OF} AS VARCHAR) AS folder, row_number() OVER (PARTITION BY line_no % {FILES_OF} ORDER BY line_no) - 1 AS line_no, {TRIMMED} AS raw
    FROM stored_lines WHERE {TRIMMED} <> ''
    """,
)
def numbered_lines(spark, d):
    """Place of every line in its file, blank lines not counted."""
    path = staging.new_path(spark, "numbered")
    stored = view(spark, d, "stored_lines")
    for i in range(FILES_OF):
        part = stored.where(F.col("line_no") % FILES_OF == i).orderBy("line_no").select("value").coalesce(1)
        part.write.text(f"{path}/{i}")
    folder = F.element_at(F.split("file", "/"), -2)
    return lines.numbered_lines(spark, path).select(folder.alias("folder"), "line_no", "raw")


@check(
    "S2_admitted_lines",
    "stored_lines",
    "SELECT 'txt' AS extension, true AS admitted, count(*) AS lines FROM stored_lines",
)
def admitted_lines(spark, d):
    path = _text_files(spark, d)
    files = lines.admit_files(spark, path)
    scanned = lines.scan_lines(spark, path)
    plain = F.regexp_replace("file", "^file:/+", "/")
    return (
        scanned.withColumn("file", plain)
        .join(files.withColumn("file", plain).drop("file_size"), "file")
        .groupBy("extension", "admitted")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


GATE_FILES = (("a.log", "log", True), ("b.TXT", "txt", True), ("c.exe", "exe", False), ("d", "", False), ("e.tar.csv", "csv", True))


@check(
    "S2_admitted_and_rejected",
    "stored_lines",
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, '{extension}' AS extension, {str(ok).lower()} AS admitted, "
        f"count(*) FILTER (WHERE {str(ok).lower()} AND {TRIMMED} <> '') AS lines FROM stored_lines WHERE line_no % 5 = {i}"
        for i, (name, extension, ok) in enumerate(GATE_FILES)
    ),
)
def admitted_and_rejected(spark, d):
    """Files of several names: the listing's verdicts, and the lines that reading then gives."""
    path = staging.new_path(spark, "gate")
    stored = view(spark, d, "stored_lines")
    for i, (name, _, _) in enumerate(GATE_FILES):
        part = stored.where(F.col("line_no") % 5 == i).orderBy("line_no").select("value").coalesce(1)
        part.write.text(f"{path}/{i}")
        _rename_part(spark, f"{path}/{i}", name)
    base = F.element_at(F.split("file", "/"), -1)
    read = lines.read_log_lines(spark, path).groupBy(base.alias("read_name")).agg(F.count(F.lit(1)).alias("lines"))
    files = lines.admit_files(spark, path).where(base.isin(*[n for n, _, _ in GATE_FILES])).select(base.alias("name"), "extension", "admitted")
    return files.join(read, F.col("name") == F.col("read_name"), "left").select(
        "name", "extension", "admitted", F.coalesce("lines", F.lit(0)).cast("long").alias("lines")
    )


def _rename_part(spark, folder: str, name: str) -> None:
    """Give a folder's only part file another name, through the file system that Spark writes to."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in system.listStatus(root) if f.getPath().getName().startswith("part-"))
    system.rename(part, jvm.org.apache.hadoop.fs.Path(root, name))


@check(
    "S7_rejected_corrections",
    "corrections_json",
    """
    WITH cut AS (SELECT payload_id, CASE CAST(payload_id % 4 AS INT) WHEN 0 THEN substr(payload, 1, length(payload) - 3)
        WHEN 1 THEN substr(payload, 2, length(payload) - 2) ELSE payload END AS payload FROM corrections_json),
    items AS (SELECT payload_id, unnest(CAST(payload AS JSON[])) AS item FROM cut WHERE payload_id % 4 > 1)
    SELECT payload_id, CASE payload_id % 4 WHEN 0 THEN 'cut short' ELSE 'not a list' END AS reason FROM cut WHERE payload_id % 4 <= 1
    UNION ALL SELECT payload_id, 'no raw line' FROM items
      WHERE coalesce(nullif(item->>'rawLog', ''), nullif(item->>'raw_log', ''), nullif(item->>'RawLog', '')) IS NULL
    """,
)
def rejected_corrections(spark, d):
    """Payloads cut short, single objects instead of lists, and items without a raw line."""
    given = view(spark, d, "corrections_json")
    n, kind = F.length("payload"), F.col("payload_id") % 4
    damaged = (
        F.when(kind == 0, F.substr("payload", F.lit(1), n - 3))
        .when(kind == 1, F.substr("payload", F.lit(2), n - 2))
        .otherwise(F.col("payload"))
    )
    return corrections.rejected_corrections(given.withColumn("payload", damaged)).select("payload_id", "reason")


@check(
    "S3_gate_lines",
    "stored_lines",
    """
    WITH firsts AS (SELECT line_no // 7 AS file, min_by(value, line_no) AS first_line FROM stored_lines GROUP BY 1),
    accepted AS (SELECT file FROM firsts WHERE trim(first_line, concat(' ', chr(9), chr(160))) <> ''
      AND (contains(first_line, 'blk_') OR contains(first_line, 'RAS') OR starts_with(first_line, '-')))
    SELECT line_no, line_no // 7 AS file FROM stored_lines WHERE line_no // 7 IN (SELECT file FROM accepted)
    """,
)
def gate_lines(spark, d):
    stored = view(spark, d, "stored_lines").withColumn("file", F.floor(F.col("line_no") / 7))
    return lines.gate_lines(stored, column_order("line_no", 1000)).select("line_no", "file")


@check(
    "S4_cap_lines",
    "stored_lines",
    f"""
    SELECT line_no, {TRIMMED} AS raw FROM stored_lines WHERE {TRIMMED} <> '' ORDER BY line_no LIMIT 777
    """,
)
def cap_lines(spark, d):
    cleaned = lines.clean_lines(view(spark, d, "stored_lines").select("line_no", "value"))
    return lines.cap_lines(cleaned, column_order("line_no", 500), 777)


@check(
    "S6_baseline_schema",
    "log_lines",
    f"""
    SELECT 'INFO' AS level, {mask('raw')} AS message, 'Normal' AS label, -1 AS hour FROM log_lines
    """,
)
def baseline_schema(spark, d):
    return training.fill_baseline(_lines(spark, d).select(text.mask(F.col("raw")).alias("message")))


@check(
    "S7_read_corrections",
    "corrections_json",
    """
    WITH items AS (SELECT payload_id, unnest(CAST(payload AS JSON[])) AS item FROM corrections_json)
    SELECT * FROM (SELECT payload_id,
      coalesce(nullif(item->>'rawLog', ''), nullif(item->>'raw_log', ''), nullif(item->>'RawLog', '')) AS raw_log,
      coalesce(nullif(item->>'proposedLabel', ''), nullif(item->>'proposed_label', ''), nullif(item->>'ProposedLabel', ''), 'Normal') AS proposed_label
    FROM items) i WHERE raw_log IS NOT NULL
    """,
)
def read_corrections(spark, d):
    return corrections.read_corrections(view(spark, d, "corrections_json")).drop("item_no")


@check(
    "S8_soc_tables",
    "feedbacks",
    "SELECT id, log_id, action_type, status, proposed_label, analyst_id FROM feedbacks",
)
def soc_tables(spark, d):
    root = staging.new_path(spark, "soc")
    feedbacks = view(spark, d, "feedbacks")
    typed = feedbacks.withColumn("created_at", F.col("created_at").cast("timestamp"))
    soc.write_soc_table(typed, root, "feedbacks")
    return soc.read_soc_table(spark, root, "feedbacks").select(
        "id", "log_id", "action_type", "status", "proposed_label", "analyst_id"
    )


@check(
    "S9_session_results",
    "model_out",
    """
    SELECT session_id, line_no, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS row_no
    FROM model_out
    """,
)
def session_results(spark, d):
    path = staging.new_path(spark, "results")
    scored = view(spark, d, "model_out").select("session_id", "line_no")
    results.write_results(scored, column_order("line_no", 1000), path)
    return results.read_results(spark, path).select("session_id", "line_no", "row_no")


@check(
    "S9_appended_sessions",
    "model_out",
    """
    SELECT session_id, line_no, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS row_no
    FROM model_out
    """,
)
def appended_sessions(spark, d):
    """Three appends, one of them interrupted before its commit and run again, one refused: each session is there once."""
    path = staging.new_path(spark, "results")
    scored = view(spark, d, "model_out").select("session_id", "line_no")
    number = F.substring("session_id", 2, 9).cast("int")
    early, late = scored.where(number < 3), scored.where(number >= 3)
    order = column_order("line_no", 1000)
    results.write_results(early, order, path)
    # What an append leaves that died before its commit.
    late.withColumns({"row_no": F.lit(-1), "bucket": F.lit(0)}).write.partitionBy("bucket").parquet(f"{path}/rows/part=lost")
    results.write_results(late, order, path)
    with contextlib.suppress(results.SessionStored):
        results.write_results(scored, order, path)
    return results.read_results(spark, path).select("session_id", "line_no", "row_no")


# Parsing -----------------------------------------------------------------------


@check(
    "P1_parse_generic",
    "log_lines",
    f"""
    SELECT line_no, date, time, {respelled('raw_level', PARSER)} AS level, service, message, is_parsed
    FROM ({PARSED}) p
    """,
)
def parse_generic(spark, d):
    return parse.parse_generic(_lines(spark, d)).select(
        "line_no", "date", "time", "level", "service", "message", "is_parsed"
    )


@check(
    "P2_unparsed_rows",
    "log_lines",
    f"""
    SELECT line_no, level, service, message FROM (
      SELECT line_no, 'UNKNOWN' AS level, 'UNKNOWN' AS service, raw AS message, {_pick('1', '1', '1', '0')} AS hit FROM log_lines
    ) u WHERE hit = 0
    """,
)
def unparsed_rows(spark, d):
    parsed = parse.parse_generic(_lines(spark, d)).where(~F.col("is_parsed"))
    return parsed.select("line_no", "level", "service", "message")


@check(
    "P3_field_defaults",
    "log_lines",
    f"""
    SELECT service, {respelled('raw_level', PARSER)} AS level, count(*) AS lines FROM ({PARSED}) p GROUP BY 1, 2
    """,
)
def field_defaults(spark, d):
    return parse.parse_generic(_lines(spark, d)).groupBy("service", "level").agg(
        F.count(F.lit(1)).alias("lines")
    )


@check(
    "P4_parser_levels",
    "log_lines",
    f"SELECT line_no, {respelled(RAW_LEVEL, PARSER)} AS level FROM log_lines",
)
def parser_levels(spark, d):
    return parse.parse_generic(_lines(spark, d)).select("line_no", "level")


@check(
    "P5_file_quality",
    "log_lines",
    f"""
    SELECT file_id, count(*) AS total, count(*) FILTER (WHERE NOT is_parsed) AS unparsed,
      round(avg(CASE WHEN is_parsed THEN 0.0 ELSE 1.0 END), 6) AS unparsed_ratio,
      avg(CASE WHEN is_parsed THEN 0.0 ELSE 1.0 END) <= 0.2 AS accepted
    FROM ({PARSED}) p GROUP BY file_id
    """,
)
def file_quality(spark, d):
    quality = parse.file_quality(parse.parse_generic(_lines(spark, d)), "file_id")
    return quality.withColumn("unparsed_ratio", F.round("unparsed_ratio", 6))


# Formats that parse and one that does not, mixed so that one file has exactly a fifth of unparsed lines.
GATED = "CASE WHEN kind IN (4, 5, 6, 7, 9) THEN 'exact' WHEN kind = 8 THEN 'clean' WHEN kind IN (0, 1) THEN 'bad' ELSE 'mixed' END"
KINDS = f"(SELECT line_no AS kind_of, kind, {GATED} AS file FROM log_lines) g"


@check(
    "P5_quality_gate",
    "log_lines",
    f"""
    WITH parsed AS (SELECT g.file, p.line_no, {respelled('raw_level', PARSER)} AS level, message, is_parsed FROM ({PARSED}) p JOIN {KINDS} ON p.line_no = kind_of),
    verdicts AS (SELECT file, count(*) AS total, count(*) FILTER (WHERE NOT is_parsed) AS unparsed FROM parsed GROUP BY file)
    SELECT p.file, true AS accepted, line_no, level, message, unparsed FROM parsed p JOIN verdicts v ON p.file = v.file WHERE 5 * unparsed <= total
    UNION ALL SELECT file, false, NULL, NULL, NULL, unparsed FROM verdicts WHERE 5 * unparsed > total
    """,
)
def quality_gate(spark, d):
    """Lines of the files that pass, and the files that do not, out of one parse."""
    rows = view(spark, d, "log_lines").withColumn("file", F.expr(GATED)).select("line_no", "file", "raw")
    accepted, verdicts = parse.quality_gate(rows)
    counts = verdicts.select(F.col("file").alias("gated"), "unparsed")
    passed = accepted.join(counts, F.col("file") == F.col("gated")).select(
        "file", F.lit(True).alias("accepted"), "line_no", "level", "message", "unparsed"
    )
    none = {"line_no": "bigint", "level": "string", "message": "string"}
    rejected = verdicts.where("NOT accepted").select("file", "accepted", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "unparsed")
    return passed.unionByName(rejected)


@check(
    "P6_timestamps",
    "log_lines",
    f"""
    SELECT line_no, TRY_CAST(CASE WHEN length(date) = 10 THEN date || ' ' || time END AS TIMESTAMP) AS timestamp
    FROM ({PARSED}) p
    """,
)
def timestamps(spark, d):
    return parse.parse_generic(_lines(spark, d)).select("line_no", "timestamp")


@check(
    "P7_parse_hdfs",
    "log_lines",
    f"""
    SELECT line_no, {respelled(_g(HDFS, 1), TRAINER)} AS level, 'HDFS' AS service, {_g(HDFS, 2)} AS message
    FROM log_lines WHERE regexp_matches(raw, '{HDFS}')
    """,
)
def parse_hdfs(spark, d):
    return parse.parse_hdfs(_lines(spark, d).select("line_no", "raw")).drop("raw")


@check(
    "P8_parse_bgl",
    "log_lines",
    f"""
    SELECT line_no, {_g(BGL, 1)} AS flag, {_g(BGL, 2)} AS node, {_g(BGL, 3)} AS service,
      {respelled(_g(BGL, 4), TRAINER)} AS level, {_g(BGL, 5)} AS message
    FROM log_lines WHERE regexp_matches(raw, '{BGL}')
    """,
)
def parse_bgl(spark, d):
    return parse.parse_bgl(_lines(spark, d).select("line_no", "raw")).drop("raw")


@check(
    "P9_trainer_levels",
    "log_lines",
    f"SELECT line_no, {respelled(RAW_LEVEL, TRAINER)} AS level FROM log_lines",
)
def trainer_levels(spark, d):
    fields = parse.generic_fields(_lines(spark, d))
    return fields.select("line_no", text.trainer_level(F.col("level")).alias("level"))


@check(
    "P10_parse_counters",
    "log_lines",
    f"""
    SELECT 'HDFS' AS dataset, count(*) AS total, count(*) FILTER (WHERE regexp_matches(raw, '{HDFS}')) AS kept,
      count(*) FILTER (WHERE NOT regexp_matches(raw, '{HDFS}')) AS skipped FROM log_lines
    UNION ALL
    SELECT 'BGL', count(*), count(*) FILTER (WHERE regexp_matches(raw, '{BGL}')),
      count(*) FILTER (WHERE NOT regexp_matches(raw, '{BGL}')) FROM log_lines
    """,
)
def parse_counters(spark, d):
    logs = _lines(spark, d)
    hdfs, bgl = (
        parse.parse_counters(logs, name).withColumn("dataset", F.lit(name))
        for name in ("HDFS", "BGL")
    )
    return hdfs.unionByName(bgl)


# Text expressions --------------------------------------------------------------


@check("T1_mask", "log_lines", f"SELECT line_no, {mask('raw')} AS masked FROM log_lines")
def masked_lines(spark, d):
    return _lines(spark, d).select("line_no", text.mask(F.col("raw")).alias("masked"))


@check(
    "T2_extract_hour",
    "log_lines",
    f"""
    SELECT line_no, {hdfs_hour('raw')} AS hdfs_hour, {bgl_hour('raw')} AS bgl_hour,
      {hour('raw', routed('raw'))} AS routed_hour FROM log_lines
    """,
)
def extracted_hours(spark, d):
    raw = F.col("raw")
    return _lines(spark, d).select(
        "line_no",
        text.extract_hour(raw, F.lit("HDFS")).alias("hdfs_hour"),
        text.extract_hour(raw, F.lit("BGL")).alias("bgl_hour"),
        text.extract_hour(raw, text.route_dataset(raw)).alias("routed_hour"),
    )


@check(
    "T3_scale_hour",
    "log_lines",
    f"""
    SELECT line_no, round(CASE WHEN h = -1 THEN 0.5 ELSE h / 23.0::DOUBLE END, 6) AS scaled
    FROM (SELECT line_no, {hdfs_hour('raw')} AS h FROM log_lines) l
    """,
)
def scaled_hours(spark, d):
    hours = text.extract_hour(F.col("raw"), F.lit("HDFS"))
    return _lines(spark, d).select("line_no", F.round(text.scale_hour(hours), 6).alias("scaled"))


@check("T4_route_dataset", "log_lines", f"SELECT line_no, {routed('raw')} AS dataset FROM log_lines")
def routed_lines(spark, d):
    return _lines(spark, d).select("line_no", text.route_dataset(F.col("raw")).alias("dataset"))


@check(
    "T5_route_fallback",
    "log_lines",
    f"""
    WITH r AS (SELECT line_no, raw, {routed('raw')} AS routed FROM log_lines),
    f AS (SELECT line_no, raw, CASE WHEN routed = 'BGL' THEN 'BGL' ELSE 'BGL (Fallback)' END AS dataset FROM r)
    SELECT line_no, dataset, {hour('raw', 'dataset')} AS hour FROM f
    """,
)
def fallback_lines(spark, d):
    raw = F.col("raw")
    return (
        _lines(spark, d)
        .withColumn("dataset", text.route_with_fallback(raw, {"BGL"}))
        .select("line_no", "dataset", text.extract_hour(raw, F.col("dataset")).alias("hour"))
    )


@check(
    "T6_route_correction",
    "log_lines",
    """
    SELECT line_no, CASE WHEN (regexp_matches(raw, '^[0-9]') AND contains(raw, 'dfs.')) OR contains(raw, 'blk_')
      THEN 'HDFS' ELSE 'BGL' END AS dataset FROM log_lines
    """,
)
def routed_corrections(spark, d):
    return _lines(spark, d).select("line_no", text.route_correction(F.col("raw")).alias("dataset"))


@check(
    "T7_route_correction_hour",
    "log_lines",
    """
    SELECT line_no, CASE WHEN regexp_matches(raw, '^[0-9]') AND (contains(raw, 'dfs.')
      OR (length(raw) > 20 AND substr(raw, 7, 1) = ' ')) THEN 'HDFS' ELSE 'BGL' END AS dataset FROM log_lines
    """,
)
def correction_hours(spark, d):
    return _lines(spark, d).select(
        "line_no", text.route_correction_hour(F.col("raw")).alias("dataset")
    )


BGL_LABEL = """CASE WHEN flag = '-' THEN 'Normal' WHEN contains(flag, 'FATAL') OR contains(flag, 'KERN') THEN 'SystemFailure'
  WHEN contains(flag, 'APP') THEN 'AppError' WHEN contains(flag, 'HARDWARE') OR contains(flag, 'HW') THEN 'HardwareFailure'
  ELSE 'UnknownAnomaly' END"""
HDFS_LABEL = """CASE WHEN level IN ('ERROR', 'CRITICAL', 'WARNING') OR contains(message, 'Exception')
  OR contains(message, 'Error') THEN 'SystemFailure' ELSE 'Normal' END"""


@check(
    "T8_bgl_label",
    "log_lines",
    f"""
    WITH f AS (SELECT line_no, upper({_g(BGL, 1)}) AS flag FROM log_lines WHERE regexp_matches(raw, '{BGL}'))
    SELECT line_no, {BGL_LABEL} AS label FROM f
    """,
)
def bgl_labels(spark, d):
    parsed = parse.parse_bgl(_lines(spark, d))
    return parsed.select("line_no", text.bgl_label(F.col("flag")).alias("label"))


@check(
    "T9_hdfs_label",
    "log_lines",
    f"""
    WITH f AS (SELECT line_no, {respelled(_g(HDFS, 1), TRAINER)} AS level, {mask(_g(HDFS, 2))} AS message
      FROM log_lines WHERE regexp_matches(raw, '{HDFS}'))
    SELECT line_no, {HDFS_LABEL} AS label FROM f
    """,
)
def hdfs_labels(spark, d):
    parsed = parse.parse_hdfs(_lines(spark, d)).withColumn("message", text.mask(F.col("message")))
    label = text.hdfs_label(F.col("level"), F.col("message"))
    return parsed.select("line_no", label.alias("label"))


KNOWN = "('CRITICAL', 'DEBUG', 'ERROR', 'INFO', 'UNKNOWN', 'WARNING')"


@check(
    "T10_known_level",
    "model_out",
    f"SELECT line_no, CASE WHEN level IN {KNOWN} THEN level ELSE 'UNKNOWN' END AS level FROM model_out",
)
def known_levels(spark, d):
    return view(spark, d, "model_out").select("line_no", text.known_level(F.col("level")).alias("level"))


@check(
    "T11_level_code",
    "model_out",
    """
    SELECT line_no, CASE level WHEN 'CRITICAL' THEN 0 WHEN 'DEBUG' THEN 1 WHEN 'ERROR' THEN 2 WHEN 'INFO' THEN 3
      WHEN 'WARNING' THEN 5 ELSE 4 END AS code FROM model_out
    """,
)
def level_codes(spark, d):
    return view(spark, d, "model_out").select("line_no", text.level_code(F.col("level")).alias("code"))


@check(
    "T1_mask_documents",
    sql=f"SELECT doc_id, md5({mask('text')}) AS masked FROM documents",
)
def masked_documents(spark, d):
    return documents(spark, d).select("doc_id", F.md5(text.mask(F.col("text"))).alias("masked"))


# Rules -------------------------------------------------------------------------


@check(
    "R1_match_rules",
    "log_lines",
    f"""
    SELECT line_no, {rule('raw', 0)} IS NOT NULL AS is_known_threat, {rule('raw', 2)} AS threat_type,
      {rule('raw', 0)} AS matched_rule, {rule('raw', 3)} AS score FROM log_lines
    """,
)
def matched_rules(spark, d):
    return rules.match_rules(_lines(spark, d), message="raw").select(
        "line_no", "is_known_threat", "threat_type", "matched_rule", "score"
    )


USER_RULES = (
    ("Replica", "replica missing", "DataLoss", 0.4),
    ("Receiving", "receiving block", "Traffic", 0.2),
)


@check(
    "R2_user_rules",
    "log_lines",
    f"""
    SELECT line_no, {rule('raw', 2, USER_RULES)} AS threat_type, {rule('raw', 3, USER_RULES)} AS score FROM log_lines
    """,
)
def user_rules(spark, d):
    extra = spark.createDataFrame(
        [(i, n, p, t, None, s) for i, (n, p, t, s) in enumerate(USER_RULES)], rules.RULES_SCHEMA
    )
    combined = rules.extend_rules(rules.read_rules(extra))
    return rules.match_rules(_lines(spark, d), combined, "raw").select(
        "line_no", "threat_type", "score"
    )


MANY = 5_000
COUNTED = "TRY_CAST(regexp_extract(raw, 'processed in ([0-9]+) ms', 1) AS INTEGER)"


@check(
    "R2_large_rule_table",
    "log_lines",
    f"""
    SELECT line_no, coalesce(name, CASE WHEN n < {MANY} THEN 'Slow' || n END) AS matched_rule, coalesce(threat, CASE WHEN n < {MANY} THEN 'Slow' || n % 7 END) AS threat_type,
      CASE WHEN name IS NOT NULL THEN score WHEN n < {MANY} THEN n % 10 / 10.0::DOUBLE END AS score
    FROM (SELECT line_no, {COUNTED} AS n, {rule('raw', 0)} AS name, {rule('raw', 2)} AS threat, {rule('raw', 3)} AS score FROM log_lines) l
    """,
)
def large_rule_table(spark, d):
    """Thousands of user rules after the default ones, over all lines."""
    extra = spark.range(MANY).select(
        F.col("id").cast("int").alias("rule_order"),
        F.concat(F.lit("Slow"), "id").alias("name"),
        F.concat(F.lit("processed\\s+in "), "id", F.lit(" ms")).alias("pattern"),
        F.concat(F.lit("Slow"), F.col("id") % 7).alias("threat_type"),
        F.lit(None).cast("string").alias("description"),
        (F.col("id") % 10 / 10.0).alias("score"),
    )
    combined = rules.extend_rules(rules.read_rules(extra))
    return rules.match_rules(_lines(spark, d), combined, "raw").select("line_no", "matched_rule", "threat_type", "score")


@check(
    "R3_short_circuit",
    "log_lines",
    f"""
    SELECT {rule('raw', 2, USER_RULES)} AS threat_type, coalesce({rule('raw', 3, USER_RULES)} >= 0.8, false) AS settled,
      count(*) AS lines FROM log_lines GROUP BY 1, 2
    """,
)
def short_circuits(spark, d):
    combined = rules.extend_rules([rules.Rule(n, p, t, "", s) for n, p, t, s in USER_RULES])
    matched = rules.match_rules(_lines(spark, d), combined, "raw")
    settled = rules.is_short_circuit(F.col("score")).alias("settled")
    return matched.groupBy("threat_type", settled).agg(F.count(F.lit(1)).alias("lines"))
