"""Inputs derived from the driver tables, in SQL that Spark and DuckDB both run.

They only produce inputs: log lines, stand-in model outputs and workflow tables,
all over the whole ``events`` table.
"""

import zlib

from pyspark.sql import DataFrame, SparkSession

from cinderlog.sources.staging import materialize

LOG_LINES = """
SELECT event_id AS line_no, user_id, CAST(event_id % 10 AS INT) AS kind,
  CASE WHEN event_id % 10 BETWEEN 4 AND 8 THEN 'good'
       WHEN event_id % 10 = 9 AND event_id % 100 < 50 THEN 'good'
       ELSE 'bad' END AS file_id,
  CASE CAST(event_id % 10 AS INT)
    WHEN 0 THEN concat(day, ' ', clock, ' ', CAST(user_id AS STRING), ' ', lvl, ' dfs.DataNode$PacketResponder: ', msg)
    WHEN 1 THEN concat(day, ' ', clock, ' ', CAST(user_id AS STRING), ' ', lvl, ' dfs.FSNamesystem: BLOCK* blk_-', CAST(event_id * 7919 AS STRING), ' size ', CAST(user_id AS STRING), ' from /10.250.', CAST(user_id AS STRING), '.9:50010')
    WHEN 2 THEN concat('- 1117838570 ', dotted, ' R02-M1 ', stamp, '.000001 R02-M1 RAS KERNEL ', lvl, ' ', msg)
    WHEN 3 THEN concat(flag, ' 1117838570 ', dotted, ' R02-M1 ', stamp, '.000001 R02-M1 RAS APP ', lvl, ' ', msg)
    WHEN 4 THEN concat(substr(t, 1, 19), ' ', lvl, ' [svc', CAST(user_id % 5 AS STRING), '] ', msg)
    WHEN 5 THEN concat(substr(t, 1, 19), ' ', lvl, ' [svc', CAST(user_id % 5 AS STRING), '] ', msg)
    WHEN 6 THEN concat('Jan ', substr(t, 9, 2), ' ', substr(t, 12, 8), ' host', CAST(user_id % 3 AS STRING), ' sshd[', CAST(user_id AS STRING), ']: ', msg)
    WHEN 7 THEN concat(lvl, ' [svc', CAST(user_id % 5 AS STRING), '] ', msg)
    WHEN 8 THEN concat(lower(lvl), ' ', msg)
    ELSE concat('!@#$%^ ', CAST(event_id AS STRING))
  END AS raw
FROM (SELECT event_id, user_id, CAST(ts AS STRING) AS t,
  concat(substr(CAST(ts AS STRING), 3, 2), substr(CAST(ts AS STRING), 6, 2), substr(CAST(ts AS STRING), 9, 2)) AS day,
  concat(substr(CAST(ts AS STRING), 12, 2), substr(CAST(ts AS STRING), 15, 2), substr(CAST(ts AS STRING), 18, 2)) AS clock,
  concat(substr(CAST(ts AS STRING), 1, 4), '.', substr(CAST(ts AS STRING), 6, 2), '.', substr(CAST(ts AS STRING), 9, 2)) AS dotted,
  concat(substr(CAST(ts AS STRING), 1, 10), '-', substr(CAST(ts AS STRING), 12, 2), '.', substr(CAST(ts AS STRING), 15, 2), '.', substr(CAST(ts AS STRING), 18, 2)) AS stamp,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'FATAL' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS lvl,
  CASE CAST((event_id * 13 + user_id) % 5 AS INT) WHEN 0 THEN 'KERNDTLB' WHEN 1 THEN 'APPREAD' WHEN 2 THEN 'HWBAD' WHEN 3 THEN 'R_DDR_STR' ELSE 'FATALX' END AS flag,
  CASE CAST((event_id * 31 + user_id) % 17 AS INT)
    WHEN 0 THEN concat('Failed login attempt ', CAST(user_id AS STRING))
    WHEN 1 THEN 'UNION   SELECT username FROM users--'
    WHEN 2 THEN 'kernel panic - not syncing'
    WHEN 3 THEN 'sudo: session opened for root'
    WHEN 4 THEN concat('connection refused to port ', CAST(10000 + user_id AS STRING))
    WHEN 5 THEN 'trojan backdoor found'
    WHEN 6 THEN 'java.lang.OutOfMemoryError in worker'
    WHEN 7 THEN 'replica missing on node'
    WHEN 8 THEN 'block corrupted, retrying'
    WHEN 9 THEN 'IOException while reading'
    WHEN 10 THEN concat('Receiving block blk_', CAST(event_id AS STRING), ' src: /10.0.0.', CAST(user_id AS STRING), ':50010')
    ELSE concat('Request processed in ', CAST(user_id AS STRING), ' ms')
  END AS msg FROM events) e
"""

# Lines as a file would hold them: padded with white space, some of them blank.
STORED_LINES = f"""
SELECT line_no, file_id, CASE CAST(line_no % 6 AS INT)
    WHEN 0 THEN concat('  ', raw, ' ')
    WHEN 1 THEN concat(chr(9), raw, chr(9), ' ')
    WHEN 2 THEN concat(chr(160), ' ', raw, chr(160))
    WHEN 3 THEN '   '
    ELSE raw END AS value
FROM ({LOG_LINES}) l
"""

MODEL_OUT = """
SELECT event_id AS line_no, concat('s', CAST(user_id % 7 AS STRING)) AS session_id,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'FATAL' ELSE 'INFO' END AS level,
  (CAST((event_id * 37 + user_id) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE)) - CAST(0.5 AS DOUBLE) AS iso_decision,
  CAST((event_id * 53 + user_id * 7) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE) AS rf_confidence,
  CASE CAST((event_id * 11 + user_id) % 6 AS INT) WHEN 0 THEN 'SystemFailure' WHEN 1 THEN 'AppError' WHEN 2 THEN 'TemporalAnomaly' WHEN 3 THEN 'HardwareFailure' ELSE 'Normal' END AS rf_class,
  CASE CAST((event_id * 17 + user_id) % 9 AS INT) WHEN 0 THEN 'SystemFailure' WHEN 1 THEN 'AppError' WHEN 2 THEN 'TemporalAnomaly' ELSE 'Normal' END AS true_class
FROM events
"""

ANALYSTS = """
SELECT DISTINCT CAST(user_id % 40 AS INT) AS id, concat('analyst_', CAST(user_id % 40 AS STRING)) AS username,
  CASE WHEN user_id % 40 = 0 THEN 'Admin' WHEN user_id % 40 % 4 = 1 THEN 'Senior' ELSE 'Junior' END AS role
FROM events
"""

FEEDBACKS = """
SELECT CAST(event_id AS INT) AS id, substr(md5(CAST(event_id AS STRING)), 1, 12) AS log_id,
  concat('- 1117838570 2005.06.03 R02 2005-06-03-', lpad(CAST(user_id % 24 AS STRING), 2, '0'), '.42.50.363779 R02 RAS KERNEL INFO value ', CAST(user_id AS STRING)) AS raw_log,
  CASE CAST((event_id * 3 + user_id) % 4 AS INT) WHEN 0 THEN 'SystemFailure' WHEN 1 THEN 'BruteForce' WHEN 2 THEN '' ELSE 'Normal' END AS predicted_class,
  CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS risk_level,
  CASE CAST((event_id + user_id) % 3 AS INT) WHEN 0 THEN 'FalsePositive' WHEN 1 THEN 'Investigate' ELSE 'Correction' END AS action_type,
  CASE CAST((event_id * 7 + user_id) % 4 AS INT) WHEN 0 THEN 'Approved' WHEN 1 THEN 'Rejected' WHEN 2 THEN 'Resolved' ELSE 'Pending' END AS status,
  ts AS created_at,
  CASE WHEN user_id % 2 = 0 THEN 'short' ELSE concat('checked by hand, value ', CAST(user_id AS STRING)) END AS analyst_notes,
  CASE CAST((event_id * 5 + user_id) % 7 AS INT) WHEN 0 THEN 'Normal' WHEN 1 THEN 'SQLInjection' WHEN 2 THEN 'DDoS' WHEN 3 THEN 'SystemFailure' WHEN 4 THEN 'TemporalAnomaly' WHEN 5 THEN '' ELSE NULL END AS proposed_label,
  CAST(user_id % 30 AS INT) AS analyst_id
FROM events
"""

# A case exists for every feedback that asked for an investigation.
CASES = f"""
SELECT id + 1000000 AS id, id AS feedback_id,
  CASE WHEN id % 3 = 0 THEN NULL ELSE CAST((analyst_id * 4 + 1) % 36 AS INT) END AS assigned_analyst_id,
  CASE CAST((id * 3 + analyst_id) % 4 AS INT) WHEN 0 THEN 'Open' WHEN 1 THEN 'InProgress' WHEN 2 THEN 'Resolved' ELSE 'Closed' END AS status,
  'No resolution notes are found.' AS resolution_notes,
  'Auto-generated case from SOC Dashboard.' AS analyst_notes,
  created_at AS opened_at, CAST(NULL AS TIMESTAMP) AS closed_at
FROM ({FEEDBACKS}) f WHERE action_type = 'Investigate'
"""

# A third of all actions fall on one feedback.
FEEDBACK_ACTIONS = """
SELECT event_id AS action_id,
  CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id - event_id % 4 END AS INT) AS feedback_id,
  CASE CAST((event_id + user_id) % 6 AS INT) WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'correct' WHEN 3 THEN 'resolve' WHEN 4 THEN 'note' ELSE 'claim' END AS action,
  CAST(user_id % 30 AS INT) AS actor_id, ts AS acted_at,
  CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'Normal' WHEN 1 THEN 'DDoS' WHEN 2 THEN 'TemporalAnomaly' ELSE 'AppError' END AS label,
  concat('note ', CAST(event_id AS STRING)) AS notes
FROM events
"""

CORRECTIONS_JSON = """
SELECT event_id AS payload_id,
  CASE CAST(event_id % 3 AS INT)
    WHEN 0 THEN concat('[{"rawLog":"081109 203518 ', CAST(user_id AS STRING), ' INFO dfs.DataNode: got blk_', CAST(event_id AS STRING), '","proposedLabel":"Normal"}]')
    WHEN 1 THEN concat('[{"raw_log":"- 1117838570 2005.06.03 R02 2005-06-03-15.42.50.363779 R02 RAS KERNEL INFO x ', CAST(user_id AS STRING), '","proposed_label":"DDoS"}]')
    ELSE concat('[{"RawLog":"081109 213518 ', CAST(user_id AS STRING), ' WARN plain text line","ProposedLabel":"AppError"},{"raw_log":""}]')
  END AS payload
FROM events
"""

VIEWS = {
    "log_lines": LOG_LINES,
    "stored_lines": STORED_LINES,
    "model_out": MODEL_OUT,
    "analysts": ANALYSTS,
    "feedbacks": FEEDBACKS,
    "cases": CASES,
    "feedback_actions": FEEDBACK_ACTIONS,
    "corrections_json": CORRECTIONS_JSON,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and whole texts, spread out when the file has fewer splits than there are cores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


_stored: dict[tuple[str, str, str], DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Derived input, stored once per session as the real input would be."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        events = f"events_{zlib.crc32(sf_dir.encode()):08x}"
        table(spark, sf_dir, "events").createOrReplaceTempView(events)
        rows = spark.sql(VIEWS[name].replace("FROM events", f"FROM {events}"))
        # One file per core, as a landing folder would have many.
        parts = spark.sparkContext.defaultParallelism
        _stored[key] = materialize(rows.repartition(parts), name)
    return _stored[key]


def with_views(names: str, body: str) -> str:
    """SQL for DuckDB: the named inputs as common table expressions, then the body."""
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names.split())
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.lstrip().startswith(start):
            return f"{start}{parts} {body.replace(start, ', ', 1)}"
    return f"WITH {parts} {body}"
