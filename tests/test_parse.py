import datetime

import pytest
from pyspark.sql import functions as F

from cinderlog.functions import text
from cinderlog.functions.regex import py
from cinderlog.operators import parse


def lines(spark, *raws, file="f"):
    return spark.createDataFrame([(file, i, r) for i, r in enumerate(raws)], "file string, n int, raw string")


def parsed(spark, *raws):
    return parse.parse_generic(lines(spark, *raws)).orderBy("n").collect()


def test_standard_lines(spark):
    first, second = parsed(
        spark,
        "2025-01-20 14:30:15 ERROR [AuthService] Failed login attempt from IP 192.168.1.5",
        "2025-01-20 14:30:16 INFO [WebServer] Request processed in 45ms",
    )
    assert (first["level"], first["service"]) == ("ERROR", "AuthService")
    assert "Failed login" in first["message"]
    assert first["timestamp"] == datetime.datetime(2025, 1, 20, 14, 30, 15)
    assert second["level"] == "INFO"


def test_levels_are_respelled(spark):
    rows = parsed(
        spark,
        "2025-01-20 10:00:00 WARN [App] disk space low",
        "2025-01-20 10:00:01 FATAL [App] system crash",
    )
    assert [r["level"] for r in rows] == ["WARNING", "CRITICAL"]


def test_syslog_takes_first_word_as_level(spark):
    words, one = parsed(
        spark,
        "Jan 20 14:30:15 host sshd[12]: Failed password",
        "Jan 20 14:30:15 host cron: restart",
    )
    assert (words["level"], words["message"], words["service"]) == ("FAILED", "password", "sshd")
    assert (one["level"], one["message"]) == ("RESTAR", "t")
    assert words["timestamp"] is None


def test_simple_lines_have_empty_date(spark):
    (row,) = parsed(spark, "warning disk is full")
    assert (row["date"], row["time"], row["level"], row["service"]) == ("", "", "WARNING", "UNKNOWN")


def test_lines_with_the_separator_parse_the_same(spark):
    (row,) = parsed(spark, "2025-01-20 14:30:15 ERROR [A\u0001B] left\u0001right")
    assert (row["service"], row["message"]) == ("A\u0001B", "left\u0001right")
    (other,) = parsed(spark, "\u0001 no format")
    assert other["level"] == "UNKNOWN" and other["message"] == "\u0001 no format"


def test_unicode_classes_follow_python(spark):
    (row,) = parsed(spark, "2025-01-20 14:30:15 HATA　[Servis] bağlantı\u001ckoptu")
    assert (row["level"], row["service"]) == ("HATA", "Servis")


def test_garbage_file_is_rejected(spark):
    garbage = parse.parse_generic(lines(spark, *["!@#$%^" * 10] * 10))
    with pytest.raises(parse.ParseQualityError):
        parse.require_quality(garbage)


def test_empty_file_is_rejected(spark):
    with pytest.raises(parse.ParseQualityError):
        parse.require_quality(parse.parse_generic(lines(spark).limit(0)))


@pytest.mark.parametrize("bad, accepted", [(2, True), (3, False)])
def test_gate_is_open_at_exactly_a_fifth(spark, bad, accepted):
    raws = ["INFO fine"] * (10 - bad) + ["???"] * bad
    quality = parse.file_quality(parse.parse_generic(lines(spark, *raws))).first()
    assert quality["accepted"] is accepted


def test_dataset_examples(spark):
    hdfs, bgl = "081109 203518 143 INFO dfs.DataNode: got", (
        "- 1117838570 2005.06.03 R02-M1-N0-C:J12-U11 2005-06-03-15.42.50.363779 R02 RAS KERNEL INFO x"
    )
    raw = F.col("raw")
    rows = (
        lines(spark, hdfs, bgl)
        .select("n", text.extract_hour(raw, text.route_dataset(raw)).alias("hour"))
        .orderBy("n")
        .collect()
    )
    assert [r["hour"] for r in rows] == [20, 15]


def test_white_space_escapes_are_widened():
    assert py(r"[^\s:]+\s\S") == r"(?dU)[^\s\x1c-\x1f:]+[\s\x1c-\x1f][^\s\x1c-\x1f]"


def test_capture_runs_once_per_format(spark):
    plan = parse.parse_generic(lines(spark, "INFO x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(raw") <= 6
