import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cinderlog.functions.ordering import column_order, file_order, number_rows, numbered_order
from cinderlog.operators import prep
from cinderlog.sources import lines, models, results, staging


def write(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as out:
        out.write(data)
    return path


def test_lines_are_cleaned(spark, folder):
    write(folder, "a.log", b"  one \xc2\xa0\r\n\n \t \ntwo\xff\n\x1c three\x1f\n")
    raws = [r["raw"] for r in lines.read_log_lines(spark, folder).orderBy("line_in_block").collect()]
    assert raws == ["one", "two�", "three"]


def test_line_order_survives_splits(spark, folder):
    write(folder, "big.log", b"".join(b"line %06d\n" % i for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        read = lines.read_log_lines(spark, folder)
        assert read.select("block_start").distinct().count() > 10
        numbered = number_rows(read, file_order())
        wrong = numbered.where(F.col("raw") != F.format_string("line %06d", F.col("row_no") - 1))
        assert numbered.count() == 20000 and wrong.count() == 0
        capped = lines.read_log_lines(spark, folder, max_lines=1234)
        assert capped.count() == 1234
        assert capped.agg(F.max("raw")).first()[0] == "line 001233"
        assert lines.read_log_lines(spark, folder, max_lines="None").count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def with_splits(spark, size, run):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_training_rows_do_not_follow_splits(spark, folder):
    """Same training table and same split of it, from text files read in few tasks and in many."""
    for name in ("a.log", "b.log"):
        text = "".join(
            f"{'-' if i % 3 else 'APPREAD'} 1117838570 2005.06.03 R02-M1 2005-06-03-{i % 24:02d}.42.50.1 R02-M1 RAS KERNEL INFO item{i % 90}x done\n"
            + ("\n  \n" if i % 11 == 0 else "")
            for i in range(3000)
        )
        write(folder, name, text.encode())

    def trained():
        rows = lines.numbered_lines(spark, folder)
        splits = lines.scan_lines(spark, folder).select("file", "block_start").distinct().count()
        limits = prep.Limits(normal=2500, anomalous=900, normal_repeats={"BGL": 40}, other_repeats=25, label_repeats={})
        table = prep.prepare(rows, "BGL", numbered_order(500), "file", "line_no", limits=limits)
        split = prep.split_rows(staging.materialize(table, "table"), "file", "line_no")
        return splits, sorted(map(tuple, split.collect()), key=repr)

    few, many = (with_splits(spark, size, trained) for size in ("128m", "20000"))
    assert few[0] < many[0] and many[0] > 10
    assert few[1] == many[1] and len(few[1]) > 1000


def test_numbers_have_no_gaps(spark, folder):
    write(folder, "x.log", b"".join(b"line %06d\n\n" % i for i in range(9000)))
    rows = with_splits(spark, "7000", lambda: lines.numbered_lines(spark, folder).collect())
    assert sorted((r["line_no"], r["raw"]) for r in rows) == [(i, f"line {i:06d}") for i in range(9000)]
    write(folder, "empty.log", b"\n \n")
    assert lines.numbered_lines(spark, f"{folder}/empty.log").count() == 0


def test_admission(spark, folder):
    for name in ("a.log", "b.TXT", "c.csv", "d.exe", ".log", "e"):
        write(folder, name, b"x" * 10)
    write(folder, "big.log", b"x" * 100)
    admitted = {
        os.path.basename(r["file"]): r["admitted"]
        for r in lines.admit_files(spark, folder, max_bytes=50).collect()
    }
    assert {n for n, ok in admitted.items() if ok} == {"a.log", "b.TXT", "c.csv"}
    assert not admitted["big.log"]


def test_gate_reads_the_first_stored_line(spark, folder):
    write(folder, "good.log", b"- 1 RAS line\nanything\n")
    write(folder, "blank.log", b"\n- 1 RAS line\n")
    write(folder, "other.log", b"something else\nblk_1\n")
    gate = lines.gate_files(lines.scan_lines(spark, folder), file_order())
    accepted = {os.path.basename(r["file"]) for r in gate.where("accepted").collect()}
    assert accepted == {"good.log"}


def test_results_by_session(spark, folder):
    scored = spark.range(100).select(
        F.when(F.col("id") % 3 == 0, "007").otherwise("b").alias("session_id"),
        F.col("id").alias("line_no"),
    )
    results.write_results(scored, column_order("line_no", 9), folder, mode="overwrite")
    one = results.read_results(spark, folder, "007")
    assert [r["row_no"] for r in one.orderBy("line_no").collect()] == list(range(1, 35))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert "EqualTo(session_id,007)" in plan


def sessions(spark, *names, lines=5):
    return spark.createDataFrame([(n, i) for n in names for i in range(lines)], "session_id string, line_no long")


def test_appends_are_seen_once_committed(spark, folder, monkeypatch):
    order = column_order("line_no")
    with pytest.raises(FileNotFoundError):
        results.read_results(spark, folder)
    assert results.write_results(sessions(spark, "a", "b"), order, folder) == 1

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(results.commits, "try_commit", dies)
        with pytest.raises(OSError):
            results.write_results(sessions(spark, "c"), order, folder)
    assert {r["session_id"] for r in results.read_results(spark, folder).collect()} == {"a", "b"}
    assert results.write_results(sessions(spark, "c"), order, folder) == 2
    with pytest.raises(results.SessionStored, match="c"):
        results.write_results(sessions(spark, "c", "d"), order, folder)
    assert results.read_results(spark, folder).count() == 15
    results.write_results(sessions(spark, "e"), order, folder, mode="overwrite")
    assert {r["session_id"] for r in results.read_results(spark, folder).collect()} == {"e"}


def test_two_writers_of_one_session(spark, folder, monkeypatch):
    """The other writer commits between this one's comparison and its commit."""
    order, commit, raced = column_order("line_no"), results.commits.try_commit, []

    def beaten(session, log, number, said):
        if not raced:
            raced.append(1)
            results.write_results(sessions(session, "x", "y"), order, folder)
        return commit(session, log, number, said)

    monkeypatch.setattr(results.commits, "try_commit", beaten)
    with pytest.raises(results.SessionStored):
        results.write_results(sessions(spark, "y", "z"), order, folder)
    assert results.write_results(sessions(spark, "z"), order, folder) == 2
    assert {r["session_id"] for r in results.read_results(spark, folder).collect()} == {"x", "y", "z"}


def test_an_append_scores_its_input_once(spark, folder):
    """The input's rows are computed by one job: what it holds is read from the written part."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        seen.add(1)
        return name

    results.write_results(sessions(spark, "old"), column_order("line_no"), folder)
    scored = staging.materialize(sessions(spark, "p", "q", lines=50), "rows")
    scored = staging.materialize(scored.withColumn("session_id", counted.asNondeterministic()("session_id")), "scored")
    before = seen.value
    results.write_results(scored, column_order("line_no"), folder)
    assert before == seen.value == 100


def test_publishers_never_share_a_number(spark, folder):
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda v: models.point_to(spark, folder, "BGL", f"v{v}"), range(24)))
    assert sorted(numbers) == list(range(1, 25))
    log = {r["sequence"]: r["version"] for r in models.published_versions(spark, folder).collect()}
    assert log == {n: f"v{v}" for v, n in enumerate(numbers)}
    assert models.current_version(spark, folder, "BGL") == log[24]
    assert models.current_version(spark, folder, "HDFS") is None


def test_clocks_do_not_order_versions(spark, folder, monkeypatch):
    class Late(datetime):
        @classmethod
        def now(cls, tz=None):
            return datetime(2001, 1, 1, tzinfo=tz)

    models.point_to(spark, folder, "a/b", "first")
    monkeypatch.setattr(models, "datetime", Late)
    models.point_to(spark, folder, "a/b", "second")
    assert models.current_version(spark, folder, "a/b") == "second"
    assert models.published_versions(spark, folder).where("sequence = 2").first()["published_at"].year == 2001


def test_missing_models(spark, folder):
    with pytest.raises(models.ModelNotFound):
        models.load_current(spark, folder, "BGL")
    with pytest.raises(models.ModelNotFound):
        models.load_bundle(spark, folder + "/nothing")
    assert models.load_available(spark, folder) == {}
