import json
from datetime import datetime

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks import fixed
from checks import models as model_checks
from checks.views import view
from cinderlog.functions.ordering import column_order
from cinderlog.operators import features, forest, iforest, parse, rules
from cinderlog.plans import caselog, reports, retrain, scoring
from cinderlog.sources import models, staging

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trained(spark):
    return model_checks.trained(spark, SF_DIR)


@pytest.fixture(scope="module")
def lines(spark):
    return view(spark, SF_DIR, "log_lines").select("line_no", "raw")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_one_pass(spark, trained, lines):
    """All datasets, rules and both forests: one scan, one Arrow function, no shuffle, rules once, no JSON."""
    plan = plan_of(scoring.score_served(lines, trained[1], "line_no"))
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan and "json" not in plan.lower().replace(SF_DIR, "")
    pattern = rules.DEFAULT_RULES[0].pattern[:24]
    assert plan.count(pattern) == 1


def test_rule_hits_and_unknown_models_have_no_features(spark, lines):
    """Nothing of a line that a rule settles reaches a model, nor of a line without one."""
    bundles = {"HDFS": fixed.bundle("HDFS")}
    routed = scoring.route_lines(lines, ["line_no"], set(bundles))
    open_line = ~rules.is_short_circuit(F.col("rule.score"))
    rows = routed.withColumns({"words": F.col("message"), "hour": F.col("extracted_hour")})
    featured = scoring.features_by_model(rows, bundles, "words", open_line)
    needed = open_line & (F.col("model") == "HDFS")
    assert featured.where(F.col("features").isNotNull() != needed).count() == 0
    assert 0 < featured.where(needed).count() < featured.count()


def test_the_class_forest_is_asked_about_odd_rows_only(spark, lines, monkeypatch):
    bundle = fixed.bundle("BGL")
    rows = lines.select("line_no", F.col("raw").alias("message"), F.lit("INFO").alias("level"), F.lit(3).alias("hour"))
    featured = features.served_features(rows, bundle.vocabulary)
    all_asked = scoring.apply_models(featured, bundle)
    odd_asked = scoring.apply_models(featured, bundle, only_odd=True)
    usual = odd_asked.where("if_prediction = 1")
    assert usual.where("rf_class IS NOT NULL OR rf_confidence <> 0").count() == 0
    odd = "line_no, if_decision, rf_class, rf_confidence".split(", ")
    assert 0 < odd_asked.where("if_prediction = -1").count() < lines.count()
    assert odd_asked.where("if_prediction = -1").select(*odd).exceptAll(all_asked.select(*odd)).count() == 0


def test_each_distinct_line_of_a_join_is_scored_once(spark):
    """A line that most rows share, null and blank lines, columns of its own names."""
    line = "- 1117838570 2005.06.03 R02 2005-06-03-15.42.50.363779 R02 RAS KERNEL INFO request"
    rows = spark.createDataFrame(
        [(i, line if i % 3 else f"{line} {i}", "x") for i in range(300)] + [(300, None, "x"), (301, " ", "x")],
        "id int, raw_log string, risk_level string",
    )
    scored = reports.rescore(rows, {"BGL": fixed.bundle("BGL")}).collect()
    assert sorted(r["id"] for r in scored) == list(range(302))
    assert {r["risk_level"] for r in scored} == {"x"}
    assert {r["id"] for r in scored if r["now_final_risk_score"] is None} == {300, 301}


def test_every_line_is_scored_once(spark, trained, lines):
    for settings in ({}, {"stage": True}, {"explained": True}, {"parse_first": True}):
        scored = scoring.score_served(lines, trained[1], "line_no", **settings)
        assert scored.count() == lines.count()
        assert scored.select("line_no").distinct().count() == lines.count()


def test_staged_scores_are_the_same(spark, trained, lines):
    plain = scoring.score_served(lines, trained[1], "line_no").drop("shap_explanation")
    staged = scoring.score_served(lines, trained[1], "line_no", stage=True).drop("shap_explanation")
    assert plain.exceptAll(staged).count() == 0


def test_lines_without_any_model_are_kept(spark, lines):
    scored = scoring.score_served(lines, {}, "line_no")
    assert scored.count() == lines.count()
    assert scored.where("is_known_threat = (final_risk_score IS NULL)").count() == 0


def test_a_brute_force_line_in_layers(spark, trained):
    bundle = trained[1]["BGL"]
    layered = models.ModelBundle(
        "BGL", "layered", bundle.vocabulary, bundle.iso, bundle.forest, bundle.classes
    )
    one = spark.createDataFrame(
        [("f", 0, "2025-01-20 14:30:15 ERROR [Auth] Failed login attempt")], "file string, n int, raw string"
    )
    row = scoring.score_layered(one, layered, column_order("n"), "file", "n").first()
    assert (row["final_risk_score"], row["risk_level"]) == (1.0, "Critical")
    assert (row["matched_rule"], row["threat_type"]) == ("BruteForce", "BruteForce")


def test_caller_level_still_triggers_the_override(spark, trained):
    one = spark.createDataFrame([(0, "FATAL", "- RAS quiet line")], "n int, level string, raw string")
    row = scoring.score_served(one, trained[1], "n", level="level").first()
    assert row["final_risk_score"] >= 0.85 and row["predicted_class"] == "SystemFailure"


CORRECTION = "message string, label string, raw_log string, proposed_label string, id int"


def corrections(spark, label, n=60):
    raw = "- 1117838570 2005.06.03 R02 2005-06-03-15.42.50.363779 R02 RAS KERNEL INFO ciod restarted node"
    return spark.createDataFrame(
        [(i, raw, label) for i in range(n)], "id int, raw_log string, proposed_label string"
    )


def test_corrections_change_the_published_model(spark, trained):
    root = staging.new_path(spark, "loop")
    models.publish(spark, root, models.load_bundle(spark, trained[1]["BGL"].path))
    before = models.current_version(spark, root, "BGL")
    given = corrections(spark, "AppError")
    result = retrain.retrain(
        spark, root, given, trained[3], ["id"], ["line_no"], **model_checks.SMALL
    ).first()
    assert result["success"] and result["previous_version"] == before
    assert models.current_version(spark, root, "BGL") == result["version"] != before
    renewed = models.load_current(spark, root, "BGL")
    assert renewed.vocabulary == trained[1]["BGL"].vocabulary
    line = given.limit(1).select(F.col("id").alias("line_no"), F.col("raw_log").alias("raw"))
    fresh = scoring.score_served(line, {"BGL": renewed}, "line_no").first()
    assert fresh["predicted_class"] == "AppError"
    models.point_to(spark, root, "BGL", before)
    assert models.current_version(spark, root, "BGL") == before


def test_a_failed_fit_leaves_the_pointer(spark, trained):
    root = staging.new_path(spark, "failing")
    models.publish(spark, root, models.load_bundle(spark, trained[1]["BGL"].path))
    before = models.current_version(spark, root, "BGL")
    # One class alone cannot train a classifier.
    results = retrain.retrain(
        spark, root, corrections(spark, "Normal"), {}, ["id"], ["line_no"], **model_checks.SMALL
    )
    row = results.first()
    assert not row["success"] and "classes" in row["reason"]
    assert models.current_version(spark, root, "BGL") == before
    assert retrain.retrain_status(results).first()["status"] == "partial_failure"


def test_isolation_forest_matches_after_reload(spark, trained):
    again = models.load_bundle(spark, trained[1]["BGL"].path)
    assert isinstance(again.iso, iforest.IsolationForestModel)
    assert again.iso.nodes.equals(trained[1]["BGL"].iso.nodes)


def test_a_stored_forest_is_the_fitted_one(spark, trained, folder):
    """MLlib's own predictions, the node table in memory and the one read back agree value by value."""
    rows = features.served_features(trained[3]["BGL"], trained[1]["BGL"].vocabulary).select("line_no", "label", "features")
    rows = staging.materialize(rows, "forest-rows")
    fitted, classes = forest.fit_forest(rows, "line_no", trees=5, depth=5)
    table = forest.ForestTable.from_model(spark, fitted)
    table.to_frame(spark).write.parquet(f"{folder}/nodes")
    again = forest.ForestTable.from_frame(spark.read.parquet(f"{folder}/nodes"), table.size)
    own = fitted.setFeaturesCol("v").transform(rows.withColumn("v", features.as_vector(F.col("features"))))
    own = own.select("line_no", vector_to_array("probability").alias("p"))
    for model in (table, again):
        ours = forest.predict(rows, model, classes).join(own, "line_no")
        names = F.array(*[F.lit(c) for c in classes])
        ours = F.transform(names, lambda c: F.col("rf_probabilities")[c]), ours
        gaps = ours[1].select(F.array_max(F.zip_with(ours[0], "p", lambda a, b: F.abs(a - b))).alias("gap"))
        assert gaps.agg(F.max("gap")).first()[0] < 1e-12


def test_arriving_lines_score_like_a_batch(spark, trained, lines, folder):
    from cinderlog.streaming.scoring import arriving_lines, score_arriving

    lines.select(F.col("raw").alias("value")).write.text(f"{folder}/in")
    stream = arriving_lines(spark, f"{folder}/in")
    score_arriving(stream, trained[1], f"{folder}/out", f"{folder}/state", "file").awaitTermination(300)
    got = spark.read.parquet(f"{folder}/out").select("raw_log", "final_risk_score", "predicted_class")
    batch = scoring.score_served(lines, trained[1], "line_no")
    wanted = batch.select("raw_log", "final_risk_score", "predicted_class")
    assert got.count() == wanted.count() and got.exceptAll(wanted).count() == 0


@pytest.fixture
def case_tables(spark):
    feedbacks = spark.createDataFrame(
        [(1, "Pending", "Investigate", None, "seen"), (2, "Pending", "FalsePositive", "Normal", None)],
        "id int, status string, action_type string, proposed_label string, analyst_notes string",
    )
    cases = spark.createDataFrame(
        [(10, 1, None, "Open", None, None), (11, 1, 3, "Open", None, None)],
        "id int, feedback_id int, assigned_analyst_id int, status string, resolution_notes string, closed_at timestamp",
    )
    when = datetime(2025, 1, 2, 3, 4)
    actions = [
        (1, 1, None, "note", 5, when, None, "first"),
        (2, 2, None, "correct", 5, when, "DDoS", "is one"),
        (3, 1, 11, "claim", 7, when, None, None),
        (4, 1, None, "resolve", 7, when, None, "done"),
        (5, 2, None, "note", 6, when, None, "late"),
        (6, 1, None, "claim", 8, when, None, None),
    ]
    log = spark.createDataFrame(
        actions, "action_id long, feedback_id int, case_id int, action string, actor_id int, acted_at timestamp, label string, notes string"
    )
    return feedbacks, cases, log


def test_a_log_folds_in_parts(spark, case_tables, folder):
    feedbacks, cases, log = case_tables
    states = []
    for name, ends in (("once", [6]), ("parts", [1, 2, 2, 5, 6, 6])):
        root = f"{folder}/{name}"
        caselog.start_state(feedbacks, cases, root)
        assert [caselog.fold_log(log.where(F.col("action_id") <= end), root) for end in ends] == ends
        states.append([sorted(map(tuple, t.collect()), key=lambda r: r[0]) for t in caselog.read_state(spark, root)])
    assert states[0] == states[1]
    (one, two), (first, second) = states[0]
    assert one[1] == "Resolved" and one[4].endswith("Update]: first")
    assert two[1:4] == ("Pending", "Correction", "DDoS") and two[4].startswith("is one") and two[4].endswith("late")
    assert first[2:4] == (8, "Resolved") and second[2:4] == (7, "Open")


def test_a_fold_that_lost_a_race_changes_nothing(spark, case_tables, folder, monkeypatch):
    feedbacks, cases, log = case_tables
    caselog.start_state(feedbacks, cases, folder)
    commit = caselog.commits.try_commit

    def beaten(session, root, number, said):
        commit(session, root, number, json.dumps({"state": "theirs", "upto": 6}))
        return commit(session, root, number, said)

    monkeypatch.setattr(caselog.commits, "try_commit", beaten)
    with pytest.raises(caselog.StateMoved):
        caselog.fold_log(log, folder)
    assert caselog._latest(spark, folder) == (2, {"state": "theirs", "upto": 6})


def test_a_bad_file_costs_only_itself(spark, folder):
    rows = [("good", i, "2025-01-20 14:30:15 ERROR [Auth] item") for i in range(8)] + [("good", 8, "???"), ("good", 9, "???"), ("bad", 0, "???")]
    lines_of = spark.createDataFrame(rows, "file string, line_no int, raw string")
    accepted, verdicts = parse.quality_gate(lines_of)
    assert accepted.groupBy("file").count().collect() == [("good", 10)]
    assert {(r["file"], r["accepted"], r["unparsed_ratio"]) for r in verdicts.collect()} == {("good", True, 0.2), ("bad", False, 1.0)}
    scored = scoring.score_layered(lines_of, fixed.bundle("BGL", "layered"), column_order("line_no"), "file", "line_no", accepted_only=True)
    assert scored.count() == 10
