import random
import re

import pytest
from pyspark.sql import functions as F

from cinderlog.functions import literals, risk
from cinderlog.operators import rules
from cinderlog.operators.rules import DEFAULT_RULES, Rule
from cinderlog.plans import scoring


def outcome(spark, message, rule_set=DEFAULT_RULES):
    df = spark.createDataFrame([(message,)], "message string")
    return rules.match_rules(df, rule_set).first()


@pytest.mark.parametrize(
    "message, threat",
    [
        ("Failed login attempt from 10.0.0.1", "BruteForce"),
        ("GET /?id=1 UNION SELECT password FROM users", "SQLi"),
        ("User logged in successfully", None),
        ("kernel panic - not syncing", "SystemFailure"),
        ("permission denied for ROOT", "PrivilegeEscalation"),
        ("connection refused on 65001", "PortScan"),
        ("connection refused", None),
        ("abc2def", "Malware"),
        ("Kernel panic", "SystemFailure"),
        ("şifre: invalid uſer", "BruteForce"),
    ],
)
def test_default_rules(spark, message, threat):
    row = outcome(spark, message)
    assert row["threat_type"] == threat
    assert row["is_known_threat"] is (threat is not None)


def test_hints_hold_for_every_branch(spark):
    """A rule with hints finds what the bare pattern finds."""
    samples = [
        "failed login", "failed password", "failed auth", "authentication failure", "invalid user",
        "invalid password", "too many attempts", "too many failures", "union  select", "drop table",
        "insert into", "x'--", " or 1=1", "xp_cmdshell", "exec (", "script>", "kernel panic",
        "out of memory", "oom killer", "segmentation fault", "stack overflow", "fatal error",
        "system crash", "disk full", "machine check", "uncorrectable", "sudo", "su root",
        "privilege escalation", "unauthorized access", "permission denied root", "setuid", "port scan",
        "nmap", "masscan", "syn flood", "connection refused 1234", "ransomware", "malware", "trojan",
        "backdoor", "c2", "command and control", "x.exe download", "base64 payload",
    ]
    df = spark.createDataFrame([(s,) for s in samples + [s.upper() for s in samples]], "message string")
    bare = [Rule(r.name, r.pattern, r.threat_type, r.description, r.score) for r in DEFAULT_RULES]
    missed = rules.match_rules(df).exceptAll(rules.match_rules(df, bare))
    assert missed.count() == 0
    assert rules.match_rules(df).where("is_known_threat").count() == df.count()


def test_user_rules_come_last_and_may_be_many(spark):
    extra = [Rule(f"r{i}", f"needle{i}$", f"T{i}", "", 0.9) for i in range(250)]
    combined = rules.extend_rules(extra)
    assert outcome(spark, "needle249", combined)["matched_rule"] == "r249"
    assert outcome(spark, "sudo needle7", combined)["threat_type"] == "PrivilegeEscalation"


@pytest.mark.parametrize(
    "score, level",
    [(0.0, "Low"), (0.49, "Low"), (0.50, "Medium"), (0.79, "Medium"), (0.80, "High"), (1.0, "High")],
)
def test_levels(spark, score, level):
    row = spark.range(1).select(
        risk.served_level(F.lit(score)).alias("served"),
        risk.layered_level(F.lit(score), F.lit(False)).alias("layered"),
        risk.layered_level(F.lit(score), F.lit(True)).alias("rule"),
    ).first()
    assert (row["served"], row["layered"], row["rule"]) == (level, level, "Critical")


def test_level_comes_from_the_unrounded_risk(spark):
    """A risk of 0.49996 is Low, yet its rounded score counts as an anomaly."""
    row = spark.createDataFrame(
        [(1, "INFO", "m", "m", "BGL", -1, -0.24990, 1, "AppError", 0.33334)],
        "line_no int, level string, message string, raw_log string, dataset_routed string, extracted_hour int,"
        " if_decision double, if_prediction int, rf_class string, rf_confidence double",
    ).withColumn("rule", rules.rule_outcome(F.col("message")))
    row = row.withColumn("if_decision", F.lit(0.00011))
    row = row.withColumn("rf_confidence", F.lit((0.49996 - 0.4 * (1 - 0.50011)) / 0.6))
    fused = scoring.fuse_served(row, ["line_no"]).first()
    assert (fused["risk_level"], fused["final_risk_score"]) == ("Low", 0.5)


def test_literals_that_matches_demand():
    assert literals.demanded("processed in 5 ms") == "processed in 5 ms"
    assert literals.demanded(r"Disk\s+FULLY?") == "disk"
    assert literals.demanded(r"a.*timeouts{2}x") == "timeout"
    assert literals.demanded(r"ab+cd") is None and literals.demanded("one|two") is None and literals.demanded("(abcdef)") is None
    assert literals.demanded(r"error\.log") == "error.log"


def test_many_rules_give_what_a_chain_gives(spark):
    """Random patterns and awkward texts: automaton, native chain and Python's own search agree."""
    chance = random.Random(3)
    patterns = ["disk full", r"d\w+k", "ſpecial", "kelvin", r"timeouts?", "a|zz", r"x{2,}y", r"\bid=\d+", "İstanbul", r"full.*disk"] + [f"code {i}" for i in range(200)]
    made = [rules.Rule(f"r{i}", p, f"t{i % 5}", "", i / 300, ()) for i, p in enumerate(patterns)]
    parts = ["DISK", "full", " ", "disk", "code 7", "CODE 199", "Kelvin", "\u212aelvin", "speCial", "\u017fpecial", "timeout", "xxy", "id=5", "\u0130stanbul", "zz", "\n"]
    texts = [None, ""] + ["".join(chance.choice(parts) for _ in range(chance.randrange(6))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, message string")
    told = df.select("n", "message", rules.table_outcome(F.col("message"), made).alias("o")).collect()
    for r in told:
        own = next((i for i, p in enumerate(patterns) if r["message"] is not None and re.search(p, r["message"], re.IGNORECASE)), None)
        assert r["o"]["matched_rule"] == (None if own is None else f"r{own}")
        assert r["o"]["is_known_threat"] == (own is not None)
    ascii_rules = [r for r in made if r.pattern.isascii()][:60]
    plain = df.where(F.length("message") == F.octet_length("message"))
    chain = plain.select("n", rules.rule_outcome(F.col("message"), ascii_rules).alias("o")).select("n", "o.matched_rule", "o.score")
    table = plain.select("n", rules.table_outcome(F.col("message"), ascii_rules).alias("o")).select("n", "o.matched_rule", "o.score")
    assert chain.exceptAll(table).count() == 0 == table.exceptAll(chain).count()


def test_the_plan_does_not_grow_with_the_rules(spark):
    df = spark.createDataFrame([("x",)], "message string")
    sizes = []
    for n in (200, 5000):
        made = [rules.Rule(f"r{i}", f"word {i}", "t", "", 0.1) for i in range(n)]
        sizes.append(len(rules.match_rules(df, made)._jdf.queryExecution().toString()))
    assert abs(sizes[0] - sizes[1]) < 200
