"""Ordered threat rules: the first pattern found in a message wins."""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.functions import literals
from cinderlog.functions.regex import py
from cinderlog.functions.risk import RULE_CUTOFF

cloudpickle.register_pickle_by_value(literals)


@dataclass(frozen=True)
class Rule:
    """A threat rule.

    ``hints`` are lower-case strings of which every ASCII match holds at least
    one.  They are optional: plain text search rules most lines out much faster
    than a case-insensitive alternation.
    """

    name: str
    pattern: str
    threat_type: str
    description: str
    score: float | None
    hints: tuple[str, ...] = ()


# The default rule set, in matching order.
DEFAULT_RULES = (
    Rule(
        "BruteForce",
        r"(failed (login|password|auth)|authentication failure|invalid (user|password)|too many (attempts|failures))",
        "BruteForce",
        "Repeated failed authentication",
        1.0,
        ("failed ", "authentication failure", "invalid ", "too many "),
    ),
    Rule(
        "SQLInjection",
        r"(union\s+select|drop\s+table|insert\s+into|'--|\bOR\b\s+1=1|xp_cmdshell|exec\s*\(|script>)",
        "SQLi",
        "SQL or script injection",
        1.0,
        ("union", "drop", "insert", "'--", "1=1", "xp_cmdshell", "exec", "script>"),
    ),
    Rule(
        "SystemFailure",
        r"(kernel panic|out of memory|oom killer|segmentation fault|stack overflow|fatal error|system crash|disk full|machine check|uncorrectable)",
        "SystemFailure",
        "Critical system fault",
        0.95,
        (
            "kernel panic",
            "out of memory",
            "oom killer",
            "segmentation fault",
            "stack overflow",
            "fatal error",
            "system crash",
            "disk full",
            "machine check",
            "uncorrectable",
        ),
    ),
    Rule(
        "PrivilegeEscalation",
        r"(sudo|su root|privilege escalat|unauthorized access|permission denied.*root|setuid)",
        "PrivilegeEscalation",
        "Attempt to gain privileges",
        1.0,
        (
            "sudo",
            "su root",
            "privilege escalat",
            "unauthorized access",
            "permission denied",
            "setuid",
        ),
    ),
    Rule(
        "PortScan",
        r"(port scan|nmap|masscan|syn flood|connection refused.*\d{4,5})",
        "PortScan",
        "Port scanning",
        0.85,
        ("port scan", "nmap", "masscan", "syn flood", "connection refused"),
    ),
    Rule(
        "MalwareIndicator",
        r"(ransomware|malware|trojan|backdoor|c2|command.and.control|\.exe.*download|base64.*payload)",
        "Malware",
        "Malware indicator",
        1.0,
        ("ransomware", "malware", "trojan", "backdoor", "c2", "command", ".exe", "base64"),
    ),
)

RULES_SCHEMA = T.StructType(
    [
        T.StructField("rule_order", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("threat_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

# A rule table is configuration.  A short one becomes part of the plan; a longer one goes to the workers as data.
MAX_RULES = 10_000
INLINE_RULES = 100

OUTCOME = "is_known_threat boolean, threat_type string, matched_rule string, description string, score double"


def read_rules(rules: DataFrame) -> tuple[Rule, ...]:
    """Rules of a ``rules`` table, in order; refuses one too big for a plan."""
    rows = rules.orderBy("rule_order").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a rule table may hold {MAX_RULES} rules at most")
    return tuple(
        Rule(r["name"], r["pattern"], r["threat_type"], r["description"], r["score"])
        for r in rows
    )


def extend_rules(
    extra: Sequence[Rule], rules: Sequence[Rule] = DEFAULT_RULES
) -> tuple[Rule, ...]:
    return (*rules, *extra)


def _outcome(rule: Rule | None) -> Column:
    def text(value):
        return F.lit(value).cast("string")

    return F.struct(
        F.lit(rule is not None).alias("is_known_threat"),
        text(rule and rule.threat_type).alias("threat_type"),
        text(rule and rule.name).alias("matched_rule"),
        text(rule and rule.description).alias("description"),
        F.lit(rule.score if rule else None).cast("double").alias("score"),
    )


def _matches(message: Column, rule: Rule) -> Column:
    found = message.rlike(py(rule.pattern, ignore_case=True))
    if not rule.hints:
        return found
    # Beyond ASCII other letters fold to these ones, so the hints do not apply.
    lowered = F.lower(message)
    possible = F.length(message) != F.octet_length(message)
    for hint in rule.hints:
        possible = possible | lowered.contains(hint)
    return possible & found


def rule_outcome(message: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Struct describing the first rule that matches, or no match at all.

    Up to ``INLINE_RULES`` rules are a chain of conditions on the JVM that stops at its first hit.  More
    are matched by :func:`table_outcome`, whose plan does not grow with them; both give the same rows.
    """
    if len(rules) > INLINE_RULES:
        return table_outcome(message, rules)
    chain = None
    for rule in rules:
        chain = (F if chain is None else chain).when(_matches(message, rule), _outcome(rule))
    return _outcome(None) if chain is None else F.coalesce(chain, _outcome(None))


def table_outcome(message: Column, rules: Sequence[Rule]) -> Column:
    """The same for many rules: an automaton over literals finds the rules that a message can match at all.

    Every match of a rule holds one of its literals (its hints, or the longest one that its pattern
    demands), so only the rules whose literals occur are tried, in order.  Rules without any
    literal are tried on every message.  Messages of a batch are looked at once each.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"a rule table may hold {MAX_RULES} rules at most")
    shared = SparkSession.active().sparkContext.broadcast(
        [(r.pattern, r.hints, (True, r.threat_type, r.name, r.description, None if r.score is None else float(r.score))) for r in rules]
    )
    names = [f.split()[0] for f in OUTCOME.split(", ")]
    kinds = [pa.bool_(), pa.string(), pa.string(), pa.string(), pa.float64()]

    @F.arrow_udf(OUTCOME)
    def outcome(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = literals.Matcher([(pattern, hints) for pattern, hints, _ in shared.value])
        outcomes = [*[told for _, _, told in shared.value], (False, None, None, None, None)]
        for batch in batches:
            encoded = batch.dictionary_encode()
            first = [matcher.first(text) for text in encoded.dictionary.to_pylist()]
            rows = [outcomes[-1 if i is None else first[i]] for i in encoded.indices.to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    # Stops the optimizer from repeating the call for each use of its result.
    return outcome.asNondeterministic()(message)


def match_rules(
    df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, message: str = "message"
) -> DataFrame:
    """Add ``is_known_threat, threat_type, matched_rule, description, score``."""
    matched = df.withColumn("__rule", rule_outcome(F.col(message), rules))
    return matched.select(*df.columns, "__rule.*")


def is_short_circuit(score: Column) -> Column:
    """Whether a rule hit settles the line without any model."""
    return F.coalesce(score >= RULE_CUTOFF, F.lit(False))
