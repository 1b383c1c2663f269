"""Named queries with the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, views: str = "", sql: str | None = None):
    """Register a query; ``views`` names the derived inputs its SQL reads."""

    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql
        return query

    return register


def mask(x: str) -> str:
    for pattern, to in (
        (r"blk_-?\d+", "<BLK>"),
        (r"/?\d+\.\d+\.\d+\.\d+:\d+", "<IP>"),
        (r"\b\d+\b", "<NUM>"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def hdfs_hour(x: str) -> str:
    return rf"coalesce(TRY_CAST(regexp_extract({x}, '^\d{{6}}\s(\d{{2}})\d{{4}}', 1) AS INTEGER), -1)"


def bgl_hour(x: str) -> str:
    return (
        rf"coalesce(TRY_CAST(regexp_extract({x}, '\d{{4}}-\d{{2}}-\d{{2}}-(\d{{2}})\.\d{{2}}\.\d{{2}}', 1)"
        " AS INTEGER), -1)"
    )


def hour(x: str, dataset: str) -> str:
    return f"CASE {dataset} WHEN 'HDFS' THEN {hdfs_hour(x)} WHEN 'BGL' THEN {bgl_hour(x)} ELSE -1 END"


def routed(x: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({x}, '^\d{{6}}\s+\d{{6}}\s+') OR contains({x}, 'dfs.DataNode')"
        f" OR contains({x}, 'Receiving block') OR contains({x}, 'blk_') THEN 'HDFS' ELSE 'BGL' END"
    )


# The oracle's own copy of the rules: name, pattern, threat, score.
RULES = (
    ("BruteForce", r"(failed (login|password|auth)|authentication failure|invalid (user|password)|too many (attempts|failures))", "BruteForce", 1.0),
    ("SQLInjection", r"(union\s+select|drop\s+table|insert\s+into|''--|\bOR\b\s+1=1|xp_cmdshell|exec\s*\(|script>)", "SQLi", 1.0),
    ("SystemFailure", r"(kernel panic|out of memory|oom killer|segmentation fault|stack overflow|fatal error|system crash|disk full|machine check|uncorrectable)", "SystemFailure", 0.95),
    ("PrivilegeEscalation", r"(sudo|su root|privilege escalat|unauthorized access|permission denied.*root|setuid)", "PrivilegeEscalation", 1.0),
    ("PortScan", r"(port scan|nmap|masscan|syn flood|connection refused.*\d{4,5})", "PortScan", 0.85),
    ("MalwareIndicator", r"(ransomware|malware|trojan|backdoor|c2|command.and.control|\.exe.*download|base64.*payload)", "Malware", 1.0),
)


def rule(x: str, part: int, extra: tuple = ()) -> str:
    """Name (0), threat (2) or score (3) of the first rule that matches."""

    def value(r):
        return f"'{r[part]}'" if part != 3 else f"CAST({r[3]} AS DOUBLE)"

    whens = " ".join(
        f"WHEN regexp_matches({x}, '(?i){r[1]}') THEN {value(r)}" for r in (*RULES, *extra)
    )
    return f"CASE {whens} END"
