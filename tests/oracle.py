"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

TYPES = {
    "string": {"VARCHAR"},
    "int": {"INTEGER"},
    "bigint": {"BIGINT"},
    "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"},
    "timestamp": {"TIMESTAMP", "TIMESTAMP WITH TIME ZONE"},
}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def compare(df, con, sql: str) -> list[str]:
    """Differences between the two results; an empty list means they agree."""
    problems = []
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    theirs_types = {r[0]: r[1] for r in described}
    ours_types = dict(df.dtypes)
    if set(theirs_types) != set(ours_types):
        return [f"columns {sorted(ours_types)} vs {sorted(theirs_types)}"]
    for name, kind in ours_types.items():
        if theirs_types[name] not in TYPES.get(kind, {kind}):
            problems.append(f"type of {name}: {kind} vs {theirs_types[name]}")
    names = sorted(ours_types)
    ours = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    result = con.execute(sql)
    position = {d[0]: i for i, d in enumerate(result.description)}
    theirs = [tuple(_plain(r[position[n]]) for n in names) for r in result.fetchall()]
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} vs {len(theirs)}")
    left = sorted(ours, key=repr)
    right = sorted(theirs, key=repr)
    if left != right:
        mine, other = set(map(repr, left)), set(map(repr, right))
        problems.append(
            f"columns {names}: only Spark {sorted(mine - other)[:3]}, "
            f"only SQL {sorted(other - mine)[:3]}"
        )
    return problems
