"""Feedback and cases kept up to date with an action log, by new actions only."""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.operators.workflow import apply_actions_to_cases, apply_actions_to_feedback
from cinderlog.sources import commits


class StateMoved(RuntimeError):
    """Another writer committed a state meanwhile; fold again from there."""


def _latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    rows = commits.entries(spark, f"{root}/commits").collect()
    if not rows:
        raise FileNotFoundError(f"no state under {root}")
    last = max(rows, key=lambda r: r["sequence"])
    return last["sequence"], json.loads(last["value"])


def _store(spark: SparkSession, root: str, sequence: int, feedbacks: DataFrame, cases: DataFrame, upto: int | None) -> None:
    name = uuid.uuid4().hex
    feedbacks.write.parquet(f"{root}/states/{name}/feedbacks")
    cases.write.parquet(f"{root}/states/{name}/cases")
    if not commits.try_commit(spark, f"{root}/commits", sequence, json.dumps({"state": name, "upto": upto})):
        raise StateMoved(f"state {sequence} under {root} was committed by another writer")


def start_state(feedbacks: DataFrame, cases: DataFrame, root: str) -> None:
    """The first state: nothing of the log is folded in."""
    _store(feedbacks.sparkSession, root, 1, feedbacks, cases, None)


def read_state(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Feedback and cases of the last committed state."""
    _, said = _latest(spark, root)
    return tuple(spark.read.parquet(f"{root}/states/{said['state']}/{name}") for name in ("feedbacks", "cases"))


def fold_log(actions: DataFrame, root: str) -> int | None:
    """Fold the actions after the last folded one into the state; returns the last id that is folded in.

    Ids grow along the log.  Folding in parts gives what folding at once gives, as each action changes
    the state that the ones before it left.  A state is committed whole; a run that dies before its
    commit leaves the old one, and running again folds the same actions.
    """
    spark = actions.sparkSession
    sequence, said = _latest(spark, root)
    new = actions if said["upto"] is None else actions.where(F.col("action_id") > said["upto"])
    last = new.agg(F.max("action_id")).first()[0]
    if last is None:
        return said["upto"]
    feedbacks, cases = read_state(spark, root)
    changed = apply_actions_to_feedback(feedbacks, cases, new), apply_actions_to_cases(cases, new)
    _store(spark, root, sequence + 1, *changed, int(last))
    return int(last)
