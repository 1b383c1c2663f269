"""Case reports with the models' present view of the reported line."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.regex import strip
from cinderlog.operators.rules import DEFAULT_RULES, Rule
from cinderlog.operators.workflow import case_reports
from cinderlog.plans.scoring import score_served
from cinderlog.schemas import SCORED_COLUMNS
from cinderlog.sources.models import ModelBundle

#: The re-score's columns carry this, as feedback has a predicted class and a risk level of its own.
PREFIX = "now_"


def rescore(
    rows: DataFrame,
    bundles: dict[str, ModelBundle],
    raw: str = "raw_log",
    rules: Sequence[Rule] = DEFAULT_RULES,
    explained: bool = False,
) -> DataFrame:
    """Add ``now_...`` columns: what the published models say about each row's raw line.

    Rows of a join repeat their lines, so every distinct line is scored once and joined back; a
    line that many rows share is split by the adaptive join.  Rows whose line is null or blank
    have nothing to score: they keep their place beside the join and get nulls.
    """
    line = strip(F.col(raw))
    scorable = F.coalesce(line != "", F.lit(False))
    asked = rows.where(scorable)
    distinct = asked.select(line.alias("__line")).distinct()
    shown = [c for c in SCORED_COLUMNS if c not in ("raw_log", "message")]
    scored = score_served(distinct, bundles, "__line", rules=rules, raw="__line", explained=explained)
    scored = scored.select("__line", *[F.col(c).alias(PREFIX + c) for c in shown])
    matched = asked.withColumn("__line", line).join(scored, "__line", "left").drop("__line")
    empty = [F.lit(None).cast(scored.schema[PREFIX + c].dataType).alias(PREFIX + c) for c in shown]
    return matched.unionByName(rows.where(~scorable).select("*", *empty))


def rescored_reports(
    feedbacks: DataFrame,
    cases: DataFrame,
    analysts: DataFrame,
    bundles: dict[str, ModelBundle],
    rules: Sequence[Rule] = DEFAULT_RULES,
    explained: bool = False,
) -> DataFrame:
    """Every feedback with author, first case and assignee, and its raw log scored anew at level INFO."""
    return rescore(case_reports(feedbacks, cases, analysts), bundles, rules=rules, explained=explained)
