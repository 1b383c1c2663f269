"""From uploaded files to stored results and a dashboard row per session."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.functions.ordering import numbered_order
from cinderlog.operators.rules import DEFAULT_RULES, Rule
from cinderlog.operators.session import session_stats
from cinderlog.plans.scoring import score_served
from cinderlog.sources.lines import numbered_lines
from cinderlog.sources.models import ModelBundle
from cinderlog.sources.results import read_results, write_results

#: Lines of a file that are ordered together.
STRETCH = 1 << 20


def analyse_files(
    spark: SparkSession,
    paths: str | list[str],
    bundles: dict[str, ModelBundle],
    store: str,
    rules: Sequence[Rule] = DEFAULT_RULES,
    explained: bool = False,
    max_bytes: int | None = None,
) -> DataFrame:
    """Score the admitted files' lines once, append them to ``store``, and give each stored session's statistics.

    A session is the folder that holds its files, in order of their names.  Files that are not
    admitted are never opened, blank lines are dropped, and every line is at level INFO.  What is
    returned is read from the store, so it covers earlier appends too.
    """
    lines = numbered_lines(spark, paths, max_bytes)
    session = F.url_decode(F.element_at(F.split("file", "/"), -2))
    scored = score_served(
        lines.withColumn("session_id", session), bundles, "session_id", "file", "line_no", rules=rules, explained=explained
    )
    write_results(scored, numbered_order(STRETCH), store)
    return session_stats(read_results(spark, store))
