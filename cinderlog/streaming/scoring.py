"""Lines scored as they arrive, the continuous form of single-line scoring."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cinderlog.operators.rules import DEFAULT_RULES, Rule
from cinderlog.plans.scoring import score_served
from cinderlog.sources.lines import TEXT, clean_lines
from cinderlog.sources.models import ModelBundle


def arriving_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Cleaned lines of new files in a folder, as a stream."""
    stream = (
        spark.readStream.schema(TEXT)
        .option("maxFilesPerTrigger", files_per_batch)
        .text(folder)
        .select(F.col("_metadata.file_path").alias("file"), "value")
    )
    return clean_lines(stream)


def score_arriving(
    lines: DataFrame,
    bundles: dict[str, ModelBundle],
    path: str,
    checkpoint: str,
    *key: str,
    rules: Sequence[Rule] = DEFAULT_RULES,
) -> StreamingQuery:
    """Score a stream of lines into a table; scoring keeps no state between lines.

    The file sink records finished batches, so a restarted query neither loses
    nor repeats a line.
    """
    scored = score_served(lines, bundles, *key, rules=rules)
    return (
        scored.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
