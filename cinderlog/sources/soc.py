"""Relational tables of the analyst workflow."""

from pyspark.sql import DataFrame, SparkSession

from cinderlog.schemas import ANALYSTS, CASES, FEEDBACKS

TABLES = {"analysts": ANALYSTS, "feedbacks": FEEDBACKS, "cases": CASES}


def read_soc_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def write_soc_table(rows: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    columns = [f.name for f in TABLES[name] if f.name in rows.columns]
    rows.select(*columns).write.mode(mode).parquet(f"{root}/{name}")


def read_soc_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    id_column: str,
    bounds: tuple[int, int],
    partitions: int,
) -> DataFrame:
    """A workflow table straight from the database, read in parallel by id range."""
    return spark.read.jdbc(
        url,
        table,
        column=id_column,
        lowerBound=bounds[0],
        upperBound=bounds[1],
        numPartitions=partitions,
        properties=properties,
    )
