"""Names for helper columns beside columns of any name."""

from pyspark.sql import DataFrame


def free_name(df: DataFrame, wanted: str) -> str:
    """The wanted name, with as many underscores as keep it apart from the table's columns (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
