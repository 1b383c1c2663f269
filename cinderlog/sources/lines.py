"""Raw text files to ordered lines, with the checks made on whole files."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

from cinderlog.functions.ordering import RowOrder, file_order, first_n
from cinderlog.functions.regex import strip
from cinderlog.sources.staging import materialize

# What may be uploaded.
EXTENSIONS = ("log", "txt", "csv")
UPLOAD_BYTES = 50 * 1024 * 1024

TEXT = StructType([StructField("value", StringType())])
NO_CAP = "None"


def _extension(file: Column) -> Column:
    name = F.element_at(F.split(file, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*\.([^.]*)$", 1))


def _admitted(file: Column, size: Column, max_bytes: int | None) -> Column:
    """Whether a file may be analysed, by its name and size."""
    known = _extension(file).isin(*EXTENSIONS)
    return known if max_bytes is None else known & (size <= max_bytes)


def scan_lines(spark: SparkSession, paths: str | list[str], max_bytes: int | None = None) -> DataFrame:
    """Every line of the admitted files as stored, with its order key and its file's size.

    The test reads file names and sizes only, so other files are never opened.
    """
    size = F.col("_metadata.file_size")
    return (
        spark.read.schema(TEXT)
        .option("recursiveFileLookup", "true")
        .text(paths)
        .where(_admitted(F.col("_metadata.file_path"), size, max_bytes))
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_in_block"),
            "value",
        )
    )


def clean(value: Column) -> Column:
    """Valid UTF-8 with white space trimmed."""
    return strip(F.make_valid_utf8(value))


def clean_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Replace ``value`` by the cleaned ``raw`` and drop blank lines."""
    rest = [c for c in lines.columns if c != value]
    return lines.select(*rest, clean(F.col(value)).alias("raw")).where("raw <> ''")


def read_log_lines(
    spark: SparkSession,
    paths: str | list[str],
    max_lines: int | str | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Clean, non-blank lines of the admitted files; :func:`admit_files` lists the others."""
    lines = clean_lines(scan_lines(spark, paths, max_bytes)).drop("file_size")
    return cap_lines(lines, file_order(), max_lines)


def numbered_lines(spark: SparkSession, paths: str | list[str], max_bytes: int | None = None) -> DataFrame:
    """(file, line_no, raw): clean, non-blank lines with their place in the file, from 0 without gaps.

    The place is the same however the files are split into tasks, so hashes of (file, line_no)
    choose the same rows on any cluster.  The lines are stored with the split they came from; a
    split's lines are counted, the counts of a file's earlier splits added up, and each line's place
    follows without sorting any lines.
    """
    read = clean_lines(scan_lines(spark, paths, max_bytes)).drop("file_size", "line_in_block")
    # Numbered after blank lines are gone: a split's numbers have no gaps.
    stored = materialize(read.withColumn("__at", F.monotonically_increasing_id()), "numbered-lines")
    splits = stored.groupBy("file", "block_start").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select(
        "file", "block_start", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")
    )
    return stored.join(shifts, ["file", "block_start"]).select(
        "file", (F.col("__at") + F.col("__shift")).alias("line_no"), "raw"
    )


def cap_lines(
    lines: DataFrame, order: RowOrder, max_lines: int | str | None = None
) -> DataFrame:
    """First ``max_lines`` non-blank lines in order; ``None`` or 'None' keeps all."""
    if max_lines is None or max_lines == NO_CAP:
        return lines
    return first_n(lines, order, int(max_lines))


def admit_files(
    spark: SparkSession, paths: str | list[str], max_bytes: int | None = None
) -> DataFrame:
    """One row per file: extension, size, and whether it may be analysed.

    Reads the listing only, never a file's content.  ``UPLOAD_BYTES`` is the limit for
    files that come in by hand; stored collections have none.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(paths)
        .select(F.col("path").alias("file"), F.col("length").alias("file_size"))
    )
    return files.withColumns(
        {
            "extension": _extension(F.col("file")),
            "admitted": _admitted(F.col("file"), F.col("file_size"), max_bytes),
        }
    )


def known_format(value: Column) -> Column:
    """Whether a line looks like one of the supported log formats."""
    looks_right = (
        value.contains("blk_") | value.contains("RAS") | value.startswith("-")
    )
    return F.coalesce((strip(value) != "") & looks_right, F.lit(False))


def gate_files(
    lines: DataFrame, order: RowOrder, file: str = "file", value: str = "value"
) -> DataFrame:
    """One row per file: its first stored line and whether that has a known format."""
    # Of a scanned file only the first split can hold the first line.
    starts = lines.where("block_start = 0") if "block_start" in lines.columns else lines
    return (
        starts.groupBy(file)
        .agg(F.min_by(value, order.key()).alias("first_line"))
        .withColumn("accepted", known_format(F.col("first_line")))
    )


def gate_lines(
    lines: DataFrame, order: RowOrder, file: str = "file", value: str = "value"
) -> DataFrame:
    """Lines of the files that pass :func:`gate_files`."""
    accepted = gate_files(lines, order, file, value).where("accepted")
    return lines.join(accepted.select(file), file, "left_semi")
