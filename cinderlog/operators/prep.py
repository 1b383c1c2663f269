"""Training-set preparation: labels, augmentation, caps, dedup, splits, samples."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions import text
from cinderlog.functions.hashing import digest, hash_unit
from cinderlog.functions.ordering import (
    LIMIT,
    RowOrder,
    first_n,
    hash_order,
    mark_first_n,
)
from cinderlog.operators import parse
from cinderlog.schemas import NORMAL
from cinderlog.sources.staging import materialize

SEED = 42
TEMPORAL = "TemporalAnomaly"
RARE_LABEL = "UnknownAnomaly"

# Shares and limits of the training set.
TEMPORAL_SHARE = 0.05
TEMPORAL_HOURS = 6
NORMAL_CAP = 5_000_000
ANOMALY_CAP = 1_000_000
NORMAL_REPEATS = {"HDFS": 1000, "BGL": 500}
LABEL_REPEATS = {"SystemFailure": 5000, "AppError": 5000}
OTHER_REPEATS = 50
LOW_ANOMALY_RATIO = 0.01
CONTAMINATION_RANGE = (0.01, 0.49)
TEST_SHARE = 0.2
BASELINE_ROWS = 2000

TRAIN_COLUMNS = ("level", "message", "label", "hour")


def label_lines(lines: DataFrame, dataset: str, raw: str = "raw") -> DataFrame:
    """Parsed, masked and labelled training rows of one dataset."""
    masked = text.mask(F.col("message"))
    if dataset == "HDFS":
        rows = parse.parse_hdfs(lines, raw).withColumn("message", masked)
        label = text.hdfs_label(F.col("level"), F.col("message"))
    else:
        rows = parse.parse_bgl(lines, raw).withColumn("message", masked)
        label = text.bgl_label(F.col("flag"))
    hour = text.extract_hour(F.col(raw), F.lit(dataset))
    return rows.withColumns({"label": label, "hour": hour}).select(
        *[c for c in lines.columns if c != raw],
        "level",
        "service",
        "message",
        "label",
        "hour",
    )


def augment_temporal(
    rows: DataFrame, *key: str, seed: int = SEED, share: float = TEMPORAL_SHARE
) -> DataFrame:
    """Turn a share of Normal rows into night-time anomalies.

    The choice is a function of the row's key, so a retried or moved task makes
    the same one.
    """
    columns = [F.col(k) for k in key]
    chosen = (F.col("label") == NORMAL) & (hash_unit(f"{seed}-pick", *columns) < share)
    night = F.floor(hash_unit(f"{seed}-hour", *columns) * TEMPORAL_HOURS).cast("int")
    marked = rows.withColumn("__chosen", chosen)
    return marked.withColumns(
        {
            "hour": F.when(F.col("__chosen"), night).otherwise(F.col("hour")),
            "label": F.when(F.col("__chosen"), TEMPORAL).otherwise(F.col("label")),
        }
    ).drop("__chosen")


def cap_classes(
    rows: DataFrame,
    order: RowOrder,
    normal: int = NORMAL_CAP,
    anomalous: int = ANOMALY_CAP,
) -> DataFrame:
    """First Normal rows and first other rows in line order, each up to its cap."""
    sided = rows.withColumn("__normal", F.col("label") == NORMAL)
    cap = F.when(F.col("__normal"), F.lit(normal)).otherwise(F.lit(anomalous))
    return first_n(sided, order, cap, group=("__normal",)).drop("__normal")


@dataclass(frozen=True)
class Limits:
    """How many labelled rows a fit takes: caps of both sides, and repeats of a message by label."""

    normal: int = NORMAL_CAP
    anomalous: int = ANOMALY_CAP
    normal_repeats: dict[str, int] = field(default_factory=lambda: dict(NORMAL_REPEATS))
    label_repeats: dict[str, int] = field(default_factory=lambda: dict(LABEL_REPEATS))
    other_repeats: int = OTHER_REPEATS


def repeat_limit(label: Column, dataset: str, limits: Limits = Limits()) -> Column:
    limit = F.when(label == NORMAL, F.lit(limits.normal_repeats[dataset]))
    for name, repeats in limits.label_repeats.items():
        limit = limit.when(label == name, F.lit(repeats))
    return limit.otherwise(F.lit(limits.other_repeats))


def limit_repeats(
    rows: DataFrame, order: RowOrder, dataset: str, limit: Column | None = None
) -> DataFrame:
    """First rows of every (label, message), as many as the label allows."""
    n = repeat_limit(F.col("label"), dataset) if limit is None else limit
    return first_n(rows, order, n, group=("label", "message"))


def shuffle_rows(rows: DataFrame, *key: str, seed: int = SEED) -> DataFrame:
    """Rows in a seeded random order that does not depend on partitioning."""
    return rows.orderBy(digest(seed, *[F.col(k) for k in key]), *key)


def label_distribution(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy("label")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "label")
    )


def contamination(ratio: Column) -> Column:
    low, high = CONTAMINATION_RANGE
    return F.least(F.greatest(ratio, F.lit(low)), F.lit(high))


def anomaly_summary(rows: DataFrame) -> DataFrame:
    """One row: anomaly ratio, whether it is worryingly low, and contamination."""
    odd = F.when(F.col("label") != NORMAL, 1.0).otherwise(0.0)
    return rows.agg(F.avg(odd).alias("anomaly_ratio")).select(
        "anomaly_ratio",
        (F.col("anomaly_ratio") < LOW_ANOMALY_RATIO).alias("low_ratio"),
        contamination(F.col("anomaly_ratio")).alias("contamination"),
    )


def merge_rare(rows: DataFrame, min_rows: int = 2) -> DataFrame:
    """Relabel classes with fewer than ``min_rows`` rows as one catch-all class."""
    rare = (
        rows.groupBy("label")
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") < min_rows)
        .select("label", F.lit(True).alias("__rare"))
    )
    return (
        rows.join(rare, "label", "left")
        .withColumn(
            "label", F.when(F.col("__rare"), RARE_LABEL).otherwise(F.col("label"))
        )
        .select(*rows.columns)
    )


def test_sizes(rows: DataFrame, share: float = TEST_SHARE) -> DataFrame:
    """Test rows per label: ``ceil(share * n)`` shared out by largest remainder.

    Works on label counts.  With a label of fewer than two rows the split is not
    stratified, which the caller sees as one group, NULL.
    """
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    packed = counts.agg(
        F.sum("n").alias("total"),
        F.min("n").alias("smallest"),
        F.array_sort(F.collect_list(F.struct("label", "n"))).alias("labels"),
    )
    test = F.ceil(F.col("total") * F.lit(share))
    each = packed.where(F.col("smallest") >= 2).select(
        test.alias("test"), "total", F.explode("labels").alias("c")
    )
    quota = F.col("test") * F.col("c.n") / F.col("total")
    shares = each.select(
        F.col("c.label").alias("label"),
        F.floor(quota).alias("base"),
        (quota - F.floor(quota)).alias("rest"),
        "test",
    )
    ranked = shares.groupBy("test").agg(
        (F.first("test") - F.sum("base")).alias("spare"),
        F.array_sort(
            F.collect_list(
                F.struct((-F.col("rest")).alias("rest"), "label", "base")
            )
        ).alias("ranked"),
    )
    stratified = ranked.select(
        "spare", F.posexplode("ranked").alias("place", "c")
    ).select(
        F.col("c.label").alias("__stratum"),
        (F.col("c.base") + F.when(F.col("place") < F.col("spare"), 1).otherwise(0)).alias(LIMIT),
    )
    whole = packed.where(F.col("smallest") < 2).select(
        F.lit(None).cast("string").alias("__stratum"), test.alias(LIMIT)
    )
    return stratified.unionByName(whole)


def split_rows(
    rows: DataFrame, *key: str, seed: int = SEED, share: float = TEST_SHARE
) -> DataFrame:
    """Add ``is_test``: an exact, seeded split with every label's share kept."""
    sizes = test_sizes(rows, share)
    # Every label's group: the label itself, or NULL for all where the split is not stratified.
    strata = sizes.where(F.col("__stratum").isNotNull()).select(
        F.col("__stratum").alias("__label"), F.col("__stratum").alias("__group")
    )
    grouped = rows.join(strata, rows["label"] == F.col("__label"), "left").withColumn("__stratum", F.col("__group"))
    return mark_first_n(
        grouped.drop("__label", "__group"),
        hash_order(seed, *key),
        sizes,
        "is_test",
        group=("__stratum",),
    ).drop("__stratum")


def split_rows_by_hash(
    rows: DataFrame, *key: str, seed: int = SEED, share: float = TEST_SHARE
) -> DataFrame:
    """Add ``is_test`` by a hash threshold: no shuffle, sizes right on average."""
    return rows.withColumn("is_test", hash_unit(seed, *[F.col(k) for k in key]) < share)


def sample_rows(
    rows: DataFrame, *key: str, n: int = BASELINE_ROWS, seed: int = SEED
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, seeded, without replacement."""
    return first_n(rows, hash_order(seed, *key), n)


def correction_rows(corrections: DataFrame) -> DataFrame:
    """Training rows from corrections: masked line, its hour and the given label."""
    raw = F.col("raw_log")
    rest = [c for c in corrections.columns if c not in ("raw_log", "proposed_label")]
    return corrections.select(
        *rest,
        F.lit("INFO").alias("level"),
        text.mask(raw).alias("message"),
        F.col("proposed_label").alias("label"),
        text.extract_hour(raw, text.route_correction_hour(raw)).alias("hour"),
        F.lit("analyst_correction").alias("source"),
    )


def combine_training(
    baseline: DataFrame | None, corrections: DataFrame, *keep: str
) -> DataFrame:
    """Baseline rows and corrections; corrections alone when there is no baseline."""
    columns = (*keep, *TRAIN_COLUMNS)
    extra = corrections.select(*columns)
    if baseline is None:
        return extra
    return baseline.select(*columns).unionByName(extra)


def prepare(
    lines: DataFrame,
    dataset: str,
    order: RowOrder,
    *key: str,
    raw: str = "raw",
    seed: int = SEED,
    limits: Limits = Limits(),
) -> DataFrame:
    """Training table of one dataset, from raw lines to limited repeats.

    The labelled rows are stored once: both limits read them twice, and parsing and
    masking the text is the dear part.
    """
    labelled = materialize(
        augment_temporal(label_lines(lines, dataset, raw), *key, seed=seed), f"labelled-{dataset}"
    )
    capped = cap_classes(labelled, order, limits.normal, limits.anomalous)
    return limit_repeats(capped, order, dataset, repeat_limit(F.col("label"), dataset, limits))
