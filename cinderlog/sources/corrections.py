"""Analyst corrections as they arrive: JSON lists with several key spellings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.regex import strip
from cinderlog.schemas import CORRECTIONS_JSON, NORMAL

# Key spellings in order of preference.
RAW_KEYS = ("rawLog", "raw_log", "RawLog")
LABEL_KEYS = ("proposedLabel", "proposed_label", "ProposedLabel")


def _first_filled(item: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(strip(item[k]) != "", item[k]) for k in keys])


def judge_corrections(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per correction, and one per payload that holds none, with a reason if it is rejected.

    A list that was cut short, or a payload that is no list, is rejected as a whole; an item
    without a raw line alone.
    """
    rest = [c for c in payloads.columns if c != payload]
    text = strip(F.coalesce(F.col(payload), F.lit("")))
    items = payloads.select(
        *rest,
        F.when(~text.startswith("["), "not a list").when(~text.endswith("]"), "cut short").alias("__fault"),
        F.from_json(payload, CORRECTIONS_JSON).alias("__items"),
    )
    fault = F.coalesce("__fault", F.when(F.col("__items").isNull(), "no valid JSON"))
    sound = items.select(*rest, fault.alias("__fault"), F.when(fault.isNull(), F.col("__items")).alias("__items"))
    each = sound.select(*rest, "__fault", F.posexplode_outer("__items").alias("item_no", "item"))
    item = F.col("item")
    raw = _first_filled(item, RAW_KEYS)
    return each.where(F.col("__fault").isNotNull() | F.col("item").isNotNull()).select(
        *rest,
        "item_no",
        raw.alias("raw_log"),
        F.coalesce(_first_filled(item, LABEL_KEYS), F.lit(NORMAL)).alias("proposed_label"),
        F.coalesce("__fault", F.when(raw.isNull(), "no raw line")).alias("reason"),
    )


def read_corrections(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per correction with a raw line: ``raw_log`` and ``proposed_label``."""
    return judge_corrections(payloads, payload).where(F.col("reason").isNull()).drop("reason")


def rejected_corrections(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """What :func:`read_corrections` leaves out, with the reason."""
    judged = judge_corrections(payloads, payload).where(F.col("reason").isNotNull())
    return judged.drop("raw_log", "proposed_label")
