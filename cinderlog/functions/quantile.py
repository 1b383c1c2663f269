"""Exact quantiles without a sort or a single task that holds the values."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096


def _histogram(values: DataFrame, low: float, high: float) -> list:
    """Count, least and greatest value of each bin between two values; at most ``BINS`` rows."""
    inside = values.where(F.col("x").between(low, high))
    place = F.floor((F.col("x") - low) / F.lit(high - low) * BINS)
    number = F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)).alias("bin")
    bins = inside.groupBy(number).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    return sorted(bins.collect(), key=lambda r: r["bin"])


def _value_at(values: DataFrame, bins: list, rank: int) -> float:
    """The value with ``rank`` smaller ones, by narrowing the bin that holds it."""
    while True:
        for found in bins:
            if rank < found["n"]:
                break
            rank -= found["n"]
        if rank == 0 or found["low"] == found["high"]:
            return found["low"]
        if rank == found["n"] - 1:
            return found["high"]
        bins = _histogram(values, found["low"], found["high"])


def exact_quantiles(df: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between ranks, as ``quantile_cont``; NULLs are left out.

    Values are counted into bins with a map-side combine, and only the bin that holds a
    wanted rank is looked at again, until it is settled.  Each pass narrows the range by
    the number of bins, so there are a few passes at any size.
    """
    values = df.select(value.cast("double").alias("x")).where(F.col("x").isNotNull())
    whole = values.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    if not whole["n"]:
        return [None for _ in shares]
    if whole["low"] == whole["high"]:
        return [whole["low"] for _ in shares]
    bins = _histogram(values, whole["low"], whole["high"])
    out = []
    for share in shares:
        at = share * (whole["n"] - 1)
        low = _value_at(values, bins, math.floor(at))
        high = low if at == math.floor(at) else _value_at(values, bins, math.floor(at) + 1)
        out.append(low + (high - low) * (at - math.floor(at)))
    return out
