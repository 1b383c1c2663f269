"""Seeded, repeatable randomness: a pure function of a row's key."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str, *key: Column) -> Column:
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in key], F.lit(str(seed))))


def hash_unit(seed: int | str, *key: Column) -> Column:
    """Uniform number in [0, 1) from the first 52 bits of the digest."""
    bits = F.conv(F.substring(digest(seed, *key), 1, 13), 16, 10).cast("long")
    return bits / F.lit(float(1 << 52))
