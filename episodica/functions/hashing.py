"""Random choices that every engine repeats: an order by md5 of the seed and a row's key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int, *key: str | Column) -> Column:
    """32 hex digits; rows ordered by them are shuffled."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]))


def hash_int(seed: int, *key: str | Column) -> Column:
    """A number below 2^48 that the row's key draws."""
    return F.conv(F.substring(hash_key(seed, *key), 1, 12), 16, 10).cast("long")
