"""Reproducible random order: the md5 of a seed and a row key.

The same in every engine that has md5, on any number of machines, and after any
retry, unlike ``rand``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def order_hash(seed: int | str, *key: str | Column) -> Column:
    """32 hex digits; sorting by them is the shuffled order for ``seed``."""
    parts = [F.lit(str(seed))]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def uniform(seed: int | str, *key: str | Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the hash."""
    digits = F.substring(order_hash(seed, *key), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
