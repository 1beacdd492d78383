"""Seeded row order that any SQL engine can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 15  # so that the number fits a signed 64-bit integer


def order_text(key: Column | str, seed: int) -> Column:
    """Uniform hex text of (key, seed); ordering by it is the seeded shuffle."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.substring(digest, 1, HEX_DIGITS)


def order_hash(key: Column | str, seed: int) -> Column:
    """The same as a 60-bit number, in the same order."""
    return F.conv(order_text(key, seed), 16, 10).cast("bigint")
