"""Hash partitions that any engine can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(c: Column, n: int) -> Column:
    """A number below ``n`` from the MD5 of a text."""
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
