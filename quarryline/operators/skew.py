"""Equi-joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1_000
_BUCKETS = 1 << 16


def hot_hashes(big: DataFrame, key: str, limit: int, most: int = HOT_KEYS) -> list[int]:
    """Hashes of the keys of ``big`` with more than ``limit`` rows and more than 1/``most`` of all rows.

    At most ``most`` of them, whatever the data. Rows are first counted in a
    fixed number of buckets; only rows of heavy buckets are counted by hash.
    Nulls never join and are left out.
    """
    h = F.xxhash64(key)
    rows = big.where(F.col(key).isNotNull()).select(h.alias("h"))
    bucket = F.pmod("h", F.lit(_BUCKETS)).cast("int")
    counted = rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(_everything())  # over the fixed number of buckets
    heavy = counted.withColumn("whole", whole).where((F.col("n") > limit) & (F.col("n") * most > F.col("whole"))).collect()
    if not heavy:
        return []
    floor = max(limit, heavy[0].whole // most)
    some = rows.where(bucket.isin([r.b for r in heavy])).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return [r.h for r in some.where(F.col("n") > floor).select("h").collect()]


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def lookup_join(big: DataFrame, small: DataFrame, key: str, limit: int, how: str = "inner", most: int = HOT_KEYS) -> DataFrame:
    """``big`` joined to ``small`` (one row per ``key``) without a giant task.

    Keys of more than ``limit`` rows and more than 1/``most`` of the rows are
    joined where they lie, to a broadcast of only their rows of ``small``: at
    most ``most`` rows, of together at most ``most`` times the mean key's size,
    however large the tables are. All other keys are shuffled; none of them is
    more than 1/``most`` of the rows, and adaptive execution splits those that
    still exceed a partition. ``big`` is read to count keys and again to join,
    so hand over a stored table. ``how``: inner or left. Null keys match
    nothing: dropped by inner, kept by left. Column names besides the key must
    differ on the two sides.
    """
    hot = hot_hashes(big, key, limit, most)
    if not hot:
        return big.join(small, key, how)
    is_hot = F.coalesce(F.xxhash64(key).isin(hot) & F.col(key).isNotNull(), F.lit(False))
    many = big.where(is_hot).join(F.broadcast(small.where(is_hot)), key, how)
    return many.unionByName(big.where(~is_hot).join(small.where(~is_hot), key, how))
