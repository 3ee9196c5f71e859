"""Row numbers and best rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, width

WINDOW_LIMIT = 1_000
_PLACE_BITS = 33  # of a monotonically_increasing_id: the row in its partition


def ranked(df: DataFrame, by: list[str], order: list[Column], into: str, few: bool = False) -> DataFrame:
    """``df`` with 0, 1, 2, ... within ``by`` in the total order ``order``, whatever a group's size.

    One range shuffle puts rows in order, so a group of a third of all rows
    lies in many partitions. A row's place in its partition is counted as it is
    written; what a partition must add is known from the counts of each
    (partition, group) piece. There are as many pieces as partitions, and one
    more for each group that ends inside one, so pieces are joined by their
    partition and group, each to no more rows than a partition has. With
    ``few``, the caller vouches for a bound on the number of groups that is
    independent of the rows, and pieces are broadcast: rows then move once.
    ``df`` is read twice, first for the ranges: hand over a stored table.
    ``order`` must leave no ties. An empty table gives no rows; null group
    columns are a group.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in by]
    rows = df.repartitionByRange(width(spark), *keys, *order).sortWithinPartitions(*keys, *order)
    rows = cut(rows.withColumn("__place", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__place", _PLACE_BITS).cast("int"))
    same = Window.partitionBy(*by).orderBy("__part")
    pieces = rows.groupBy(*by, "__part").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    pieces = pieces.withColumn("__add", F.sum("__n").over(same) - F.col("__n") - F.col("__first"))
    right = pieces.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col("__part").alias("__p"), "__add")
    match = (F.col("__part") == F.col("__p")) & _all(F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by))
    out = rows.join(F.broadcast(right) if few else right, match).withColumn(into, (F.col("__place") + F.col("__add")).cast("long"))
    return out.select(*df.columns, into)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def best(df: DataFrame, by: list[str], order: list[Column], k: int, into: str = "rk", few: bool = False) -> DataFrame:
    """The first ``k`` rows of each group in the total order ``order``, with their rank from 1 as ``into``.

    A small ``k`` is a limited window: each task keeps k rows a group before
    the shuffle. Spark limits windows only up to ``WINDOW_LIMIT``; beyond it,
    rows are numbered by one range shuffle, so that a group of any size is
    spread over many tasks there, too.
    """
    if k <= WINDOW_LIMIT:
        rk = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return df.withColumn(into, rk).where(F.col(into) <= k)
    return ranked(df, by, order, into, few).where(F.col(into) < k).withColumn(into, (F.col(into) + 1).cast("int"))
