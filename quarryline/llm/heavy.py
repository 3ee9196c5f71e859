"""Most frequent items among billions: iceberg filtering by exact bucket counts.

Several hashes each map every item to one of a fixed number of buckets whose
weights are counted exactly. An item of at least the threshold makes all its
buckets reach it, so only items with nothing but heavy buckets are counted one
by one. At most 1/share buckets of a hash can be heavy, which bounds what the
driver sees and broadcasts; with 64/share buckets hardly a light item survives.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources import read_table
from .clean import CLEAN_SQL, read_clean

HASHES = 3


def frequent_items(df: DataFrame, item: str, share: str, weight: str | None = None, hashes: int = HASHES) -> DataFrame:
    """(item, n, estimate) of items with at least ``share`` of the whole weight.

    ``n`` is exact; ``estimate`` is the smallest of the item's bucket weights,
    the approximate count from bounded memory, never below ``n``. Without
    ``weight`` every row weighs 1. Memory: hashes * 64/share counters a task.

    Defined cases: null items weigh nothing, in the whole too; null and negative
    weights count as 0; a whole of weight 0 has no frequent items; the empty
    string is an item; ties all come out; other columns are not read.
    """
    limit = Fraction(share)
    buckets = int(64 / limit)
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("long") if weight else F.lit(1).cast("long")
    rows = df.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), w.alias("w"))
    bucket = lambda i: F.pmod(F.xxhash64(F.lit(i), "item"), F.lit(buckets)).cast("int")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("hash"), bucket(i).alias("bucket")) for i in range(hashes)))).alias("at")
    counted = rows.select(each, "w").groupBy("at.hash", "at.bucket").agg(F.sum("w").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("hash"))  # over one hash's fixed number of buckets
    least = F.col("whole") * limit.numerator
    heavy = counted.withColumn("whole", whole).where((F.col("n") > 0) & (F.col("n") * limit.denominator >= least)).collect()
    total = heavy[0].whole if heavy else 0
    out = rows
    for i in range(hashes):
        side = df.sparkSession.createDataFrame([(r.bucket, r.n) for r in heavy if r.hash == i], f"b{i} int, n{i} long")
        out = out.join(F.broadcast(side), bucket(i) == F.col(f"b{i}")).drop(f"b{i}")
    exact = out.groupBy("item").agg(F.sum("w").alias("n"), F.min(F.least(*(F.col(f"n{i}") for i in range(hashes))) if hashes > 1 else F.col("n0")).alias("estimate"))
    return exact.where(F.col("n") * limit.denominator >= total * limit.numerator)


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Frequent urls of jobs and terms of the index cache with exact and approximate counts."""
    urls = frequent_items(read_table(spark, sf, "jobs"), "url", "0.001")
    terms = frequent_items(cut(read_clean(spark, sf).select("term", "cnt")), "term", "0.01", "cnt")
    return urls.withColumn("field", F.lit("url")).unionByName(terms.withColumn("field", F.lit("term")))


def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The frequent urls and terms with their exact counts."""
    return p6_items(spark, sf).select("field", "item", "n")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The frequent urls and terms."""
    return p6_items(spark, sf).select("field", "item")


QUERIES = {"p6_found": p6_found, "p6_items": p6_items, "p6_counts": p6_counts}

_COUNTED = f"""
    WITH {CLEAN_SQL}
    SELECT 'url' AS field, url AS item, count(*) AS n FROM jobs WHERE url IS NOT NULL GROUP BY url
    HAVING count(*) * 1000 >= (SELECT count(url) FROM jobs)
    UNION ALL
    SELECT 'term', term, CAST(sum(cnt) AS BIGINT) FROM clean GROUP BY term HAVING sum(cnt) * 100 >= (SELECT sum(cnt) FROM clean)"""

SQL = {"p6_found": f"SELECT field, item FROM ({_COUNTED})", "p6_counts": _COUNTED}
