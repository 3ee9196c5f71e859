"""Per-host results over the frontier's jobs and the scheduler's workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hot_keys import dense_reduce
from ..sources import read_table


def p3_found(spark: SparkSession, sf: str, share_percent: int = 1) -> DataFrame:
    """Hosts with at least ``share_percent`` % of the jobs that have a host."""
    hosts = dense_reduce(read_table(spark, sf, "jobs").select("host"), "host")
    total = hosts.agg(F.sum("rows")).scalar()
    return hosts.where(F.col("rows") * 100 >= total * share_percent).select("host")


def p3_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Every host's jobs, priorities and distinct workers.

    Hosts of either table come out; a host without jobs or workers has 0 there
    and null priorities. Repeated worker rows and null workers don't count.
    """
    jobs = dense_reduce(read_table(spark, sf, "jobs").select("host", "priority"), "host", ["priority"])
    served = read_table(spark, sf, "recent_domains").select("host", "tid").distinct()
    workers = dense_reduce(served, "host", ["tid"]).select("host", F.col("tid_n").alias("workers"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    both = jobs.join(workers, "host", "full").withColumnRenamed("rows", "jobs")
    return both.select("host", zero("jobs"), zero("priority_sum"), F.col("priority_max"), zero("workers"))


QUERIES = {"p3_found": p3_found, "p3_hosts": p3_hosts}

SQL = {
    "p3_found": """
        SELECT host FROM jobs WHERE host IS NOT NULL GROUP BY host
        HAVING count(*) * 100 >= (SELECT count(host) FROM jobs)""",
    "p3_hosts": """
        WITH j AS (SELECT host, count(*) AS jobs, coalesce(sum(priority), 0) AS priority_sum, max(priority) AS priority_max
                   FROM jobs WHERE host IS NOT NULL GROUP BY host),
             w AS (SELECT host, count(DISTINCT tid) AS workers FROM recent_domains WHERE host IS NOT NULL GROUP BY host)
        SELECT host, CAST(coalesce(jobs, 0) AS BIGINT) AS jobs, CAST(coalesce(priority_sum, 0) AS BIGINT) AS priority_sum,
               priority_max, CAST(coalesce(workers, 0) AS BIGINT) AS workers
        FROM j FULL JOIN w USING (host)""",
}
