"""Crawl metrics over the event table, and the streamed frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources import read_table
from ..streaming.frontier import stream_priorities
from .frontier import SQL as _FRONTIER


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as finished jobs: errors failed, signups were skipped, the rest succeeded; value is the time in ms."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("success")
    return read_table(spark, sf, "events").select("event_id", "ts", status.alias("status"), F.floor("value").cast("long").alias("ms"))


def _hourly(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.window_counts(_jobs(spark, sf), "ts", "1 hour", "status", "ms")


def crawl_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and ratios by hour."""
    r = metrics.ratios(_hourly(spark, sf))
    rounded = [F.round(c, 4).alias(c) for c in ("pct_failed", "pct_skipped", "ms_per_success")]
    return r.select("start", "completed", "successful", "skipped", "failed", "ms", *rounded)


def metric_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of the rising daily counters."""
    daily = metrics.window_counts(_jobs(spark, sf), "ts", "1 day", "status", "ms")
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy("start")  # one row a day
    counters = daily.select("start", F.sum("completed").over(w).alias("completed"), F.sum("failed").over(w).alias("failed"))
    return metrics.deltas(counters, "start", ["completed", "failed"])


def frontier_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """M10, M12-M14 over the jobs: checks, cache hits, total and average priority."""
    jobs = read_table(spark, sf, "jobs").where("host is not null")
    both = jobs.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("priority").alias("p"), F.count("priority").alias("k"))
    return both.agg(F.sum("n").alias("queries"), F.sum(F.col("n") - 1).alias("hits"), F.sum("p").alias("total_priority"), F.round(F.try_divide(F.sum("p"), F.sum("k")), 4).alias("avg_priority"))


def stream_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Equals frontier_priority."""
    return stream_priorities(spark, f"{sf}/page[s].parquet")  # a pattern may name one file as well as a folder


_FNS = [crawl_metrics, metric_deltas, frontier_metrics, stream_frontier]
QUERIES = {f.__name__: f for f in _FNS}

_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'success' END"
_COUNTED = f"""
    j AS (SELECT ts, {_STATUS} AS status, CAST(floor(value) AS BIGINT) AS ms FROM events),
    h AS (SELECT date_trunc('{{}}', ts) AS start, count(*) AS completed, count(*) FILTER (WHERE status = 'success') AS successful,
                 count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(ms) AS BIGINT) AS ms
          FROM j GROUP BY 1)"""

SQL = {
    "crawl_metrics": f"""
        WITH {_COUNTED.format("hour")}
        SELECT *, round(failed * 100.0 / completed, 4) AS pct_failed, round(skipped * 100.0 / completed, 4) AS pct_skipped,
               round(CAST(ms AS DOUBLE) / nullif(successful, 0), 4) AS ms_per_success FROM h""",
    "metric_deltas": f"""
        WITH {_COUNTED.format("day")},
             c AS (SELECT start, CAST(sum(completed) OVER (ORDER BY start) AS BIGINT) AS completed, CAST(sum(failed) OVER (ORDER BY start) AS BIGINT) AS failed FROM h)
        SELECT *, completed - coalesce(lag(completed) OVER (ORDER BY start), 0) AS d_completed, failed - coalesce(lag(failed) OVER (ORDER BY start), 0) AS d_failed FROM c""",
    "frontier_metrics": """
        SELECT count(*) AS queries, count(*) - count(DISTINCT host) AS hits, CAST(sum(priority) AS BIGINT) AS total_priority,
               round(sum(priority) / count(priority), 4) AS avg_priority FROM jobs WHERE host IS NOT NULL""",
}

SQL["stream_frontier"] = _FRONTIER["frontier_priority"]
