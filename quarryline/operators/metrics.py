"""Crawl metrics over a table of job events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import best


def http_success(status: Column) -> Column:
    """F02."""
    return status.between(200, 299)


def content_is_html(content_type: Column) -> Column:
    """absent headers pass."""
    return F.coalesce(content_type.startswith("text/html"), F.lit(True))


def oversize(length: Column) -> Column:
    """only reported, never dropped."""
    return F.coalesce(length > 100_000_000, F.lit(False))


def sampled(df: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """F16: a random share of log rows."""
    return df.where(F.rand(seed) < share)


def window_counts(jobs: DataFrame, ts: str, every: str, status: str, ms: str) -> DataFrame:
    """(start, completed, successful, skipped, failed, ms) for each window."""
    is_ = lambda s: F.count_if(F.col(status) == s)
    each = jobs.groupBy(F.window(ts, every).start.alias("start")).agg(
        F.count(F.lit(1)).alias("completed"), is_("success").alias("successful"), is_("skipped").alias("skipped"), is_("failed").alias("failed"), F.sum(ms).alias("ms")
    )
    return each


def ratios(counts: DataFrame) -> DataFrame:
    """Percent of errors and skips, and response time over *successful* jobs; null where nothing happened."""
    share = lambda n, d: F.try_divide(F.col(n) * 100.0, d)
    return counts.withColumns({"pct_failed": share("failed", F.col("completed")), "pct_skipped": share("skipped", F.col("completed")), "ms_per_success": F.try_divide("ms", "successful")})


def deltas(counters: DataFrame, order: str, columns: list[str], series: str | None = None) -> DataFrame:
    """Differences between consecutive snapshots of rising counters.

    A series of snapshots is ordered as a whole; one snapshot a second keeps it small.
    """
    w = (Window.partitionBy(series) if series else Window.partitionBy(F.lit(0))).orderBy(order)
    return counters.withColumns({f"d_{c}": F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in columns})


def robots_hits(checks: DataFrame, host: str) -> DataFrame:
    """(queries, hits): checks of a host that an earlier check had already fetched."""
    return checks.groupBy(host).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("queries"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("hits"))


LOG_LINE = r"^\d\d:\d\d:\d\d\.\d{3} \[core(\d+)/[^\]]*\] ([a-z ]+?)(?: on|:)? (https?://\S+) ?(.*)$"


def log_jobs(logs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, core, outcome, url, status, ms): the jobs in crawl logs, one a line; other lines are none.

    ``status`` is 200 where a line names no other.
    """
    lines = logs.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("pos", "line"))
    part = lambda i: F.regexp_extract("line", LOG_LINE, i)
    jobs = lines.where(F.col("line").rlike(LOG_LINE)).select(key, "pos", part(1).cast("int").alias("core"), part(2).alias("outcome"), part(3).alias("url"), part(4).alias("rest"))
    number = lambda p: F.regexp_extract("rest", p, 1).try_cast("int")
    return jobs.select(key, "pos", "core", "outcome", "url", F.coalesce(number(r"-> (\d+)"), F.lit(200)).alias("status"), number(r"(\d+)ms").alias("ms"))


def pop_counts(frontier: DataFrame, queue: Column, n_queues: int, attempts: int) -> DataFrame:
    """(queue, attempts, popped, missing, total_priority) if each queue is asked so many times.

    Asked beyond its last url, a queue answers with nothing; that is a missing
    job. Queues without urls come out, too.
    """
    spark = frontier.sparkSession
    have = best(frontier.select(queue.alias("queue"), "url", "priority"), ["queue"], [F.col("priority").desc(), F.col("url").desc()], attempts)
    each = have.groupBy("queue").agg(F.count(F.lit(1)).alias("popped"), F.sum("priority").alias("total_priority"))
    rows = spark.range(n_queues).select(F.col("id").cast("int").alias("queue")).join(each, "queue", "left").na.fill(0)
    return rows.select("queue", F.lit(attempts).cast("long").alias("attempts"), "popped", (attempts - F.col("popped")).alias("missing"), "total_priority")


def legacy_report(counts: DataFrame, order: str) -> DataFrame:
    """The legacy crawler's seven figures a window (L10): urls, % errors, ms a url, % robots hits, active, crawled so far, seen so far.

    ``counts``: (order, urls, failed, ms, hits, active, seen), one row a window
    and so few that one task sums them up.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    share = lambda c: F.round(F.try_divide(F.col(c) * 100.0, F.col("urls")), 4)
    return counts.select(
        order, "urls", share("failed").alias("pct_errs"), F.round(F.try_divide("ms", "urls"), 4).alias("ms_per_url"), share("hits").alias("pct_robot_hits"), "active", F.sum("urls").over(w).alias("crawled"), F.sum("seen").over(w).alias("seen")
    )
