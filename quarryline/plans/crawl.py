"""Queries over the crawl loop: rounds, pops with state, workers, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROD
from ..functions import url as U
from ..operators import frontier, links, metrics, scheduling
from ..session import cut, shared_path
from ..sources import read_table
from ..streaming.frontier import run_pops
from ..streaming.index import stream_index
from . import sql
from .corpus import SMALL
from .corpus import SQL as _CORPUS
from .frontier import _PAGED, _POPPED

ROUNDS = 3
PER_QUEUE = 4
ATTEMPTS = 30


def _frontier(spark: SparkSession, sf: str) -> DataFrame:
    return cut(frontier.priorities(links.page_links(read_table(spark, sf, "pages"))))


def _roots(spark: SparkSession, sf: str) -> DataFrame:
    """The root set with its priorities, and every page's own address once."""
    own = U.parse_urls(read_table(spark, sf, "pages").select("url"), "url").where("u is not null").select(links.plain(F.col("u")).alias("url")).distinct()
    return read_table(spark, sf, "root_set").select("url", F.col("priority").alias("inc")).unionByName(own.withColumn("inc", F.lit(1).cast("long")))


def crawl_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs of three rounds; links of popped pages feed the next one."""
    return frontier.crawl(read_table(spark, sf, "pages"), _roots(spark, sf), ROUNDS, PER_QUEUE)[0]


def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """The frontier after three rounds; popped urls stay and go on counting."""
    return frontier.crawl(read_table(spark, sf, "pages"), _roots(spark, sf), ROUNDS, PER_QUEUE)[1]


def frontier_popped_pages(spark: SparkSession, sf: str) -> DataFrame:
    """pages' values once the best of each queue are popped."""
    pri = _frontier(spark, sf)
    popped = frontier.popped_now(pri, PER_QUEUE).select("url", F.lit(True).alias("popped"))
    return frontier.page_values(frontier.split_pages(pri.join(popped, "url", "left")))


def frontier_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of every queue, read by its number from a snapshot that was written page by page."""
    path = shared_path(spark, "snapshot")
    frontier.write_pages(frontier.split_pages(_frontier(spark, sf)), path)
    return frontier.read_pages(spark, path).where("page = 0").select("queue", "page", "url", "priority", "popped")


def frontier_waiting(spark: SparkSession, sf: str) -> DataFrame:
    """what still waits once the best of each queue are popped."""
    pri = _frontier(spark, sf)
    popped = frontier.popped_now(pri, PER_QUEUE).select("url", F.lit(True).alias("popped"))
    return frontier.waiting(pri.join(popped, "url", "left")).select("url", "priority")


def pop_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Pop attempts, pops, missing jobs and priorities by queue."""
    return metrics.pop_counts(_frontier(spark, sf), frontier.queue_of(F.col("url"), PROD.n_queues), PROD.n_queues, ATTEMPTS)


def stream_pop_order(spark: SparkSession, sf: str) -> DataFrame:
    """Every queue's increments and then pops as one stream of operations, popped with state."""
    pri = _frontier(spark, sf).select(frontier.queue_of(F.col("url"), PROD.n_queues).alias("queue"), "url", "priority")
    incs = pri.select("queue", F.lit(0).cast("long").alias("seq"), F.lit("inc").alias("op"), "url", F.col("priority").alias("amount"))
    turns = spark.range(PROD.n_queues).select(F.col("id").cast("int").alias("queue"), F.explode(F.sequence(F.lit(1), F.lit(ATTEMPTS))).alias("turn"))
    pops = turns.select("queue", F.col("turn").cast("long").alias("seq"), F.lit("pop").alias("op"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("long").alias("amount"))
    return run_pops(incs.unionByName(pops)).select("queue", F.col("seq").cast("int").alias("rk"), "url", "priority")


def stream_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of an index filled by a stream of pages; equals shard_assignment."""
    docs, _ = stream_index(spark, f"{sf}/page[s].parquet", SMALL)
    return docs.select("core", "db", "doc_id", "page_id", "url", "n_terms", "log2_terms")


def worker_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """The worker that each host's next job goes to."""
    jobs = read_table(spark, sf, "jobs")
    loads = jobs.where("tid is not null").groupBy("tid").agg(F.count(F.lit(1)).alias("waiting"))
    return scheduling.assign_workers(jobs.select("host").distinct(), read_table(spark, sf, "recent_domains"), loads)


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    logs = read_table(spark, sf, "documents").where("source = 'crawllogs' and text is not null")
    return metrics.log_jobs(logs, "doc_id", "text")


def log_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """jobs in the crawl logs, whether their status is a success and their type HTML."""
    kind = F.when(F.col("outcome") == "not html", "application/octet-stream")
    return _logs(spark, sf).withColumns({"success": metrics.http_success(F.col("status")), "html": metrics.content_is_html(kind)})


def log_report(spark: SparkSession, sf: str) -> DataFrame:
    """M01-M04, M13 over the crawl logs, by core."""
    n = lambda c: F.count_if(c)
    o = F.col("outcome")
    return _logs(spark, sf).groupBy("core").agg(
        F.count(F.lit(1)).alias("completed"), n((o == "fetched") & metrics.http_success(F.col("status"))).alias("successful"), n(o == "timeout").alias("failed"), n(o == "blocked by robots").alias("blocked"), F.sum("ms").alias("ms")
    )


def log_sample(spark: SparkSession, sf: str) -> DataFrame:
    """F16: a random share of log lines, as they would be printed; which ones depends on the engine, so there is no SQL."""
    return metrics.sampled(_logs(spark, sf), PROD.print_prob)


def oversize_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page's bytes, what is read of it, and whether it would be reported as oversized."""
    from ..operators.text import capped

    rows = read_table(spark, sf, "pages").where("html is not null")
    read = F.octet_length(capped(F.col("html"), PROD.max_document_len))
    return rows.select("page_id", F.octet_length("html").alias("bytes"), read.alias("read"), metrics.oversize(F.octet_length("html").cast("long")).alias("oversize"))


_FNS = [crawl_rounds, crawl_frontier, frontier_popped_pages, frontier_snapshot, frontier_waiting, pop_metrics, stream_pop_order, stream_shards, worker_assignment, log_jobs, log_report, log_sample, oversize_pages]
QUERIES = {f.__name__: f for f in _FNS}

_BEST = "row_number() OVER (PARTITION BY {q} ORDER BY priority DESC, url DESC)"
_LOOP = f"""{sql.LINKS},
    lk AS (SELECT b.scheme || '://' || b.authority || b.path AS source, links.url, inc FROM links JOIN b USING (page_id)),
    own0 AS (SELECT url AS raw FROM pages), {sql.parsed("own", "own0", "raw", "raw")},
    f0 AS (SELECT url, CAST(sum(inc) AS BIGINT) AS priority, false AS popped FROM (
             SELECT url, priority AS inc FROM root_set UNION ALL (SELECT DISTINCT scheme || '://' || authority || path, 1 FROM own)) GROUP BY url)""" + "".join(
    f""",
    p{n} AS (SELECT {sql.QUEUE} AS queue, url, priority FROM f{n} WHERE NOT popped QUALIFY {_BEST.format(q=sql.QUEUE)} <= {PER_QUEUE}),
    f{n + 1} AS (SELECT url, CAST(sum(priority) AS BIGINT) AS priority, bool_or(popped) AS popped FROM (
             SELECT url, priority, popped FROM f{n} UNION ALL SELECT url, 0, true FROM p{n}
             UNION ALL SELECT url, inc, false FROM lk WHERE source IN (SELECT url FROM p{n})) GROUP BY url)"""
    for n in range(ROUNDS)
)
_TOP = f"top AS (SELECT url FROM fr QUALIFY {_BEST.format(q=sql.QUEUE)} <= {PER_QUEUE})"
_LINE = metrics.LOG_LINE
_LOG = f"""
    l0 AS (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents WHERE source = 'crawllogs' AND text IS NOT NULL),
    l1 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l0),
    lj AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(regexp_extract(line, '{_LINE}', 1) AS INTEGER) AS core, regexp_extract(line, '{_LINE}', 2) AS outcome, regexp_extract(line, '{_LINE}', 3) AS url,
                  coalesce(TRY_CAST(regexp_extract(regexp_extract(line, '{_LINE}', 4), '-> (\\d+)', 1) AS INTEGER), 200) AS status,
                  TRY_CAST(regexp_extract(regexp_extract(line, '{_LINE}', 4), '(\\d+)ms', 1) AS INTEGER) AS ms
           FROM l1 WHERE regexp_matches(line, '{_LINE}'))"""

SQL = {
    "crawl_rounds": f"WITH {_LOOP} " + " UNION ALL ".join(f"SELECT {n} AS round, queue, url, priority FROM p{n}" for n in range(ROUNDS)),
    "crawl_frontier": f"WITH {_LOOP} SELECT url, priority, popped FROM f{ROUNDS}",
    "frontier_popped_pages": f"""
        WITH {sql.LINKS}, {_TOP},
             pg AS (SELECT {sql.QUEUE} AS queue, url, priority, url IN (SELECT url FROM top) AS popped,
                           CAST((row_number() OVER (PARTITION BY {sql.QUEUE} ORDER BY url) - 1) // {PROD.page_capacity} AS BIGINT) AS page FROM fr)
        SELECT queue, page, min(url) AS lower, count(*) AS n, coalesce(max(priority) FILTER (WHERE NOT popped), 0) AS value FROM pg GROUP BY queue, page""",
    "frontier_snapshot": f"WITH {sql.LINKS}, {_PAGED} SELECT queue, page, url, priority, false AS popped FROM pg WHERE page = 0",
    "frontier_waiting": f"WITH {sql.LINKS}, {_TOP} SELECT url, priority FROM fr WHERE url NOT IN (SELECT url FROM top)",
    "pop_metrics": f"""
        WITH {sql.LINKS}, {_POPPED.format("fr")}, e AS (SELECT queue, count(*) AS popped, CAST(sum(priority) AS BIGINT) AS total_priority FROM pop WHERE rk <= {ATTEMPTS} GROUP BY queue)
        SELECT CAST(q.queue AS INTEGER) AS queue, CAST({ATTEMPTS} AS BIGINT) AS attempts, coalesce(popped, 0) AS popped, {ATTEMPTS} - coalesce(popped, 0) AS missing, coalesce(total_priority, 0) AS total_priority
        FROM range({PROD.n_queues}) AS q(queue) LEFT JOIN e ON e.queue = q.queue""",
    "stream_pop_order": f"WITH {sql.LINKS}, {_POPPED.format('fr')} SELECT queue, rk, url, priority FROM pop WHERE rk <= {ATTEMPTS}",
    "stream_shards": _CORPUS["shard_assignment"],
    "worker_assignment": f"""
        WITH ld AS (SELECT tid, count(*) AS waiting FROM jobs WHERE tid IS NOT NULL GROUP BY tid),
             sv AS (SELECT DISTINCT host, tid FROM recent_domains WHERE host IS NOT NULL AND tid IS NOT NULL),
             lo AS (SELECT host, min(sv.tid) AS local FROM sv LEFT JOIN ld ON sv.tid = ld.tid WHERE coalesce(waiting, 0) < {PROD.work_queue_cap} GROUP BY host),
             id AS (SELECT min(w.tid) AS idle FROM (SELECT tid FROM sv UNION SELECT tid FROM ld) w LEFT JOIN ld ON w.tid = ld.tid WHERE coalesce(waiting, 0) < {PROD.work_empty_threshold})
        SELECT h.host, coalesce(local, idle) AS tid, CASE WHEN local IS NOT NULL THEN 'local' WHEN idle IS NOT NULL THEN 'idle' ELSE 'stashed' END AS kind
        FROM (SELECT DISTINCT host FROM jobs WHERE host IS NOT NULL) h LEFT JOIN lo ON lo.host = h.host, id""",
    "log_jobs": f"WITH {_LOG} SELECT *, status BETWEEN 200 AND 299 AS success, outcome <> 'not html' AS html FROM lj",
    "log_report": f"""
        WITH {_LOG} SELECT core, count(*) AS completed, count(*) FILTER (WHERE outcome = 'fetched' AND status BETWEEN 200 AND 299) AS successful,
               count(*) FILTER (WHERE outcome = 'timeout') AS failed, count(*) FILTER (WHERE outcome = 'blocked by robots') AS blocked, CAST(sum(ms) AS BIGINT) AS ms FROM lj GROUP BY core""",
    "oversize_pages": f"WITH {sql.CRAWLED} SELECT page_id, CAST(strlen(p.html) AS INTEGER) AS bytes, CAST(strlen(cr.html) AS INTEGER) AS read, strlen(p.html) > 100000000 AS oversize FROM pages p JOIN cr USING (page_id)",
}
