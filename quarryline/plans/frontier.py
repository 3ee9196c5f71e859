"""Queries over links, addresses, robots files and the frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PROD
from ..functions import url as U
from ..operators import frontier, links, robots
from ..session import cut
from ..sources import read_table
from . import sql


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return links.page_links(_pages(spark, sf))


def _frontier(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.priorities(_links(spark, sf))


def _addresses(spark: SparkSession, sf: str) -> DataFrame:
    """(url, u): the distinct urls of jobs that are addresses."""
    urls = read_table(spark, sf, "jobs").select("url").where("url is not null").distinct()
    return U.parse_urls(urls, "url").where("u is not null")


def links_raw(spark: SparkSession, sf: str) -> DataFrame:
    """P08."""
    return links.raw_links(_pages(spark, sf)).select("page_id", "pos", "href")


def links_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Every link as an address, with query."""
    rows = links.resolved_links(_pages(spark, sf)).where("u is not null")
    return rows.select("page_id", "pos", F.col("u.href").alias("href"))


def links_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """P09-P13, F04, F06-F09."""
    return _links(spark, sf).select("page_id", "pos", "url")


def cross_domain_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links by whether they leave their domain."""
    return _links(spark, sf).groupBy("cross").agg(F.count(F.lit(1)).alias("n"), F.sum("inc").alias("inc"))


def trap_pages(spark: SparkSession, sf: str) -> DataFrame:
    """F06."""
    return links.trap_pages(_pages(spark, sf))


def link_filters(spark: SparkSession, sf: str) -> DataFrame:
    """F04, F05, F07, F08 over the frontier's distinct urls."""
    rows = _addresses(spark, sf).select("url", links.plain(F.col("u")).alias("p"), "u")
    return rows.select(
        "url", U.clearly_not_html(F.col("p")).alias("not_html"), U.clearly_not_html(F.col("p"), legacy=True).alias("not_html_legacy"), U.is_trap(F.col("u.path")).alias("trap"),
        (F.octet_length("p") > PROD.max_url_len).alias("too_long"), U.parses(F.col("p")).alias("parses"),
    )


def trap_urls(spark: SparkSession, sf: str) -> DataFrame:
    """F05, A11."""
    return _addresses(spark, sf).where(U.is_trap(F.col("u.path"))).select("url")


def domain_roots(spark: SparkSession, sf: str) -> DataFrame:
    """P10, P15."""
    hosts = _addresses(spark, sf).select(F.col("u.host").alias("host")).distinct()
    return hosts.select("host", U.domain_root(F.col("host")).alias("root"))


def academic_domains(spark: SparkSession, sf: str) -> DataFrame:
    """F14."""
    hosts = _addresses(spark, sf).select(F.col("u.host").alias("host")).distinct()
    return hosts.where(U.is_domain(F.col("host"))).select("host", U.is_academic(F.col("host")).alias("academic"))


def frontier_priority(spark: SparkSession, sf: str) -> DataFrame:
    """A09."""
    return _frontier(spark, sf)


def frontier_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct urls, exact."""
    return _frontier(spark, sf).agg(F.count(F.lit(1)).alias("seen"))


def frontier_new(spark: SparkSession, sf: str) -> DataFrame:
    """The frontier's urls that were never seen."""
    return frontier.unseen(_frontier(spark, sf), read_table(spark, sf, "seen_urls")).select("url", "priority")


def frontier_pop_order(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best of each queue."""
    return frontier.pop_order(_frontier(spark, sf), first=20)


def frontier_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    """The first 500 jobs, queues in turn."""
    return frontier.round_robin(frontier.pop_order(_frontier(spark, sf), first=500), 500)


def frontier_pop_order_all(spark: SparkSession, sf: str) -> DataFrame:
    """The whole order of each queue."""
    return frontier.pop_order(_frontier(spark, sf))


def frontier_round_robin_all(spark: SparkSession, sf: str) -> DataFrame:
    """All jobs, queues in turn until each is empty."""
    return frontier.round_robin(frontier.pop_order(_frontier(spark, sf)))


def frontier_pages(spark: SparkSession, sf: str) -> DataFrame:
    """T06, D02."""
    return frontier.split_pages(_frontier(spark, sf)).drop("popped")


def frontier_page_max(spark: SparkSession, sf: str) -> DataFrame:
    """A10, T04."""
    return frontier.page_values(frontier.split_pages(_frontier(spark, sf)))


def frontier_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every url found again by its page's interval."""
    pages = cut(frontier.split_pages(_frontier(spark, sf)))
    starts = frontier.page_values(pages).select("queue", "page", "lower")
    ranges = starts.withColumn("upper", F.lead("lower").over(Window.partitionBy("queue").orderBy("page")))
    return frontier.url_pages(pages.select("queue", "url", "priority"), ranges).select("queue", "url", "page")


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    return robots.robots_rules(read_table(spark, sf, "documents").where("source = 'robotstxt'"), "host", "text")


def robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    """S03, P21, W06."""
    return _rules(spark, sf)


def robots_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """F01, J04, R10, M13."""
    rows = cut(_addresses(spark, sf).select("url", F.col("u.host").alias("host"), F.col("u.path").alias("path")))
    return robots.allowed(rows, _rules(spark, sf)).select("url", "allowed")


def root_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The root set's urls as first increments of the frontier."""
    return frontier.pop_order(read_table(spark, sf, "root_set").select("url", "priority"))


def host_workers(spark: SparkSession, sf: str) -> DataFrame:
    """For each job's host the smallest worker that served it lately."""
    hosts = read_table(spark, sf, "jobs").select("host").where("host is not null").distinct()
    workers = read_table(spark, sf, "recent_domains").where("host is not null").groupBy("host").agg(F.min("tid").alias("tid"))
    return hosts.join(workers, "host", "left")


_FNS = [links_raw, links_resolved, links_canonical, cross_domain_links, trap_pages, link_filters, trap_urls, domain_roots, academic_domains, frontier_priority, frontier_seen, frontier_new, frontier_pop_order, frontier_round_robin, frontier_pop_order_all, frontier_round_robin_all, frontier_pages, frontier_page_max, frontier_lookup, robots_rules, robots_allowed, root_jobs, host_workers]
QUERIES = {f.__name__: f for f in _FNS}

_L = sql.LINKS
_A = f"ju AS (SELECT DISTINCT url FROM jobs WHERE url IS NOT NULL), {sql.parsed('a', 'ju', 'url', 'url')}, ap AS (SELECT *, scheme || '://' || authority || path AS p FROM a)"
_PAGED = f"pg AS (SELECT queue, url, priority, CAST((row_number() OVER (PARTITION BY queue ORDER BY url) - 1) // 60 AS BIGINT) AS page FROM (SELECT {sql.QUEUE} AS queue, * FROM fr))"
_POPPED = f"pop AS (SELECT {sql.QUEUE} AS queue, CAST(row_number() OVER (PARTITION BY {sql.QUEUE} ORDER BY priority DESC, url DESC) AS INTEGER) AS rk, url, priority FROM {{}})"
_RULES = r"""
    rf AS (SELECT row_number() OVER () AS f, host, string_split_regex(text, '\r?\n') AS ls FROM documents WHERE source = 'robotstxt' AND host IS NOT NULL AND text IS NOT NULL),
    rl AS (SELECT f, host, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM rf),
    rs AS (SELECT *, CASE WHEN starts_with(line, 'User-agent: ') THEN starts_with(line, 'User-agent: *') OR starts_with(line, 'User-agent: Rustbot') END AS flag FROM rl),
    ro AS (SELECT *, last_value(flag IGNORE NULLS) OVER (PARTITION BY f ORDER BY pos) AS active FROM rs),
    rules AS (SELECT DISTINCT host, regexp_extract(line, '^Disallow: (\S+)', 1) AS prefix FROM ro
              WHERE active AND flag IS NULL AND regexp_extract(line, '^Disallow: (\S+)', 1) <> '')"""

SQL = {
    "links_raw": """
        WITH h AS (SELECT page_id, regexp_extract_all(html, 'href=[''"]([^''"]+)[''"]', 1) AS hs FROM pages)
        SELECT page_id, CAST(unnest(range(len(hs))) AS INTEGER) AS pos, unnest(hs) AS href FROM h WHERE hs IS NOT NULL""",
    "links_resolved": f"WITH {sql.ALL_LINKS} SELECT page_id, pos, scheme || '://' || authority || path || query AS href FROM u",
    "links_canonical": f"WITH {_L} SELECT page_id, pos, url FROM links",
    "cross_domain_links": f"WITH {_L} SELECT \"cross\", count(*) AS n, CAST(sum(inc) AS BIGINT) AS inc FROM links GROUP BY \"cross\"",
    "trap_pages": f"WITH {sql.ALL_LINKS} SELECT page_id FROM traps",
    "link_filters": f"""
        WITH {_A} SELECT url, {sql.not_html("p")} AS not_html, {sql.not_html("p", U.LEGACY_HTML)} AS not_html_legacy,
               {sql.IS_TRAP.format(p="path")} AS trap, strlen(p) > 250 AS too_long, regexp_matches(p, '^[!-~]+$') AS parses FROM ap""",
    "trap_urls": f"WITH {_A} SELECT url FROM ap WHERE {sql.IS_TRAP.format(p='path')}",
    "domain_roots": f"WITH {_A} SELECT DISTINCT host, {sql.ROOT.format(h='host')} AS root FROM ap",
    "academic_domains": f"WITH {_A} SELECT DISTINCT host, regexp_matches(host, '^.+\\.(edu|ac\\.?)$') AS academic FROM ap WHERE {sql.IS_NAME.format(h='host')}",
    "frontier_priority": f"WITH {_L} SELECT url, priority FROM fr",
    "frontier_seen": f"WITH {_L} SELECT count(*) AS seen FROM fr",
    "frontier_new": f"WITH {_L} SELECT url, priority FROM fr WHERE url NOT IN (SELECT url FROM seen_urls WHERE url IS NOT NULL)",
    "frontier_pop_order": f"WITH {_L}, {_POPPED.format('fr')} SELECT queue, url, priority, rk FROM pop WHERE rk <= 20",
    "frontier_round_robin": f"WITH {_L}, {_POPPED.format('fr')} SELECT rk, queue, url, priority FROM pop ORDER BY rk, queue LIMIT 500",
    "frontier_pop_order_all": f"WITH {_L}, {_POPPED.format('fr')} SELECT queue, url, priority, rk FROM pop",
    "frontier_round_robin_all": f"WITH {_L}, {_POPPED.format('fr')} SELECT rk, queue, url, priority FROM pop ORDER BY rk, queue",
    "frontier_pages": f"WITH {_L}, {_PAGED} SELECT queue, url, priority, page FROM pg",
    "frontier_page_max": f"WITH {_L}, {_PAGED} SELECT queue, page, min(url) AS lower, count(*) AS n, max(priority) AS value FROM pg GROUP BY queue, page",
    "frontier_lookup": f"WITH {_L}, {_PAGED} SELECT queue, url, page FROM pg",
    "robots_rules": f"WITH {_RULES} SELECT host, prefix FROM rules",
    "robots_allowed": f"""
        WITH {_A}, {_RULES}
        SELECT url, NOT EXISTS (SELECT 1 FROM rules WHERE rules.host = ap.host AND starts_with(ap.path, rules.prefix)) AS allowed FROM ap""",
    "root_jobs": f"WITH {_POPPED.format('root_set')} SELECT queue, url, priority, rk FROM pop",
    "host_workers": """
        SELECT h.host, w.tid FROM (SELECT DISTINCT host FROM jobs WHERE host IS NOT NULL) h
        LEFT JOIN (SELECT host, min(tid) AS tid FROM recent_domains WHERE host IS NOT NULL GROUP BY host) w ON h.host = w.host""",
}
