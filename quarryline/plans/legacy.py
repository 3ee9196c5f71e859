"""Queries by the legacy crawler's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LEGACY
from ..functions import url as U
from ..operators import links, metrics, robots, text
from ..session import cut
from ..sources import read_table
from . import sql
from .events import _COUNTED, _jobs
from .frontier import _A, _RULES

HANDLERS = 300


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return text.legacy_terms(read_table(spark, sf, "pages"))


def legacy_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of every page with a body tag."""
    return text.posting_weights(_terms(spark, sf), LEGACY)


def legacy_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of every page with a body tag; 0 has no logarithm."""
    return text.doc_lengths(_terms(spark, sf), LEGACY).withColumn("log2_terms", F.when(F.col("n_terms") > 0, F.col("log2_terms")))


def legacy_links(spark: SparkSession, sf: str) -> DataFrame:
    """L03, L04, L07, L08, D06, A16, F04L, F14."""
    return links.legacy_links(read_table(spark, sf, "pages"), HANDLERS)


def legacy_links_reserved(spark: SparkSession, sf: str) -> DataFrame:
    """``legacy_links`` with hosts judged without their reserved last label: test hosts end in none of the academic domains."""
    return links.legacy_links(read_table(spark, sf, "pages"), HANDLERS, name=links.unreserved)


def legacy_handlers(spark: SparkSession, sf: str) -> DataFrame:
    """The handlers' shares of the queued urls."""
    return legacy_links_reserved(spark, sf).groupBy("handler").agg(F.count(F.lit(1)).alias("urls"))


def legacy_robots(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct urls of jobs, checked by the legacy rules; urls without a host are disallowed."""
    rules = robots.legacy_rules(read_table(spark, sf, "documents").where("source = 'robotstxt'"), "host", "text")
    urls = U.parse_urls(read_table(spark, sf, "jobs").select("url").where("url is not null").distinct(), "url")
    rows = cut(urls.select("url", F.col("u.host").alias("host"), F.col("u.path").alias("path")))
    checked = robots.allowed(rows, rules)
    return checked.select("url", (F.col("host").isNotNull() & F.col("allowed")).alias("allowed"))


def legacy_report(spark: SparkSession, sf: str) -> DataFrame:
    """Seven figures an hour; of the events, a signup is a robots hit, an hour's users are the active tasks and its first-seen users the seen urls."""
    jobs = _jobs(spark, sf).withColumn("start", F.date_trunc("hour", "ts"))
    users = read_table(spark, sf, "events").select("user_id", F.date_trunc("hour", "ts").alias("start"))
    is_ = lambda s: F.count_if(F.col("status") == s)
    counts = jobs.groupBy("start").agg(F.count(F.lit(1)).alias("urls"), is_("failed").alias("failed"), F.sum("ms").alias("ms"), is_("skipped").alias("hits"))
    active = users.where("user_id is not null").groupBy("start").agg(F.count_distinct("user_id").alias("active"))
    seen = users.where("user_id is not null").groupBy("user_id").agg(F.min("start").alias("start")).groupBy("start").agg(F.count(F.lit(1)).alias("seen"))
    rows = counts.join(active, "start", "left").join(seen, "start", "left").na.fill(0, ["active", "seen"])
    return metrics.legacy_report(rows, "start")


_FNS = [legacy_postings, legacy_lengths, legacy_links, legacy_links_reserved, legacy_handlers, legacy_robots, legacy_report]
QUERIES = {f.__name__: f for f in _FNS}

_TOK = f"""{sql.CRAWLED},
    lt AS (SELECT page_id, url, flatten(list_transform(regexp_extract_all(regexp_extract(html, '{text.LEGACY_SECTION}'), '{text.TEXT_NODE}', 1), lambda x: {sql._TERMS.format("x")})) AS terms
           FROM cr WHERE regexp_matches(html, '<body[^<>]*>'))"""


def _links(name: str) -> str:
    academic = lambda h: f"({sql.IS_NAME.format(h=h)} AND regexp_matches({name.format(h=h)}, '{U.ACADEMIC}'))"
    return f"""{sql.CRAWLED}, {sql.links("cr")},
    q AS (SELECT DISTINCT scheme || '://' || authority || path AS url, host FROM u WHERE {academic("bh")} AND {academic("host")}),
    lq AS (SELECT url, CAST(CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) % {HANDLERS} AS INTEGER) AS handler FROM q
           WHERE NOT {sql.not_html("url", U.LEGACY_HTML)} AND strlen(url) <= {LEGACY.max_url_len})"""


_RESERVED = _links("regexp_replace({h}, '\\.(test|example|invalid)$', '')")

SQL = {
    "legacy_postings": f"""
        WITH {_TOK}, e AS (SELECT page_id, len(terms) AS n, unnest(terms) AS term FROM lt)
        SELECT page_id, term, count(*) AS cnt, CAST(least(count(*) * 2550 // n, 255) AS INTEGER) AS wt FROM e GROUP BY page_id, term, n""",
    "legacy_lengths": f"WITH {_TOK} SELECT page_id, url, CAST(len(terms) AS BIGINT) AS n_terms, CASE WHEN len(terms) > 0 THEN CAST(length(bin(len(terms))) - 1 AS INTEGER) END AS log2_terms FROM lt",
    "legacy_links": f"WITH {_links('{h}')} SELECT url, handler FROM lq",
    "legacy_links_reserved": f"WITH {_RESERVED} SELECT url, handler FROM lq",
    "legacy_handlers": f"WITH {_RESERVED} SELECT handler, count(*) AS urls FROM lq GROUP BY handler",
    "legacy_robots": f"""
        WITH {_A}, {_RULES.replace("text IS NOT NULL", f"strlen(text) <= {LEGACY.max_robots_len}")},
             ok AS (SELECT url FROM ap WHERE NOT EXISTS (SELECT 1 FROM rules WHERE rules.host = ap.host AND starts_with(ap.path, rules.prefix)))
        SELECT url, url IN (SELECT url FROM ok) AS allowed FROM ju""",
    "legacy_report": f"""
        WITH {_COUNTED.format("hour")},
             us AS (SELECT user_id, date_trunc('hour', ts) AS start FROM events WHERE user_id IS NOT NULL),
             ac AS (SELECT start, count(DISTINCT user_id) AS active FROM us GROUP BY start),
             se AS (SELECT start, count(*) AS n FROM (SELECT user_id, min(start) AS start FROM us GROUP BY user_id) GROUP BY start)
        SELECT h.start, completed AS urls, round(failed * 100.0 / completed, 4) AS pct_errs, round(CAST(ms AS DOUBLE) / completed, 4) AS ms_per_url,
               round(skipped * 100.0 / completed, 4) AS pct_robot_hits, coalesce(active, 0) AS active,
               CAST(sum(completed) OVER (ORDER BY h.start) AS BIGINT) AS crawled, CAST(sum(coalesce(n, 0)) OVER (ORDER BY h.start) AS BIGINT) AS seen
        FROM h LEFT JOIN ac ON ac.start = h.start LEFT JOIN se ON se.start = h.start""",
}
