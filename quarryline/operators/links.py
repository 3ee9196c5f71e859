"""Outgoing links of pages, canonical and filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LEGACY, PROD, Config
from ..functions import url as U
from ..functions.hashing import hashed
from ..session import spread
from .text import capped, n_terms


def raw_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href), repeats kept; pos counts from 0."""
    return pages.select("page_id", "url", F.posexplode(U.hrefs(F.col("html"))).alias("pos", "href"))


def parsed_links(pages: DataFrame) -> DataFrame:
    """(page_id, b, links): for every page with a domain its parsed base and the parsed targets of its hrefs, in order.

    A target that is no http address is a null in its place. Each link is
    resolved and parsed once, inside its page's row.
    """
    base = U.parse_urls(pages, "url", "b").where(F.col("b").isNotNull() & U.is_domain(F.col("b.host")))
    links = F.transform(U.hrefs(F.col("html")), lambda h: U.address(U.resolve("b", h)))
    return base.select("page_id", "b", F.explode(F.array(links)).alias("links"))


def resolved_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, b, u): every href of a page with a domain; ``u`` is null where the target is no http address."""
    return parsed_links(spread(pages)).select("page_id", "b", F.posexplode("links").alias("pos", "u")).select("page_id", "pos", "b", "u")


def has_trap(links: str) -> Column:
    """Whether any of a page's parsed links is a trap."""
    return F.exists(links, lambda u: F.coalesce(U.is_trap(u["path"]), F.lit(False)))


def crawled(pages: DataFrame, cfg: Config = PROD) -> DataFrame:
    """``pages`` as a crawler follows them: what is read of a body (S02), and only pages long enough to index."""
    read = spread(pages).where(F.col("html").isNotNull()).withColumn("html", capped(F.col("html"), cfg.max_document_len))
    return read.where(n_terms(F.col("html")) >= cfg.min_n_tokens)


def page_links(pages: DataFrame, cfg: Config = PROD) -> DataFrame:
    """(page_id, source, pos, url, cross, inc): the links that pages hand to the frontier; source is the page's own address.

    Pages too short to index hand on none (F10), and a page with one trap link
    hands on none (F06): it is dropped before its links become rows. Query and
    fragment are cut off (P12).
    """
    whole = parsed_links(crawled(pages, cfg)).where(~has_trap("links"))
    links = whole.select("page_id", "b", F.posexplode("links").alias("pos", "u")).where(F.col("u").isNotNull())
    out = links.select("page_id", plain(F.col("b")).alias("source"), "pos", plain(F.col("u")).alias("url"), crosses(F.col("u.host"), F.col("b.host")).alias("cross"))
    out = out.where(~U.clearly_not_html(F.col("url")) & (F.octet_length("url") <= cfg.max_url_len) & U.parses(F.col("url")))
    return out.withColumn("inc", F.when(F.col("cross"), cfg.cross_domain_bonus).otherwise(1).cast("long"))


def plain(u: Column) -> Column:
    """An address without query and fragment."""
    return F.concat(u["scheme"], F.lit("://"), u["authority"], u["path"])


def crosses(host: Column, base: Column) -> Column:
    """Whether a link leaves its page's domain (P11); hosts that are no names don't."""
    return U.is_domain(host) & (U.domain_root(host) != U.domain_root(base))


def trap_pages(pages: DataFrame) -> DataFrame:
    """Pages, of any length, that link to a trap."""
    return parsed_links(spread(pages)).where(has_trap("links")).select("page_id")


def unreserved(host: Column) -> Column:
    """A host without a reserved last label, so that hosts of test data have the domains they stand for."""
    return F.regexp_replace(host, r"\.(test|example|invalid)$", "")


def legacy_links(pages: DataFrame, handlers: int, cfg: Config = LEGACY, name=lambda host: host) -> DataFrame:
    """(url, handler): what the legacy crawler queues.

    Links of academic pages to academic hosts, of pages of any length and with
    or without traps, each url once. A url's handler is a hash of its host.
    ``name``: Column -> Column, the domain that a host is judged by.
    """
    academic = lambda host: U.is_domain(host) & U.is_academic(name(host))
    read = spread(pages).where(F.col("html").isNotNull()).withColumn("html", capped(F.col("html"), cfg.max_document_len))
    links = parsed_links(read).where(academic(F.col("b.host"))).select(F.explode("links").alias("u")).where(F.col("u").isNotNull() & academic(F.col("u.host")))
    urls = links.select(plain(F.col("u")).alias("url"), F.col("u.host").alias("host"))
    fit = urls.where(~U.clearly_not_html(F.col("url"), legacy=True) & (F.octet_length("url") <= cfg.max_url_len))
    return fit.distinct().select("url", hashed(F.col("host"), handlers).alias("handler"))
