"""From pages to terms: sections, text nodes, tokens, counts, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LEGACY, PROD, Config
from ..session import spread

#: A page's sections, its text nodes, its terms.
SECTION = r"(?s)<(body|/script|/style)([^<>]*)>.*?(</body>|<script|<style)"
TEXT_NODE = ">([^<>]+)"
TERM = "[a-zA-Z]+"
#: Fixed value: the legacy crawler's section, which runs to the end of the page.
LEGACY_SECTION = "(?s)<body[^<>]*>.*"


def capped(html: Column, n_bytes: int) -> Column:
    """The first ``n_bytes`` bytes, a cut character replaced.

    This is what a crawler reads of a body, so links are taken from it; the
    index of stored pages reads them whole.
    """
    cut = F.make_valid_utf8(F.substring(html.cast("binary"), 1, n_bytes).cast("string"))
    return F.when(F.octet_length(html) > n_bytes, cut).otherwise(html)


def text_nodes(html: Column) -> Column:
    """All text nodes of all sections, in order."""
    sections = F.regexp_extract_all(html, F.lit(SECTION), F.lit(0))
    return F.flatten(F.transform(sections, lambda s: F.regexp_extract_all(s, F.lit(TEXT_NODE), F.lit(1))))


def terms_of(text: Column) -> Column:
    """Lower-case terms of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def n_terms(html: Column) -> Column:
    """The number of terms of a page (A02), without building them."""
    return F.aggregate(text_nodes(html), F.lit(0), lambda n, t: n + F.regexp_count(t, F.lit(TERM)))


def page_terms(pages: DataFrame) -> DataFrame:
    """``pages`` with ``terms``: a page's terms in order, in one scan.

    The generator makes it one tokenisation a page, whatever is later asked of the terms.
    """
    terms = F.flatten(F.transform(text_nodes(F.col("html")), terms_of))
    return spread(pages.where(F.col("html").isNotNull())).select("*", F.explode(F.array(terms)).alias("terms")).drop("html")


def term_counts(rows: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """(key, term, cnt)."""
    return rows.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("cnt"))


def log2_floor(n: Column) -> Column:
    """floor(log2(n)) of a positive number."""
    return (F.length(F.bin(n)) - 1).cast("int")


def doc_lengths(rows: DataFrame, cfg: Config = PROD) -> DataFrame:
    """(page_id, url, n_terms, log2_terms) of pages long enough to index."""
    n = rows.select("page_id", "url", F.size("terms").cast("long").alias("n_terms")).where(F.col("n_terms") >= cfg.min_n_tokens)
    return n.withColumn("log2_terms", log2_floor(F.col("n_terms")))


def weight(cnt: Column, n: Column) -> Column:
    """The quantised frequency, at most 255."""
    return F.least(F.floor(cnt * 2550 / n), F.lit(255)).cast("int")


def posting_weights(rows: DataFrame, cfg: Config = PROD) -> DataFrame:
    """(page_id, term, cnt, wt) of indexed pages."""
    long = rows.where(F.size("terms") >= cfg.min_n_tokens)
    each = long.select("page_id", F.size("terms").cast("long").alias("n_terms"), F.explode("terms").alias("term"))
    counted = each.groupBy("page_id", "n_terms", "term").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.select("page_id", "term", "cnt", weight(F.col("cnt"), F.col("n_terms")).alias("wt"))


def article_terms(pages: DataFrame, cfg: Config = PROD) -> DataFrame:
    """(page_id, n_article_terms, n_terms): terms in text nodes of over 30 terms, and all."""
    sizes = F.transform(text_nodes(F.col("html")), lambda t: F.regexp_count(t, F.lit(TERM)))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x).cast("long")
    counts = spread(pages.where(F.col("html").isNotNull())).select("page_id", sizes.alias("s"))
    return counts.select("page_id", total(F.filter("s", lambda x: x > cfg.article_terms)).alias("n_article_terms"), total(F.col("s")).alias("n_terms"))


def legacy_terms(pages: DataFrame, cfg: Config = LEGACY) -> DataFrame:
    """(page_id, url, terms) by the legacy rule (L01, L02): one section from the first body tag to the end, scripts included, pages of any length.

    Pages without a body tag are not indexed; the body is what was read of it (S02).
    """
    body = F.regexp_extract(capped(F.col("html"), cfg.max_document_len), LEGACY_SECTION, 0)
    terms = F.flatten(F.transform(F.regexp_extract_all(body, F.lit(TEXT_NODE), F.lit(1)), terms_of))
    return spread(pages.where(F.col("html").rlike("<body[^<>]*>"))).select("page_id", "url", F.explode(F.array(terms)).alias("terms"))
