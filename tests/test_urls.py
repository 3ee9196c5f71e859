"""Addresses: parsing, resolving, filters."""

import pytest
from pyspark.sql import functions as F

from quarryline.functions import url as U

BASE = "http://A.example:80/x/y/z.html?q=1#f"
JOINS = [
    ("https://B.example/p?a=1#c", "https://b.example/p?a=1"),
    ("//b.example/p", "http://b.example/p"),
    ("/p/./q/../r", "http://a.example/p/r"),
    ("?n=2", "http://a.example/x/y/z.html?n=2"),
    ("#t", "http://a.example/x/y/z.html?q=1"),
    ("w.html", "http://a.example/x/y/w.html"),
    ("../w", "http://a.example/x/w"),
    ("../../../w", "http://a.example/w"),
    ("./", "http://a.example/x/y/"),
    ("..", "http://a.example/x/"),
    ("%2e%2E/w", "http://a.example/x/w"),
    ("a bü\"<>", "http://a.example/x/y/a%20b%C3%BC%22%3C%3E"),
    ("/中", "http://a.example/%E4%B8%AD"),
    ("http:\\\\b.example\\p", "http://b.example/p"),
    ("https://b.example:443/", "https://b.example/"),
    ("https://b.example:8443", "https://b.example:8443/"),
    ("https://u:p@b.example/s", "https://u:p@b.example/s"),
    (" \t/p\n", "http://a.example/p"),
    ("mailto:a@b.example", None),
    ("javascript:x()", None),
    ("http://", None),
    ("http://a b/", None),
]


def test_resolve(spark):
    rows = spark.createDataFrame([(i, BASE, h) for i, (h, _) in enumerate(JOINS)], "i int, base string, href string")
    out = U.parse_urls(U.parse_urls(rows, "base", "b").withColumn("t", U.resolve("b", F.col("href"))), "t", "u").select("i", "u.href").collect()
    assert [r.href for r in sorted(out)] == [w for _, w in JOINS]


def test_null_and_odd_addresses(spark):
    rows = spark.createDataFrame([(None,), ("",), ("x",), ("ftp://a/",), ("HTTPS://A.Example",)], "url string")
    assert [r.h for r in U.parse_urls(rows, "url").select(F.col("u.href").alias("h")).collect()] == [None, None, None, None, "https://a.example/"]


TRAPS = [
    ("https://give.stthomas.edu/about/gift-officers/about/impact/gratitude/about/impact/give/impact/morrison-family-college-of-health/index.html", True),
    ("https://www.nap.edu/topic/404/behavioral-and-social-sciences/human-systems-and-technology", False),
    ("https://give.stthomas.edu/about/gift-officers/about/about/morrison-family-college-of-health/index.html", True),
    ("https://a.example/", False),
]


def test_traps(spark):
    rows = U.parse_urls(spark.createDataFrame([(u,) for u, _ in TRAPS], "url string"), "url")
    assert [r.t for r in rows.select(U.is_trap(F.col("u.path")).alias("t")).collect()] == [t for _, t in TRAPS]


@pytest.mark.parametrize(("host", "root"), [("columbia.edu", "columbia.edu"), ("math.columbia.edu", "columbia.edu"), ("src.math.columbia.edu", "columbia.edu"), ("localhost", "localhost"), ("a.co.uk", "co.uk")])
def test_domain_root(spark, host, root):
    assert spark.range(1).select(U.domain_root(F.lit(host))).first()[0] == root


def test_filters(spark):
    cases = [("http://a/x.PDF", False, False), ("http://a/x.pdf", True, True), ("http://a/x.json", True, False), ("http://a/xpdf", False, False), ("ftp://a/", True, True), ("http://a/x.pdf\n", False, False)]
    rows = spark.createDataFrame(cases, "u string, a boolean, b boolean")
    out = rows.select("a", "b", U.clearly_not_html(F.col("u")).alias("x"), U.clearly_not_html(F.col("u"), legacy=True).alias("y")).collect()
    assert all(r.a == r.x and r.b == r.y for r in out)


def test_names_and_academic(spark):
    rows = spark.createDataFrame([("1.2.3.4", False, False), ("[::1]", False, False), ("a.edu", True, True), ("a.ac", True, True), ("a.ac.", True, True), ("a.ac.uk", True, False)], "h string, n boolean, a boolean")
    assert all(r.n == r.x and r.a == r.y for r in rows.select("n", "a", U.is_domain(F.col("h")).alias("x"), U.is_academic(F.col("h")).alias("y")).collect())
