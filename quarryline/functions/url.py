"""URLs as built-in expressions: parsing, resolving, filters.

Follows the URL standard for http and https: surrounding blanks and inner tabs
and line breaks go, scheme and host are lower case, default ports and dot
segments are removed, path characters outside the allowed set are
percent-encoded. Hosts outside ASCII are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings of addresses that are clearly no HTML (case counts).
NOT_HTML = """css js mp3 mp4 m4v mov dmg pt vdi ova m2ts rmvb npz mat data xml 7z gz gztar pdf png PNG ico ICO jpg JPG gif GIF
svg SVG json""".split()
#: Those of them that the legacy crawler let pass.
LEGACY_HTML = "mp3 xml svg SVG json".split()
#: Fixed value: the pattern of links in a page.
HREF = "href=['\"]([^'\"]+)['\"]"
#: Fixed value: domains of academic institutions.
ACADEMIC = r"^.+\.(edu|ac\.?)$"

_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
_UNSAFE = r"[^!-~]|[\"<>`{}^]"
_DOTS = r"(?i)(^|/)(\.|%2e){1,2}(/|$)"


def trimmed(c: Column) -> Column:
    """Without surrounding control characters and blanks, and without tabs and line breaks."""
    return F.regexp_replace(c, "^[\\x00-\\x20]+|[\\x00-\\x20]+$|[\\t\\n\\r]", "")


def hrefs(html: Column) -> Column:
    """All link targets of a page in order."""
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it.

    Keeps long chains of string steps linear in size where plain expressions
    would be copied into one another.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _without_dots(path: Column) -> Column:
    """``path`` with dot segments resolved (a segment may write its dots as %2e)."""
    plain = lambda s: F.regexp_replace(s, "(?i)%2e", ".")

    def step(acc: Column, s: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return let(plain(s), lambda p: F.when(p == "..", up).when(p == ".", acc).otherwise(F.concat(acc, F.array(s))))

    def folded(segments: Column) -> Column:
        kept = F.aggregate(segments, F.array().cast("array<string>"), step)
        ends = plain(F.element_at(segments, -1)).isin(".", "..")
        return let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(ends & (F.size(k) > 0), "/").otherwise("")))

    return F.when(path.rlike(_DOTS), let(F.split(F.substr(path, F.lit(2)), "/"), folded)).otherwise(path)


def _encoded(path: Column) -> Column:
    each = F.transform(F.split(path, ""), lambda c: F.when(c.rlike(_UNSAFE), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.when(path.rlike(_UNSAFE), F.array_join(each, "")).otherwise(path)


def address(url: Column) -> Column:
    """A struct: scheme, authority, host, path, query and the whole ``href``, without fragment.

    Null where ``url`` is no http or https address with a host.
    """

    def compose(scheme: Column, authority: Column, host: Column, path: Column, query: Column) -> Column:
        href = F.concat(scheme, F.lit("://"), authority, path, query)
        return F.struct(scheme.alias("scheme"), authority.alias("authority"), host.alias("host"), path.alias("path"), query.alias("query"), href.alias("href"))

    def from_text(m: Column) -> Column:
        scheme = F.lower(F.regexp_extract(m, _SCHEME, 1))
        query = F.regexp_extract(m, r"(?s)^[^?#]*(\?[^#]*)", 1)
        raw = F.regexp_extract(m, "(?i)^https?:/*[^/?#]*([^?#]*)", 1)
        path = let(raw, lambda p: F.when(p == "", "/").otherwise(let(_without_dots(p), _encoded)))

        def from_site(site: Column) -> Column:
            port = F.regexp_extract(site, ":([0-9]+)$", 1)
            default = F.when(scheme == "http", "80").otherwise("443")
            host = F.lower(F.regexp_replace(F.regexp_replace(site, "^.*@", ""), ":[0-9]*$", ""))
            shown = F.when((port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise("")

            def from_host(h: Column) -> Column:
                good = (h != "") & ~h.rlike("[\\x00-\\x20#/<>?@\\\\^|%]")
                authority = F.concat(F.regexp_extract(site, "^.*@", 0), h, shown)
                return F.when(good, let(F.struct(scheme.alias("s"), authority.alias("a"), path.alias("p"), query.alias("q")), lambda x: compose(x["s"], x["a"], h, x["p"], x["q"])))

            return let(host, from_host)

        return let(F.regexp_extract(m, "(?i)^https?:/*([^/?#]*)", 1), from_site)

    def from_trimmed(t: Column) -> Column:
        m = F.when(F.instr(t, "\\") > 0, F.concat(F.translate(F.regexp_extract(t, "^[^?#]*", 0), "\\", "/"), F.regexp_extract(t, "(?s)[?#].*$", 0))).otherwise(t)
        return let(m, lambda x: F.when(x.rlike("(?i)^https?:/*[^/?#]"), from_text(x)))

    return let(trimmed(url), from_trimmed)


def parse_urls(df: DataFrame, url: str, into: str = "u") -> DataFrame:
    """``df`` with the ``address`` of column ``url`` as column ``into``.

    The generator makes it one computation a row: filters and fields of the
    struct stay above it instead of copying the expression.
    """
    return df.select("*", F.explode(F.array(address(F.col(url)))).alias(into))


def resolve(base: str, href: Column) -> Column:
    """``href`` against the parsed base struct (P09), not yet parsed itself."""
    return let(trimmed(href), lambda h: _joined(base, h))


def _joined(base: str, h: Column) -> Column:
    b = lambda x: F.col(f"{base}.{x}")
    site = F.concat(b("scheme"), F.lit("://"), b("authority"))
    slash = h.rlike(r"^[/\\]")
    return (
        F.when(h.rlike(_SCHEME), h)
        .when(h.rlike(r"^[/\\]{2}"), F.concat(b("scheme"), F.lit(":"), h))
        .when(slash, F.concat(site, h))
        .when(h.startswith("?"), F.concat(site, b("path"), h))
        .when(h.startswith("#") | (h == ""), F.concat(site, b("path"), b("query"), h))
        .otherwise(F.concat(site, F.regexp_replace(b("path"), "[^/]*$", ""), h))
    )


def domain_root(host: Column) -> Column:
    """The last two labels (P10)."""
    labels = F.split(host, "[.]")
    return F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)


def is_domain(host: Column) -> Column:
    """Whether a host is a name and no IP address."""
    return ~host.rlike(r"^(\[.*|[0-9]+([.][0-9]+){3})$")


def is_trap(path: Column) -> Column:
    """Whether path segments repeat two times or more."""
    segments = F.split(F.substr(path, F.lit(2)), "/")
    return F.size(segments) - F.size(F.array_distinct(segments)) >= 2


def clearly_not_html(url: Column, legacy: bool = False) -> Column:
    """one of 31 endings (26 for the legacy crawler), or no http address."""
    ends = [e for e in NOT_HTML if not (legacy and e in LEGACY_HTML)]
    return url.rlike(r"\.(" + "|".join(ends) + r")\z") | ~url.startswith("http")


def is_academic(domain: Column) -> Column:
    """F14."""
    return domain.rlike(ACADEMIC)


def parses(url: Column) -> Column:
    """visible ASCII only, and short enough for a header."""
    return url.rlike("^[!-~]+$") & (F.length(url) < 65_535)
