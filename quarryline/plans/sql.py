"""SQL text of steps that several oracle queries share."""

from __future__ import annotations

from ..config import PROD, Config
from ..functions import url as U
from ..operators import text as T

_TERMS = f"list_transform(regexp_extract_all({{}}, '{T.TERM}'), lambda t: lower(t))"
NODES = f"flatten(list_transform(regexp_extract_all(html, '{T.SECTION}'), lambda s: regexp_extract_all(s, '{T.TEXT_NODE}', 1)))"

TOK = f"""
    tok AS (SELECT page_id, url, flatten(list_transform({NODES}, lambda x: {_TERMS.format("x")})) AS terms FROM pages WHERE html IS NOT NULL),
    each AS (SELECT page_id, unnest(terms) AS term FROM tok),
    tc AS (SELECT page_id, term, count(*) AS cnt FROM each GROUP BY page_id, term),
    dl AS (SELECT page_id, url, CAST(len(terms) AS BIGINT) AS n_terms, CAST(length(bin(len(terms))) - 1 AS INTEGER) AS log2_terms
           FROM tok WHERE len(terms) >= 200)"""
TEXT_TERMS = _TERMS.format("text")


def index(cfg: Config) -> str:
    """docs (d) and postings (po) of pages."""
    return f"""{TOK},
    seq AS (SELECT *, CAST(page_id % {cfg.n_cores} AS INTEGER) AS core, row_number() OVER (PARTITION BY page_id % {cfg.n_cores} ORDER BY page_id) - 1 AS s FROM dl),
    d AS (SELECT core, CAST(s // {cfg.index_cap} AS INTEGER) AS db, CAST(s % {cfg.index_cap} AS BIGINT) AS doc_id, page_id, url, n_terms, log2_terms FROM seq),
    po AS (SELECT core, db, doc_id, term, cnt, CAST(least(cnt * 2550 // n_terms, 255) AS INTEGER) AS wt FROM tc JOIN d USING (page_id))"""


def search(cfg: Config, q: str) -> str:
    """Hits of the queries ``q`` (query_id, text) in d and po, up to the ranked ``best``."""
    bl = "CASE WHEN df * 65536 // {s} = 0 THEN 0 ELSE length(bin(df * 65536 // {s})) END".format(s=cfg.shard_size)
    return f"""
    qw AS (SELECT query_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS term FROM ({q})),
    qm AS (SELECT query_id, term, count(*) AS mult FROM qw WHERE term <> '' GROUP BY query_id, term),
    q AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_q FROM qm),
    h AS (SELECT * FROM po JOIN q USING (term)),
    f1 AS (SELECT query_id, core, db, term, mult, n_q, count(*) FILTER (WHERE wt > 0) AS df, max(wt) AS mx FROM h GROUP BY ALL),
    f2 AS (SELECT *, CAST(pow(2, ({bl}) // 2) AS BIGINT) AS idf FROM f1),
    f3 AS (SELECT *, idf // min(idf) OVER w AS ridf, count(*) OVER w AS there FROM f2 WINDOW w AS (PARTITION BY query_id, core, db)),
    f4 AS (SELECT *, ridf * (CAST(sum(mult * (mx // ridf)) OVER (PARTITION BY query_id, core, db) AS BIGINT) // 255 + 1) AS den FROM f3 WHERE there = n_q),
    f5 AS (SELECT *, CAST(pow(2, CASE WHEN den <= 1 THEN 0 ELSE length(bin(den - 1)) END) AS BIGINT) AS divisor FROM f4),
    sc AS (SELECT query_id, core, db, doc_id, n_q, CAST(sum(h.mult * (h.wt // f5.divisor)) AS BIGINT) AS score, count(*) AS nz
           FROM h JOIN f5 USING (query_id, core, db, term, n_q) WHERE h.wt // f5.divisor > 0 GROUP BY ALL),
    best AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, core, db, doc_id) AS INTEGER) AS pos,
                    url, score, log2_terms, core, db, doc_id
             FROM sc JOIN d USING (core, db, doc_id) WHERE nz = n_q AND log2_terms >= 8 QUALIFY pos <= {cfg.top_k})"""


def parsed(name: str, src: str, keep: str, url: str) -> str:
    """CTEs that end in ``name``: ``keep``, scheme, authority, host, path, query of ``url`` in ``src`` (nulls where it is no address)."""
    n = name
    seg = "list_transform(string_split(substr(path, 2), '/'), lambda s: [s])"
    k = "regexp_replace(x[1], '(?i)%2e', '.', 'g')"
    fold = f"list_reduce({seg}, lambda acc, x: CASE WHEN {k} = '..' THEN acc[:len(acc) - 1] WHEN {k} = '.' THEN acc ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[]))"
    last = "regexp_matches(path, '(?i)(^|/)(\\.|%2e){1,2}$')"
    return f"""
    {n}1 AS (SELECT {keep}, regexp_replace({url}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$|[\\t\\n\\r]', '', 'g') AS t FROM {src}),
    {n}2 AS (SELECT {keep}, CASE WHEN regexp_matches(t, '(?i)^https?:/*[^/?#]') THEN t END AS m FROM {n}1),
    {n}3 AS (SELECT {keep}, m, lower(regexp_extract(m, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(m, '(?i)^https?:/*([^/?#]*)', 1) AS auth0,
                    regexp_extract(m, '(?i)^https?:/*[^/?#]*([^?#]*)', 1) AS p0, regexp_extract(m, '^[^?#]*(\\?[^#]*)', 1) AS query FROM {n}2),
    {n}4 AS (SELECT *, lower(regexp_replace(regexp_replace(auth0, '^.*@', ''), ':[0-9]*$', '')) AS host, regexp_extract(auth0, ':([0-9]+)$', 1) AS port,
                    CASE WHEN p0 = '' THEN '/' ELSE p0 END AS path FROM {n}3),
    {n}5 AS (SELECT * EXCLUDE (path), CASE WHEN regexp_matches(path, '(?i)(^|/)(\\.|%2e){{1,2}}(/|$)')
                THEN '/' || array_to_string({fold}, '/') || CASE WHEN {last} AND len({fold}) > 0 THEN '/' ELSE '' END ELSE path END AS path FROM {n}4),
    {n} AS (SELECT {keep}, scheme, regexp_extract(auth0, '^.*@') || host || CASE WHEN port IN ('', CASE WHEN scheme = 'http' THEN '80' ELSE '443' END) THEN '' ELSE ':' || port END AS authority,
                   host, query, CASE WHEN regexp_matches(path, '[^!-~]|["<>`{{}}^]') THEN array_to_string(list_transform(string_split(path, ''),
                      lambda c: CASE WHEN regexp_matches(c, '[^!-~]|["<>`{{}}^]') THEN regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') ELSE c END), '') ELSE path END AS path
            FROM {n}5 WHERE m IS NOT NULL AND host <> '' AND NOT regexp_matches(host, '[\\x00-\\x20#/<>?@\\\\^|%]'))"""


ROOT = "CASE WHEN len(string_split({h}, '.')) > 2 THEN array_to_string(string_split({h}, '.')[-2:], '.') ELSE {h} END"
IS_NAME = r"NOT regexp_matches({h}, '^(\[.*|[0-9]+([.][0-9]+){{3}})$')"
IS_TRAP = "len(string_split(substr({p}, 2), '/')) - len(list_distinct(string_split(substr({p}, 2), '/'))) >= 2"


def not_html(u: str, but: list[str] = ()) -> str:
    """F04 of the expression ``u``; endings of ``but`` pass."""
    ends = "|".join(e for e in U.NOT_HTML if e not in but)
    return f"(regexp_matches({u}, '\\.({ends})$') OR NOT starts_with({u}, 'http'))"


_HREF = U.HREF.replace("'", "''")
_CUT = ", ".join(f"try(decode(encode(html)[1:{PROD.max_document_len - i}]))" for i in range(4))
#: Pages as a crawler reads them (cr), and those of them that it indexes (long).
CRAWLED = f"""
    cr AS (SELECT page_id, url, CASE WHEN strlen(html) <= {PROD.max_document_len} THEN html ELSE coalesce({_CUT}) END AS html FROM pages WHERE html IS NOT NULL),
    long AS (SELECT * FROM cr WHERE len(flatten(list_transform({NODES}, lambda x: regexp_extract_all(x, '{T.TERM}')))) >= {PROD.min_n_tokens})"""


def links(src: str) -> str:
    """Links of the pages in ``src``: all addresses (u), pages with a trap (traps), what goes to the frontier (links, fr)."""
    return f"""{parsed("b", src, "page_id, html", "url")},
    hr AS (SELECT page_id, b.scheme AS bs, b.authority AS ba, b.host AS bh, b.path AS bp, b.query AS bq,
                  unnest(regexp_extract_all(html, '{_HREF}', 1)) AS href,
                  unnest(range(len(regexp_extract_all(html, '{_HREF}', 1)))) AS pos
           FROM b WHERE {IS_NAME.format(h="host")}),
    tg AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, bh, CASE
                  WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN bs || ':' || href
                  WHEN starts_with(href, '/') THEN bs || '://' || ba || href WHEN starts_with(href, '?') THEN bs || '://' || ba || bp || href
                  WHEN starts_with(href, '#') THEN bs || '://' || ba || bp || bq || href
                  ELSE bs || '://' || ba || regexp_replace(bp, '[^/]*$', '') || href END AS target FROM hr),
    {parsed("u", "tg", "page_id, pos, bh", "target")},
    traps AS (SELECT DISTINCT page_id FROM u WHERE {IS_TRAP.format(p="path")}),
    ln AS (SELECT page_id, pos, scheme || '://' || authority || path AS url,
                  {IS_NAME.format(h="host")} AND {ROOT.format(h="host")} <> {ROOT.format(h="bh")} AS cross, CAST(1 AS BIGINT) AS inc
           FROM u WHERE page_id NOT IN (SELECT page_id FROM traps)),
    links AS (SELECT * FROM ln WHERE NOT {not_html("url")} AND strlen(url) <= {PROD.max_url_len} AND regexp_matches(url, '^[!-~]+$')),
    fr AS (SELECT url, CAST(sum(inc) AS BIGINT) AS priority FROM links GROUP BY url)"""


LINKS = f"{CRAWLED}, {links('long')}"
ALL_LINKS = links("pages")
QUEUE = "CAST(CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % 64 AS INTEGER)"
