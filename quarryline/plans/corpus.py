"""Queries from pages to index and search."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROD
from ..operators import index as I
from ..operators import rle, search, text
from ..session import cut, shared_path
from ..sources import read_table
from . import sql

ONE = replace(PROD, n_cores=1)
SMALL = replace(PROD, index_cap=50, shard_size=50)
DBS = 1000  # shards that each core has room for when shards are merged; more if the data have more
SEARCHES = {
    "search_one_term": "this",
    "search_two_terms": "and from",
    "search_three_terms": "is that this",
    "search_duplicate_term": "This that this",
    "search_missing_term": "this zzznone",
}


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages")


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    return I.build_index(_pages(spark, sf), SMALL)[1]


def term_counts(spark: SparkSession, sf: str) -> DataFrame:
    """P01-P05, A01."""
    return text.term_counts(text.page_terms(_pages(spark, sf)), "page_id")


def doc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """A02, F10, P07."""
    return text.doc_lengths(text.page_terms(_pages(spark, sf)))


def posting_weights(spark: SparkSession, sf: str) -> DataFrame:
    """P06."""
    return text.posting_weights(text.page_terms(_pages(spark, sf)))


def doc_text_terms(spark: SparkSession, sf: str) -> DataFrame:
    """P04, P05 over plain text."""
    rows = read_table(spark, sf, "documents").select("doc_id", text.terms_of(F.col("text")).alias("terms"))
    return text.term_counts(rows, "doc_id")


def article_terms(spark: SparkSession, sf: str) -> DataFrame:
    """F15, A17."""
    return text.article_terms(_pages(spark, sf))


def shard_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """W01, W02, R04 (the last, short shard is kept)."""
    docs = text.doc_lengths(text.page_terms(_pages(spark, sf)))
    return I.assign_shards(docs, SMALL).select("core", "db", "doc_id", "page_id", "url", "n_terms", "log2_terms")


def posting_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists as text, in the order of documents."""
    lists = I.posting_lists(_postings(spark, sf))
    joined = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"], p["wt"])), ",")
    return lists.select("core", "db", "term", joined.alias("postings"))


def doc_frequency_idf(spark: SparkSession, sf: str) -> DataFrame:
    """A04, P19."""
    return search.term_figures(_postings(spark, sf), SMALL.shard_size).select("core", "db", "term", "df", "idf")


def term_max_weight(spark: SparkSession, sf: str) -> DataFrame:
    """A05."""
    return search.term_figures(_postings(spark, sf), SMALL.shard_size).select("core", "db", "term", "mx")


def shard_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """S08."""
    return I.shard_vocabulary(_postings(spark, sf))


def shard_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct terms of all shards."""
    return _postings(spark, sf).select("term").distinct()


def shard_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A14, U02, S13."""
    docs, postings = I.build_index(_pages(spark, sf), SMALL)
    return I.merge_shards(postings, docs, DBS, SMALL)[0]


def posting_runs(spark: SparkSession, sf: str) -> DataFrame:
    """W08, E01."""
    return rle.posting_runs(_postings(spark, sf))


def posting_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Postings back from their runs."""
    return rle.decode_runs(rle.posting_runs(_postings(spark, sf)))


def _search(words: str, cfg):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """J01-J03, A04-A08, F11, F12, P16, P20, T01, T02."""
        docs, postings = I.build_index(_pages(spark, sf), cfg, list(dict.fromkeys(words.lower().split())))
        return search.search(postings, docs, search.queries_table(spark, {1: words}), cfg)

    return run


def scanned_count(spark: SparkSession, sf: str) -> DataFrame:
    """A12."""
    _, postings = I.build_index(_pages(spark, sf), SMALL, ["this", "posted"])
    return search.scanned(postings, search.queries_table(spark, {1: "this posted"}), SMALL)


def _stored(spark: SparkSession, sf: str, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored index with repeated rows taken once; rows of one term of a document are one posting.

    Only postings of query terms are cleaned: the normal term is part of the
    key of both steps, so the result is what cleaning all of them would give.
    """
    keys = ["core", "db", "doc_id"]
    rows = read_table(spark, sf, "postings").where("term is not null").select(*keys, F.col("term").alias("raw"), F.trim(F.lower("term")).alias("term"), "cnt", "wt")
    asked = rows.join(queries.select("term").distinct(), "term", "left_semi").distinct()
    postings = asked.groupBy(*keys, "term").agg(F.least(F.sum("wt"), F.lit(255)).cast("int").alias("wt"))
    return read_table(spark, sf, "docs"), postings


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, text) of the recorded queries."""
    asked = read_table(spark, sf, "search_results").select("query_id", F.col("query_text").alias("text")).where("text is not null and query_id is not null")
    return asked.groupBy("query_id").agg(F.min("text").alias("text"))


def search_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Every recorded query text, answered over the stored index in one plan; documents without a stored length are no results."""
    queries = cut(search.split_queries(_asked(spark, sf)))
    docs, postings = _stored(spark, sf, queries)
    return search.search(cut(postings), docs, queries, PROD)


def search_recorded_all(spark: SparkSession, sf: str) -> DataFrame:
    """``search_recorded`` with missing lengths taken from ``n_terms``, so that every long document can be a result."""
    queries = cut(search.split_queries(_asked(spark, sf)))
    docs, postings = _stored(spark, sf, queries)
    docs = docs.withColumn("log2_terms", F.coalesce("log2_terms", text.log2_floor(F.col("n_terms"))))
    return search.search(cut(postings), docs, queries, PROD)


def _written(spark: SparkSession, sf: str) -> str:
    """The folder of an index of all pages, written for this query."""
    path = shared_path(spark, "index")
    I.write_index(*I.build_index(_pages(spark, sf), SMALL), path)
    return path


def search_stored(spark: SparkSession, sf: str) -> DataFrame:
    """A search of an index that was written and is read back; only row groups with the query's terms are read."""
    words = "is that this"
    docs, postings = I.read_index(spark, _written(spark, sf))
    return search.search(postings.where(F.col("term").isin(words.split())), docs, search.queries_table(spark, {1: words}), SMALL)


def index_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Shards of a written index with their documents and postings, found again as folders."""
    docs, postings = I.read_index(spark, _written(spark, sf))
    n = docs.groupBy("core", "db").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_terms").alias("n_terms"))
    return n.join(postings.groupBy("core", "db").agg(F.count(F.lit(1)).alias("n_postings"), F.sum("wt").alias("wt")), ["core", "db"])


def posting_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Lists as the run codec stores them, weights of a segment without run as text."""
    segs = rle.encode_segments(_postings(spark, sf))
    return segs.select("core", "db", "term", "seg", "first_doc", "len", "wt", F.array_join("literal", ",").alias("literal"))


def posting_segments_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Postings back from encoded lists."""
    return rle.decode_segments(rle.encode_segments(_postings(spark, sf)))


def query_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the recorded query texts, in order."""
    asked = read_table(spark, sf, "search_results").where("query_text is not null").select("query_text").distinct()
    return asked.select("query_text", F.posexplode(search.query_terms(F.col("query_text"))).alias("pos", "term"))


_FNS = [term_counts, doc_lengths, posting_weights, doc_text_terms, article_terms, shard_assignment, posting_lists, doc_frequency_idf, term_max_weight, shard_vocabulary, shard_keys, shard_merge, posting_runs, posting_decoded, posting_segments, posting_segments_decoded, search_stored, index_stored, scanned_count, search_recorded, search_recorded_all, query_words]
QUERIES = {f.__name__: f for f in _FNS} | {k: _search(w, ONE) for k, w in SEARCHES.items()} | {"search_multi_shard": _search("is that this", SMALL)}

_IX = sql.index(SMALL)
_OUT = "SELECT query_id, pos, url, score, log2_terms, core, db, doc_id FROM best"
_NORM = f"count(*) FILTER (WHERE wt > 0) * 65536 // {SMALL.shard_size}"

SQL = {
    "term_counts": f"WITH {sql.TOK} SELECT page_id, term, cnt FROM tc",
    "doc_lengths": f"WITH {sql.TOK} SELECT * FROM dl",
    "posting_weights": f"WITH {sql.TOK} SELECT page_id, term, cnt, CAST(least(cnt * 2550 // n_terms, 255) AS INTEGER) AS wt FROM tc JOIN dl USING (page_id)",
    "doc_text_terms": f"WITH e AS (SELECT doc_id, unnest({sql.TEXT_TERMS}) AS term FROM documents) SELECT doc_id, term, count(*) AS cnt FROM e GROUP BY doc_id, term",
    "article_terms": f"""
        WITH n AS (SELECT page_id, list_transform({sql.NODES}, lambda x: len(regexp_extract_all(x, '[a-zA-Z]+'))) AS s FROM pages WHERE html IS NOT NULL)
        SELECT page_id, CAST(coalesce(list_sum(list_filter(s, lambda x: x > 30)), 0) AS BIGINT) AS n_article_terms,
               CAST(coalesce(list_sum(s), 0) AS BIGINT) AS n_terms FROM n""",
    "shard_assignment": f"WITH {_IX} SELECT * FROM d",
    "posting_lists": f"WITH {_IX} SELECT core, db, term, string_agg(doc_id || ':' || wt, ',' ORDER BY doc_id) AS postings FROM po GROUP BY core, db, term",
    "doc_frequency_idf": f"""
        WITH {_IX}, n AS (SELECT core, db, term, count(*) FILTER (WHERE wt > 0) AS df, {_NORM} AS norm FROM po GROUP BY core, db, term)
        SELECT core, db, term, df, CAST(pow(2, (CASE WHEN norm = 0 THEN 0 ELSE length(bin(norm)) END) // 2) AS BIGINT) AS idf FROM n""",
    "term_max_weight": f"WITH {_IX} SELECT core, db, term, max(wt) AS mx FROM po GROUP BY core, db, term",
    "shard_vocabulary": f"WITH {_IX} SELECT core, db, count(DISTINCT term) AS n_terms, count(*) AS n_postings FROM po GROUP BY core, db",
    "shard_keys": f"WITH {_IX} SELECT DISTINCT term FROM po",
    "shard_merge": f"WITH {_IX} SELECT (core * {DBS} + db) * {SMALL.index_cap} + doc_id AS doc_id, term, wt FROM po",
    "posting_runs": f"""
        WITH {_IX}, i AS (SELECT core, db, term, wt, doc_id, doc_id - row_number() OVER (PARTITION BY core, db, term, wt ORDER BY doc_id) AS g FROM po WHERE wt > 0)
        SELECT core, db, term, min(doc_id) AS first_doc, count(*) AS run_len, wt FROM i GROUP BY core, db, term, wt, g""",
    "posting_decoded": f"WITH {_IX} SELECT core, db, term, doc_id, wt FROM po WHERE wt > 0",
    "posting_segments_decoded": f"WITH {_IX} SELECT core, db, term, doc_id, wt FROM po WHERE wt > 0",
    "index_stored": f"""
        WITH {_IX}, a AS (SELECT core, db, count(*) AS n_docs, CAST(sum(n_terms) AS BIGINT) AS n_terms FROM d GROUP BY core, db)
        SELECT core, db, n_docs, n_terms, count(*) AS n_postings, CAST(sum(wt) AS BIGINT) AS wt FROM a JOIN po USING (core, db) GROUP BY ALL""",
    "posting_segments": f"""
        WITH {_IX},
             mx AS (SELECT core, db, term, max(doc_id) AS top FROM po GROUP BY core, db, term),
             dn AS (SELECT core, db, term, unnest(range(top + 1)) AS i FROM mx),
             dw AS (SELECT dn.*, coalesce(wt, 0) AS v, po.wt IS NOT NULL AS own, last_value(CASE WHEN po.wt IS NOT NULL THEN i END IGNORE NULLS) OVER w0 AS prev,
                           first_value(CASE WHEN po.wt IS NOT NULL THEN i END IGNORE NULLS) OVER w1 AS nxt
                    FROM dn LEFT JOIN po ON po.core = dn.core AND po.db = dn.db AND po.term = dn.term AND po.doc_id = dn.i
                    WINDOW w0 AS (PARTITION BY dn.core, dn.db, dn.term ORDER BY i ROWS UNBOUNDED PRECEDING), w1 AS (PARTITION BY dn.core, dn.db, dn.term ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
             gp AS (SELECT *, NOT own AND nxt - coalesce(prev, -1) - 1 >= {PROD.min_run_len} AS gap FROM dw),
             nr AS (SELECT *, CASE WHEN lag(v) OVER w = v AND lag(gap) OVER w = gap THEN 0 ELSE 1 END AS fresh FROM gp WINDOW w AS (PARTITION BY core, db, term ORDER BY i)),
             rn AS (SELECT *, sum(fresh) OVER (PARTITION BY core, db, term ORDER BY i) AS run FROM nr),
             rl AS (SELECT *, count(*) OVER (PARTITION BY core, db, term, run) >= {PROD.min_run_len} AS long FROM rn),
             sg AS (SELECT *, CASE WHEN NOT long AND NOT lag(long) OVER w THEN 0 WHEN long AND fresh = 0 THEN 0 ELSE 1 END AS ns FROM rl WINDOW w AS (PARTITION BY core, db, term ORDER BY i)),
             si AS (SELECT *, sum(ns) OVER (PARTITION BY core, db, term ORDER BY i) - 1 AS seg FROM sg)
        SELECT core, db, term, CAST(seg AS INTEGER) AS seg, min(i) AS first_doc, count(*) AS len, CASE WHEN bool_or(long) THEN max(v) END AS wt,
               CASE WHEN NOT bool_or(long) THEN string_agg(v, ',' ORDER BY i) END AS literal FROM si GROUP BY core, db, term, seg""",
    "scanned_count": f"""
        WITH {_IX}, s AS (SELECT core, db FROM po WHERE term IN ('this', 'posted') GROUP BY core, db HAVING count(DISTINCT term) = 2)
        SELECT CAST(1 AS BIGINT) AS query_id, count(*) AS n_shards, count(*) * {SMALL.shard_size} AS scanned FROM s HAVING count(*) > 0""",
    "search_recorded": f"""
        WITH raw AS (SELECT DISTINCT core, db, doc_id, term, cnt, wt FROM postings WHERE term IS NOT NULL),
             po AS (SELECT core, db, doc_id, trim(lower(term)) AS term, CAST(least(sum(wt), 255) AS INTEGER) AS wt FROM raw GROUP BY ALL),
             d AS (SELECT * FROM docs),
             {sql.search(PROD, "SELECT query_id, min(query_text) AS text FROM search_results WHERE query_text IS NOT NULL AND query_id IS NOT NULL GROUP BY query_id")} {_OUT}""",
    "search_recorded_all": f"""
        WITH raw AS (SELECT DISTINCT core, db, doc_id, term, cnt, wt FROM postings WHERE term IS NOT NULL),
             po AS (SELECT core, db, doc_id, trim(lower(term)) AS term, CAST(least(sum(wt), 255) AS INTEGER) AS wt FROM raw GROUP BY ALL),
             d AS (SELECT * REPLACE (coalesce(log2_terms, CAST(length(bin(n_terms)) - 1 AS INTEGER)) AS log2_terms) FROM docs),
             {sql.search(PROD, "SELECT query_id, min(query_text) AS text FROM search_results WHERE query_text IS NOT NULL AND query_id IS NOT NULL GROUP BY query_id")} {_OUT}""",
    "query_words": """
        WITH t AS (SELECT DISTINCT query_text, list_filter(regexp_split_to_array(lower(query_text), '\\s+'), lambda x: x <> '') AS w FROM search_results WHERE query_text IS NOT NULL)
        SELECT query_text, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS term FROM t""",
}
SQL |= {k: f"WITH {sql.index(ONE)}, {sql.search(ONE, f"SELECT CAST(1 AS BIGINT) AS query_id, '{w}' AS text")} {_OUT}" for k, w in SEARCHES.items()}
SQL["search_stored"] = SQL["search_multi_shard"] = f"WITH {_IX}, {sql.search(SMALL, "SELECT CAST(1 AS BIGINT) AS query_id, 'is that this' AS text")} {_OUT}"
