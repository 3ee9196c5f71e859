"""Ranked conjunctive search over shards.

Any number of queries is answered in one plan: query terms select postings, a
small table of (query, shard, term) figures gives every term its divisor, one
aggregation scores documents, and only the best k of a query fetch their url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PROD, Config

SHARD = ["core", "db"]


def query_terms(text: Column) -> Column:
    """The lower-case words of a query, order and repeats kept (P16); never tokenised."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def bit_length(n: Column) -> Column:
    return F.when(n <= 0, 0).otherwise(F.length(F.bin(n)))


def log2_ceil(n: Column) -> Column:
    """The exponent of the next power of two (P20)."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def two_to(n: Column) -> Column:
    return F.pow(F.lit(2.0), n).cast("long")


def idf(df: Column, scale: int) -> Column:
    """The divisor of a term that ``df`` of ``scale`` documents hold."""
    return two_to(F.floor(bit_length(F.floor(df * 65536 / scale)) / 2))


def term_figures(postings: DataFrame, scale: int) -> DataFrame:
    """(core, db, term, df, mx, idf) (A04, A05, P19). Postings of weight 0 don't count."""
    some = postings.groupBy(*SHARD, "term").agg(F.count_if(F.col("wt") > 0).alias("df"), F.max("wt").alias("mx"))
    return some.withColumn("idf", idf(F.col("df"), scale))


def queries_table(spark: SparkSession, texts: dict[int, str]) -> DataFrame:
    """(query_id, term, mult, n_terms) of given queries, which came from the driver and so may be broadcast."""
    rows = spark.createDataFrame(list(texts.items()), "query_id long, text string")
    return F.broadcast(split_queries(rows))


def split_queries(rows: DataFrame) -> DataFrame:
    """(query_id, term, mult, n_terms) of (query_id, text); empty queries have no rows."""
    words = rows.select("query_id", F.explode(query_terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("mult"))
    return words.withColumn("n_terms", F.count(F.lit(1)).over(Window.partitionBy("query_id")))


def _hits(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Postings of query terms.

    Queries given by the driver carry a broadcast hint, so a usual term's
    postings stay where they are. A table of queries is joined by what
    adaptive execution finds: broadcast if it is small, otherwise shuffled,
    with the postings of a usual term split over several tasks.
    """
    return postings.join(queries, "term")


def matches(postings: DataFrame, queries: DataFrame, cfg: Config = PROD) -> DataFrame:
    """(query_id, core, db, doc_id, score) of documents that hold all terms with weight left."""
    hits = _hits(postings, queries)
    per_query = Window.partitionBy("query_id", *SHARD)
    figures = hits.groupBy("query_id", *SHARD, "term", "mult", "n_terms").agg(F.count_if(F.col("wt") > 0).alias("df"), F.max("wt").alias("mx"))
    figures = figures.withColumn("idf", idf(F.col("df"), cfg.shard_size))
    figures = figures.withColumns({"there": F.count(F.lit(1)).over(per_query), "ridf": F.expr("idf div (min(idf) over (partition by query_id, core, db))")})
    figures = figures.where(F.col("there") == F.col("n_terms"))
    total = F.sum(F.col("mult") * F.expr("mx div ridf")).over(per_query)
    figures = figures.withColumn("denominator", F.floor(total / 255) + 1)
    figures = figures.withColumn("divisor", two_to(log2_ceil(F.col("ridf") * F.col("denominator"))))
    shifted = hits.join(figures.select("query_id", *SHARD, "term", "divisor"), ["query_id", *SHARD, "term"]).withColumn("w", F.expr("wt div divisor"))
    scored = shifted.where(F.col("w") > 0).groupBy("query_id", *SHARD, "doc_id", "n_terms").agg(F.sum(F.col("mult") * F.col("w")).alias("score"), F.count(F.lit(1)).alias("nz"))
    return scored.where(F.col("nz") == F.col("n_terms")).select("query_id", *SHARD, "doc_id", "score")


def search(postings: DataFrame, docs: DataFrame, queries: DataFrame, cfg: Config = PROD) -> DataFrame:
    """(query_id, pos, url, score, log2_terms, core, db, doc_id): each query's best documents.

    Ties go to the smaller core, db, doc_id. Documents of fewer than 2^8 terms
    are no results. An empty query, or one with a term that no document
    holds, has no rows.
    """
    long = docs.where(F.col("log2_terms") >= cfg.min_log2_terms).select(*SHARD, "doc_id", "log2_terms")
    found = matches(postings, queries, cfg).join(long, [*SHARD, "doc_id"])
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *SHARD, "doc_id")
    best = found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= cfg.top_k)
    urls = docs.select(*SHARD, "doc_id", "url")  # only for the best (J03)
    return best.join(urls, [*SHARD, "doc_id"]).select("query_id", "pos", "url", "score", "log2_terms", *SHARD, "doc_id")


def scanned(postings: DataFrame, queries: DataFrame, cfg: Config = PROD) -> DataFrame:
    """(query_id, n_shards, scanned): shards with all terms, and their nominal documents."""
    there = _hits(postings, queries).groupBy("query_id", "n_terms", *SHARD).agg(F.count_distinct("term").alias("n"))
    return there.where(F.col("n") == F.col("n_terms")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_shards"), (F.count(F.lit(1)) * cfg.shard_size).alias("scanned"))
