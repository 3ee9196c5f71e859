"""The index cache's postings in one clean form, shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import read_table

RECORD = ["core", "db", "doc_id"]
_ALL = [*RECORD, "term", "cnt", "wt"]


def normal_term(c: Column | str) -> Column:
    """Lower case, without surrounding blanks."""
    return F.trim(F.lower(c))


def distinct_postings(postings: DataFrame) -> DataFrame:
    """Rows with a term, rows equal in all six columns once, the term normalised.

    Other columns of the table are not read. A document's term may still be
    spread over several rows.
    """
    rows = postings.select(*_ALL).where(F.col("term").isNotNull()).distinct()
    return rows.withColumn("term", normal_term("term"))


def clean_postings(postings: DataFrame) -> DataFrame:
    """``distinct_postings`` with ``cnt`` summed per document and term.

    A null ``cnt`` adds nothing. Null parts of a document's key are values.
    """
    rows = distinct_postings(postings).groupBy(*RECORD, "term").agg(F.sum("cnt").alias("cnt"))
    return rows.withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def read_clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_postings(read_table(spark, sf, "postings"))


#: The same in SQL, as the common table expression ``clean``.
CLEAN_SQL = """
    clean AS (SELECT core, db, doc_id, trim(lower(term)) AS term, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS cnt
              FROM (SELECT DISTINCT core, db, doc_id, term, cnt, wt FROM postings WHERE term IS NOT NULL)
              GROUP BY core, db, doc_id, trim(lower(term)))"""
