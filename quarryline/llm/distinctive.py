"""How distinctive a term is of a record: log-entropy weights from two aggregations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import cut
from ..sources import read_table
from .clean import CLEAN_SQL, RECORD, clean_postings

HOT_ROWS = 100_000
_ROUNDING = 1e-6


def term_spread(postings: DataFrame) -> DataFrame:
    """(term, total, records, entropy in bits) of clean postings.

    With p = cnt / total over the term's records, the entropy is
    -sum(p log p) = log(total) - sum(cnt log cnt) / total. Counts of 0 or less
    have no share in it but count as records.
    """
    some = F.when(F.col("cnt") > 0, F.col("cnt"))
    sums = postings.groupBy("term").agg(F.coalesce(F.sum(some), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("records"), F.sum(some * F.log2(some)).alias("s"))
    entropy = F.when(F.col("total") > 0, F.log2("total") - F.col("s") / F.col("total")).otherwise(0.0)
    return sums.select("term", "total", "records", F.greatest(entropy, F.lit(0.0)).alias("entropy"))


def scores(rows: DataFrame, spread: DataFrame, n_records: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` (with term and cnt) with the figures of ``term_spread`` and score.

    score = log2(1 + cnt) * (1 - entropy / log2(n_records)): 0 for a term spread
    evenly over all records, log2(1 + cnt) for one that a single record holds.
    Terms of more than ``hot_rows`` rows and more than a thousandth of all get
    their figures by a broadcast of at most a thousand rows. ``rows`` is read
    several times: hand over a stored table.
    """
    rest = 1.0 - F.col("entropy") / F.log2(F.lit(n_records)) if n_records > 1 else F.lit(1.0)
    score = F.log2(1.0 + F.greatest("cnt", F.lit(0))) * F.greatest(rest, F.lit(0.0))
    return lookup_join(rows, spread, "term", hot_rows).withColumn("score", score)


def log_entropy(postings: DataFrame, n_records: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``postings`` (RECORD, term, cnt) with records, entropy and score.

    Defined cases: clean postings have no null term; the empty term is a term;
    a null record part is a value; with one record or none the score is the
    local part alone; counts of 0 or less score 0; an empty table gives no
    rows; other columns are not read.
    """
    postings = postings.select(*RECORD, "term", "cnt")
    return scores(postings, term_spread(postings), n_records, hot_rows)


def candidates(scored: DataFrame, n_records: int, most: int) -> DataFrame:
    """Rows of ``log_entropy`` whose score a term of at most ``most`` records can have.

    Such a term's entropy is at most log2(most), so its score is at least
    log2(1 + cnt) * (1 - log2(most) / log2(n_records)). Every such row comes
    out; others of uneven terms may, too.
    """
    least = max(0.0, 1.0 - math.log2(most) / math.log2(n_records)) if n_records > 1 else 1.0
    return scored.where(F.col("score") >= F.log2(1.0 + F.greatest("cnt", F.lit(0))) * least - _ROUNDING)


def _postings(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    return cut(clean_postings(read_table(spark, sf, "postings"))), read_table(spark, sf, "docs").count()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that make up at least 4 % of a document and that few documents hold: by a bound on the score, then exactly.

    Terms' figures are over all postings; rows below 4 % are left out before
    scores are joined to the others.
    """
    postings, n = _postings(spark, sf)
    docs = read_table(spark, sf, "docs").select(*(F.col(c).alias(f"d_{c}") for c in RECORD), "n_terms")
    same = [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in RECORD]
    rows = cut(postings.join(docs, same).where(F.col("cnt") * 100 >= F.col("n_terms") * 4).select(*RECORD, "term", "cnt"))
    few = (F.col("records") <= 3) | (F.col("records") * 100 <= n)
    return candidates(scores(rows, term_spread(postings), n), n, max(3, n // 100)).where(few).select(*RECORD, "term")


def p4_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every clean posting's score against the whole index."""
    return log_entropy(*_postings(spark, sf)).select(*RECORD, "term", "cnt", F.round("score", 4).alias("score"))


QUERIES = {"p4_found": p4_found, "p4_scores": p4_scores}

SQL = {
    "p4_found": f"""
        WITH {CLEAN_SQL},
             s AS (SELECT term, count(*) AS records FROM clean GROUP BY term)
        SELECT core, db, doc_id, term FROM clean JOIN s USING (term) JOIN docs USING (core, db, doc_id)
        WHERE cnt * 100 >= n_terms * 4 AND (records <= 3 OR records * 100 <= (SELECT count(*) FROM docs))""",
    "p4_scores": f"""
        WITH {CLEAN_SQL},
             s AS (SELECT term, sum(cnt) AS total, sum(cnt * log2(cnt)) AS s FROM clean GROUP BY term)
        SELECT core, db, doc_id, term, cnt,
               round(log2(1.0 + cnt) * greatest(1.0 - greatest(log2(total) - s / total, 0.0) / log2((SELECT count(*) FROM docs)), 0.0), 4) AS score
        FROM clean JOIN s USING (term)""",
}
