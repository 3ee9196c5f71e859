"""Duplicates hidden by formatting differences.

Byte-identical texts are collapsed first, with counts; only distinct survivors
are brought to canonical form, and these are grouped again on the full
canonical text. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import cut
from ..sources import read_table

HOT_ROWS = 100_000


def runs(c: Column) -> Column:
    """The runs of ASCII letters and digits, in lower case, one blank between them."""
    return F.lower(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")))


def _bag(fields: Column) -> Column:
    """Fields in any order, as often as they occur; those without letter or digit left out."""
    return F.array_join(F.array_sort(F.filter(F.transform(fields, runs), lambda f: f != "")), "&")


def canonical_url(c: Column) -> Column:
    """What precedes the first ``?``, then the query's fields in order."""
    tail = F.regexp_extract(c, r"(?s)\?(.*)", 1)
    return F.concat_ws("?", runs(F.substring_index(c, "?", 1)), _bag(F.split(tail, "&")))


def canonical_record(c: Column) -> Column:
    """The fields of a line, parted by ``|``, ``;`` or tab, in order."""
    return _bag(F.split(c, r"[|;\t]"))


def hidden_duplicates(df: DataFrame, id_col: str, text: str, canonical, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Groups (keep_id, copies) of texts with one canonical form, and members (keep_id, copy_id).

    ``canonical``: Column -> Column. ``keep_id`` is a group's smallest id;
    ``copies`` counts its rows. Members hold every other row of a group of two
    or more. Copies of a byte-identical text find their group through a join
    in which texts of more than ``hot_rows`` rows are broadcast one row each.

    Defined cases: null and empty texts belong to no group; texts without any
    letter or digit agree with one another; ids are unique; an empty table gives no rows; other
    columns are not read. Whole texts are compared, never hashes alone.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("raw")).where(F.length("raw") > 0)
    survivors = rows.groupBy("raw").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    survivors = cut(survivors.withColumn("form", canonical(F.col("raw"))))
    groups = survivors.groupBy("form").agg(F.min("first").alias("keep_id"), F.sum("n").alias("copies")).where("copies > 1")
    # of a byte-identical text all rows have one group: survivors learn it, then their copies
    named = lookup_join(survivors.select("form", "raw", "first", "n"), groups.select("form", "keep_id"), "form", hot_rows)
    alone = named.where("n = 1").select("keep_id", F.col("first").alias("copy_id"))
    many = named.where("n > 1").select("raw", "keep_id")
    spread = lookup_join(rows, many, "raw", hot_rows).select("keep_id", F.col("id").alias("copy_id"))
    members = alone.unionByName(spread).where("copy_id <> keep_id")
    return groups.select("keep_id", "copies"), members


def _both(spark: SparkSession, sf: str, part: int) -> DataFrame:
    docs = hidden_duplicates(read_table(spark, sf, "docs"), "page_id", "url", canonical_url)[part]
    recs = hidden_duplicates(read_table(spark, sf, "raw_jobs"), "rec_id", "rec", canonical_record)[part]
    return docs.withColumn("tbl", F.lit("docs")).unionByName(recs.withColumn("tbl", F.lit("raw_jobs")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every copy with the row that stands for its group."""
    return _both(spark, sf, 1).select("tbl", "keep_id", "copy_id")


def p7_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each group of two or more, with its number of copies."""
    return _both(spark, sf, 0).select("tbl", "keep_id", "copies")


QUERIES = {"p7_found": p7_found, "p7_groups": p7_groups}

_RUNS = "lower(trim(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')))"
_BAG = "array_to_string(list_sort(list_filter(list_transform({}, lambda f: " + _RUNS.format("f") + "), lambda f: f <> '')), '&')"
_FORMS = f"""
    forms AS (SELECT 'docs' AS tbl, page_id AS id, {_RUNS.format("split_part(url, '?', 1)")} || '?' ||
                     {_BAG.format("string_split(CASE WHEN contains(url, '?') THEN substr(url, instr(url, '?') + 1) ELSE '' END, '&')")} AS form
              FROM docs WHERE length(url) > 0
              UNION ALL
              SELECT 'raw_jobs', rec_id, {_BAG.format("regexp_split_to_array(rec, '[|;\\t]')")} FROM raw_jobs WHERE length(rec) > 0),
    g AS (SELECT *, min(id) OVER (PARTITION BY tbl, form) AS keep_id, count(*) OVER (PARTITION BY tbl, form) AS copies FROM forms)"""

SQL = {
    "p7_found": f"WITH {_FORMS} SELECT tbl, keep_id, id AS copy_id FROM g WHERE id <> keep_id",
    "p7_groups": f"WITH {_FORMS} SELECT tbl, keep_id, copies FROM g WHERE id = keep_id AND copies > 1",
}
