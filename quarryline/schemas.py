"""Schemas of stored index tables; readers never infer."""

from pyspark.sql import types as T

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("n_terms", T.LongType()), T.StructField("log2_terms", T.IntegerType()), T.StructField("core", T.IntegerType()), T.StructField("db", T.IntegerType())]
)
POSTINGS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("term", T.StringType()), T.StructField("cnt", T.LongType()), T.StructField("wt", T.IntegerType()), T.StructField("core", T.IntegerType()), T.StructField("db", T.IntegerType())]
)
