"""Run-length views of postings and their decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PROD

LIST = ["core", "db", "term"]


def posting_runs(postings: DataFrame) -> DataFrame:
    """(core, db, term, first_doc, run_len, wt): neighbouring documents of equal weight; 0 is absent.

    A list is at most a shard long, which bounds the window.
    """
    w = Window.partitionBy(*LIST, "wt").orderBy("doc_id")
    rows = postings.where(F.col("wt") > 0).withColumn("island", F.col("doc_id") - F.row_number().over(w))
    runs = rows.groupBy(*LIST, "wt", "island").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("run_len"))
    return runs.select(*LIST, "first_doc", "run_len", "wt")


def decode_runs(runs: DataFrame) -> DataFrame:
    """(core, db, term, doc_id, wt): the postings of runs."""
    docs = F.sequence("first_doc", F.col("first_doc") + F.col("run_len") - 1)
    return runs.select(*LIST, F.explode(docs).alias("doc_id"), "wt")


def encode_segments(postings: DataFrame, min_run_len: int = PROD.min_run_len) -> DataFrame:
    """(core, db, term, seg, first_doc, len, wt, literal): a list as the run codec stores it.

    A list is dense from document 0 to its last posting, absent documents being
    0. ``min_run_len`` or more equal weights in a row are a run (``wt``, null
    ``literal``); what lies between runs is one segment of single weights
    (``literal``, null ``wt``). A gap of that length is a run of its own, even
    beside stored weights of 0. Windows span one list, at most a shard.
    """
    rows = postings.groupBy(*LIST, "doc_id").agg(F.max("wt").alias("wt"))
    by_doc = Window.partitionBy(*LIST).orderBy("doc_id")
    gap = F.col("doc_id") - F.coalesce(F.lag("doc_id").over(by_doc), F.lit(-1)) - 1
    item = lambda at, n, wt, alone: F.struct(at.alias("at"), n.cast("long").alias("n"), wt.cast("int").alias("v"), alone.alias("alone"))
    zeros = item(F.col("doc_id") - F.col("gap"), F.col("gap"), F.lit(0), F.col("gap") >= min_run_len)
    own = item(F.col("doc_id"), F.lit(1), F.col("wt"), F.lit(False))
    items = rows.withColumn("gap", gap).select(*LIST, F.inline(F.when(F.col("gap") > 0, F.array(zeros, own)).otherwise(F.array(own))))
    by_at = Window.partitionBy(*LIST).orderBy("at")
    fresh = F.col("alone") | F.coalesce(F.lag("alone").over(by_at), F.lit(True))
    new_run = fresh | (F.lag("v").over(by_at) != F.col("v"))
    items = items.withColumns({"fresh": fresh.cast("int"), "new": new_run.cast("int")})
    items = items.withColumns({"chunk": F.sum("fresh").over(by_at), "run": F.sum("new").over(by_at)})
    runs = items.groupBy(*LIST, "chunk", "run", "v").agg(F.min("at").alias("at"), F.sum("n").alias("n"))
    by_run = Window.partitionBy(*LIST).orderBy("run")
    runs = runs.withColumn("long", F.col("n") >= min_run_len)
    new_seg = F.col("long") | F.coalesce(F.lag("long").over(by_run), F.lit(True)) | (F.lag("chunk").over(by_run) != F.col("chunk"))
    runs = runs.withColumn("seg", F.sum(new_seg.cast("int")).over(by_run) - 1)
    parts = F.sort_array(F.collect_list(F.when(~F.col("long"), F.struct("at", "n", "v"))))
    segs = runs.groupBy(*LIST, "seg").agg(F.min("at").alias("first_doc"), F.sum("n").alias("len"), F.max(F.when(F.col("long"), F.col("v"))).alias("wt"), parts.alias("p"))
    literal = F.when(F.col("wt").isNull(), F.flatten(F.transform("p", lambda p: F.array_repeat(p["v"], p["n"].cast("int")))))
    return segs.select(*LIST, F.col("seg").cast("int").alias("seg"), "first_doc", "len", "wt", literal.alias("literal"))


def decode_segments(segments: DataFrame) -> DataFrame:
    """(core, db, term, doc_id, wt): the postings with weight of encoded lists."""
    weights = F.coalesce("literal", F.array_repeat("wt", F.col("len").cast("int")))
    some = segments.where(F.coalesce("wt", F.lit(-1)) != 0)
    each = some.select(*LIST, "first_doc", F.posexplode(weights).alias("at", "wt"))
    return each.where(F.col("wt") > 0).select(*LIST, (F.col("first_doc") + F.col("at")).alias("doc_id"), "wt")
