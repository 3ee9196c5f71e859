"""The sharded inverted index: ids, sinks, scans, introspection, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import PROD, Config
from ..session import cut
from .text import log2_floor, page_terms, weight

_ID_BLOCK = 1 << 16


def running_number(df: DataFrame, by: str, order: str, into: str) -> DataFrame:
    """0, 1, 2, ... within ``by`` in the order of the unique integer ``order``.

    Numbers are dealt in blocks of the order's range: a block's rows are
    numbered for themselves and get the rows before the block added, so a task
    never holds more than one block.
    """
    df = df.withColumn("__block", F.floor(F.col(order) / _ID_BLOCK))
    blocks = df.groupBy(by, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = blocks.withColumn("__before", F.sum("__n").over(Window.partitionBy(by).orderBy("__block")) - F.col("__n")).drop("__n")
    rank = F.row_number().over(Window.partitionBy(by, "__block").orderBy(order)) - 1
    out = df.withColumn("__rank", rank).join(before, [by, "__block"])
    return out.withColumn(into, (F.col("__rank") + F.col("__before")).cast("long")).drop("__block", "__rank", "__before")


def assign_shards(docs: DataFrame, cfg: Config = PROD, before: DataFrame | None = None) -> DataFrame:
    """``docs`` with core, db and doc_id (W01, W02); the last shard may be short and is kept.

    ``before``: (core, n), documents that cores hold already and number on from.
    """
    rows = docs.withColumn("core", F.pmod("page_id", F.lit(cfg.n_cores)).cast("int"))
    rows = running_number(rows, "core", "page_id", "__seq")
    if before is not None:
        rows = rows.join(F.broadcast(before.select("core", F.col("n").alias("__n"))), "core", "left")  # a row a core
        rows = rows.withColumn("__seq", F.col("__seq") + F.coalesce("__n", F.lit(0))).drop("__n")
    return rows.withColumns({"db": F.floor(F.col("__seq") / cfg.index_cap).cast("int"), "doc_id": F.pmod("__seq", F.lit(cfg.index_cap)).cast("long")}).drop("__seq")


def build_index(pages: DataFrame, cfg: Config = PROD, only_terms: list[str] | None = None, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs, postings) of ``pages``; ``before`` as in ``assign_shards``.

    docs: core, db, doc_id, page_id, url, n_terms, log2_terms. postings: core,
    db, doc_id, term, cnt, wt. With ``only_terms`` the postings of these terms
    alone are built, cut down before anything is stored or shuffled.

    Pages are tokenised once: the long ones' terms and the documents' ids are
    written to the shared checkpoint folder, and all further steps start there.
    """
    terms = F.col("terms") if only_terms is None else F.filter("terms", lambda t: t.isin(only_terms))
    n = F.size("terms").cast("long")
    long = cut(page_terms(pages).where(n >= cfg.min_n_tokens).select("page_id", "url", n.alias("n_terms"), terms.alias("terms")))
    docs = cut(assign_shards(long.select("page_id", "url", "n_terms", log2_floor(F.col("n_terms")).alias("log2_terms")), cfg, before))
    counted = long.select("page_id", "n_terms", F.explode("terms").alias("term")).groupBy("page_id", "n_terms", "term").agg(F.count(F.lit(1)).alias("cnt"))
    postings = counted.join(docs.select("page_id", "core", "db", "doc_id"), "page_id")
    return docs, postings.select("core", "db", "doc_id", "term", "cnt", weight(F.col("cnt"), F.col("n_terms")).alias("wt"))


def index_folder(cfg: Config) -> str:
    """Where an index lies under the configured root."""
    return f"{cfg.root}/index"


def write_index(docs: DataFrame, postings: DataFrame, path: str) -> None:
    """One folder a shard (S05); postings lie in the order of terms, so a term's scan skips row groups."""
    shard = ["core", "db"]
    docs.repartition(*shard).sortWithinPartitions(*shard, "doc_id").write.mode("overwrite").partitionBy(*shard).parquet(f"{path}/docs")
    postings.repartitionByRange(*shard, "term", "doc_id").sortWithinPartitions(*shard, "term", "doc_id").write.mode("overwrite").partitionBy(*shard).parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Shards are found as partitions."""
    return spark.read.schema(schemas.DOCS).parquet(f"{path}/docs"), spark.read.schema(schemas.POSTINGS).parquet(f"{path}/postings")


def posting_lists(postings: DataFrame) -> DataFrame:
    """(core, db, term, postings): a shard's list of (doc_id, wt), at most ``index_cap`` long."""
    return postings.groupBy("core", "db", "term").agg(F.sort_array(F.collect_list(F.struct("doc_id", "wt"))).alias("postings"))


def shard_vocabulary(postings: DataFrame) -> DataFrame:
    """Terms and postings of each shard."""
    return postings.groupBy("core", "db", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("core", "db").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("n_postings"))


def shard_ordinal(core: Column, db: Column, shards_per_core: int) -> Column:
    return core.cast("long") * shards_per_core + db


def merge_shards(postings: DataFrame, docs: DataFrame, shards_per_core: int, cfg: Config = PROD) -> tuple[DataFrame, DataFrame]:
    """All shards as one: doc_id becomes ordinal * shard size + doc_id.

    Cores are ``shards_per_core`` ordinals apart, or as many as the core with
    the most shards needs, so ids never run together. Absent postings stay
    absent instead of becoming zeros, and a shard's documents are taken once.
    """
    most = docs.agg(F.max("db")).first()[0]
    apart = max(shards_per_core, 0 if most is None else most + 1)
    big = shard_ordinal(F.col("core"), F.col("db"), apart) * cfg.index_cap + F.col("doc_id")
    return postings.select(big.alias("doc_id"), "term", "wt"), docs.select(big.alias("doc_id"), "url", "log2_terms")
