"""The index as a stream (R04, W01, W02): arriving pages fill shard after shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import PROD, Config
from ..operators.index import build_index
from ..session import shared_path


def stream_index(spark: SparkSession, path: str, cfg: Config = PROD, max_files: int | None = None, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs, postings) after all pages under ``path`` have been read as a stream.

    A core numbers its documents on from micro-batch to micro-batch, so a shard
    is full after ``index_cap`` documents whichever batches they came in, and
    what is in the last, short one is there, too. A batch is written under its
    own number and numbers on from the batches before it, so a repeated one
    replaces itself. ``out`` is a shared folder that a later call goes on in;
    without it the index starts anew and goes with the process.
    """
    reader = spark.readStream.schema(schemas.PAGES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)  # R05
    out = out or shared_path(spark, "stream-index")
    stored = lambda part, schema: spark.read.schema(f"{schema}, batch int").parquet(f"{out}/{part}")
    docs_schema, postings_schema = (", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.fields) for s in (schemas.DOCS, schemas.POSTINGS))

    def write(pages: DataFrame, number: int) -> None:
        before = stored("docs", docs_schema).where(F.col("batch") < number).groupBy("core").agg(F.count(F.lit(1)).alias("n")) if number else None
        docs, postings = build_index(pages, cfg, before=before)
        docs.write.mode("overwrite").parquet(f"{out}/docs/batch={number}")
        postings.write.mode("overwrite").parquet(f"{out}/postings/batch={number}")

    query = reader.parquet(path).writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stored("docs", docs_schema).drop("batch"), stored("postings", postings_schema).drop("batch")
