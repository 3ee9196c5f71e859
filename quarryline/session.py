"""What operators need from the session: shuffle width and a shared place for cut lineages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def width(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages: the cluster's ``spark.checkpoint.dir``.

    Only where neither that setting nor a folder of the context exists (tests
    on one machine) a temporary one is made, which goes with the process.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="quarryline-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the process ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(remove_written)
    _written.append((spark, path))
    return path


def remove_written() -> None:
    """Removes what ``cut`` and others left under the shared folder; frames that read it end with it."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner clears it
            return


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if its files make fewer splits than there are cores.

    For costly work on a row of its own; large inputs have more splits and
    are left alone. ``df`` should be a scan: partitions are counted, and a
    frame with a shuffle would be computed for that.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder as a table.

    The copy outlives lost executors; later stages start from it and read only
    the columns they use.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
