"""Which worker gets a host's jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PROD, Config


def assign_workers(hosts: DataFrame, recent: DataFrame, loads: DataFrame, cfg: Config = PROD) -> DataFrame:
    """(host, tid, kind): for each host the smallest worker that served it lately and has space.

    Where none has, the smallest idle worker takes it (``idle``); where none is
    idle, the job waits (``stashed``, null tid). ``recent``: (host, tid),
    ``loads``: (tid, waiting); a worker without load is idle. One row a host;
    null hosts have none.
    """
    load = loads.groupBy("tid").agg(F.sum("waiting").alias("waiting"))
    served = recent.where("host is not null and tid is not null").select("host", "tid").distinct()
    room = served.join(load, "tid", "left").where(F.coalesce("waiting", F.lit(0)) < cfg.work_queue_cap)
    local = room.groupBy("host").agg(F.min("tid").alias("local"))
    workers = served.select("tid").union(load.select("tid")).where("tid is not null").distinct()
    idle = workers.join(load, "tid", "left").where(F.coalesce("waiting", F.lit(0)) < cfg.work_empty_threshold).agg(F.min("tid").alias("idle"))
    rows = hosts.select("host").where("host is not null").distinct().join(local, "host", "left").withColumn("idle", idle.scalar())
    kind = F.when(F.col("local").isNotNull(), "local").when(F.col("idle").isNotNull(), "idle").otherwise("stashed")
    return rows.select("host", F.coalesce("local", "idle").alias("tid"), kind.alias("kind"))
