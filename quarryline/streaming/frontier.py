"""The frontier as a stream (R01-R04, S09): priorities from arriving pages, and pops with state."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .. import schemas
from ..operators.frontier import priorities
from ..operators.links import page_links
from ..session import shared_path


def stream_priorities(spark: SparkSession, path: str, max_files: int | None = None, out: str | None = None) -> DataFrame:
    """(url, priority) after all pages under ``path`` have been read as a stream.

    Each micro-batch turns its pages into links and writes their sums under
    its own number, so a repeated batch replaces itself; priorities are the
    sums over batches. ``out`` is a shared folder for the sums and the stream's
    state, and a later call with it goes on with new pages; without it the
    stream starts anew and its folder is removed when the process ends.
    """
    reader = spark.readStream.schema(schemas.PAGES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)  # R05
    out = out or shared_path(spark, "frontier")

    def write(pages: DataFrame, number: int) -> None:
        priorities(page_links(pages)).write.mode("overwrite").parquet(f"{out}/sums/batch={number}")

    query = reader.parquet(path).writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    sums = spark.read.schema("url string, priority long, batch int").parquet(f"{out}/sums")
    return sums.groupBy("url").agg(F.sum("priority").alias("priority"))


class Pops(StatefulProcessor):
    """Increments and pops of one queue.

    An increment after a pop still counts, but the url never comes out again.
    Of equal priorities the greatest url is popped. A batch reads the queue's
    state once, keeps the waiting urls in a heap, and writes back what changed.
    """

    def init(self, handle) -> None:
        self.urls = handle.getMapState("urls", "url string", "cnt long, popped boolean")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        ops = pd.concat(list(rows)).sort_values("seq", kind="stable")
        state = {k[0]: (int(v[0]), bool(v[1])) for k, v in self.urls.iterator()} if (ops.op == "pop").any() else {}
        known = bool(state)
        heap = [(-cnt, _Last(url)) for url, (cnt, popped) in state.items() if not popped]
        heapq.heapify(heap)
        out, changed = [], {}
        for op, url, amount, seq in zip(ops.op, ops.url, ops.amount, ops.seq):
            if op == "inc":
                if not known and url not in state and self.urls.containsKey((url,)):
                    cnt, popped = self.urls.getValue((url,))
                    state[url] = int(cnt), bool(popped)
                cnt, popped = state.get(url, (0, False))
                state[url] = changed[url] = cnt + int(amount), popped
                if not popped:
                    heapq.heappush(heap, (-state[url][0], _Last(url)))
                continue
            while heap:
                cnt, url = -heap[0][0], heapq.heappop(heap)[1].url
                if state[url] == (cnt, False):  # else an older entry of a url that has risen or gone
                    state[url] = changed[url] = cnt, True
                    out.append((key[0], int(seq), url, cnt))
                    break
        for url, v in changed.items():
            self.urls.updateValue((url,), v)
        yield pd.DataFrame(out, columns=["queue", "seq", "url", "priority"])

    def close(self) -> None:
        pass


class _Last:
    """A url in descending order."""

    def __init__(self, url: str):
        self.url = url

    def __lt__(self, other: _Last) -> bool:
        return self.url > other.url


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
POPPED = "queue int, seq long, url string, priority long"


def stream_pops(ops: DataFrame) -> DataFrame:
    """(queue, seq, url, priority) of a stream of operations (queue, seq, op, url, amount), op is inc or pop.

    Needs the RocksDB state store provider. State lies by queue; use many queues.
    """
    return ops.groupBy("queue").transformWithStateInPandas(Pops(), outputStructType=POPPED, outputMode="Append", timeMode="None")


def run_pops(ops: DataFrame) -> DataFrame:
    """(queue, seq, url, priority): a table of operations replayed as a stream, to its end.

    The operations are written to the shared folder and read from there; what
    each micro-batch popped is written beside them.
    """
    spark = ops.sparkSession
    src, out = shared_path(spark, "ops"), shared_path(spark, "pops")
    ops.select("queue", "seq", "op", "url", "amount").write.parquet(src)
    provider = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = stream_pops(spark.readStream.schema("queue int, seq long, op string, url string, amount long").parquet(src))
    try:
        query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, provider)
    return spark.read.schema(POPPED).parquet(f"{out}/rows")
