"""Streams equal their batch forms."""

import pandas as pd

from quarryline.config import PROD
from quarryline.operators.index import build_index
from quarryline.streaming.frontier import run_pops, stream_pops, stream_priorities
from quarryline.streaming.index import stream_index

OPS = [
    (0, 1, "inc", "a", 1), (0, 2, "inc", "b", 2), (0, 3, "inc", "c", 2), (0, 4, "pop", None, None),
    (0, 5, "inc", "c", 9), (0, 6, "pop", None, None), (0, 7, "pop", None, None), (0, 8, "pop", None, None),
    (1, 1, "pop", None, None), (1, 2, "inc", "z", 1), (1, 3, "pop", None, None),
]


def test_priorities_by_single_files(spark, tmp_path):
    src = tmp_path / "pages"
    src.mkdir()
    for i in range(4):
        pd.DataFrame({"page_id": [i, i + 10], "url": ["http://a.example/", None], "html": ["<body>" + "word " * 200 + f"</body><a href='/x'><a href='/{i}'>", None]}).to_parquet(src / f"{i}.parquet")
    want = {"http://a.example/x": 4} | {f"http://a.example/{i}": 1 for i in range(4)}
    assert {r.url: r.priority for r in stream_priorities(spark, str(src), max_files=1).collect()} == want
    out = str(tmp_path / "out")
    for _ in range(2):  # a second call finds no new pages
        assert {r.url: r.priority for r in stream_priorities(spark, str(src), out=out).collect()} == want


def test_pops(spark, tmp_path):
    """Popped urls never come out again, though their counts still rise; ties give the greatest url."""
    src = tmp_path / "ops"
    schema = "queue int, seq long, op string, url string, amount long"
    spark.createDataFrame(OPS, schema).coalesce(1).write.parquet(str(src))
    out = stream_pops(spark.readStream.schema(schema).parquet(str(src)))
    q = out.writeStream.format("memory").queryName("pops").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("pops").collect())
    assert got == [(0, 4, "c", 2), (0, 6, "b", 2), (0, 7, "a", 1), (1, 3, "z", 1)]


def test_pops_over_batches(spark, tmp_path):
    """State carries over micro-batches: a url popped in one never comes out in a later one."""
    src = tmp_path / "ops"
    schema = "queue int, seq long, op string, url string, amount long"
    for i in range(3):
        part = [(q, n, *rest) for q, n, *rest in OPS if n % 3 == i]
        spark.createDataFrame([(q, n + 100 * i, *rest) for q, n, *rest in part], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = stream_pops(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
    q = stream.writeStream.format("memory").queryName("many").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.queue, r.url) for r in spark.table("many").collect()]
    assert len(got) == len(set(got)) and {u for _, u in got} <= {"a", "b", "c", "z"}


def test_run_pops(spark):
    ops = spark.createDataFrame(OPS, "queue int, seq long, op string, url string, amount long")
    assert sorted(tuple(r) for r in run_pops(ops).collect()) == [(0, 4, "c", 2), (0, 6, "b", 2), (0, 7, "a", 1), (1, 3, "z", 1)]


def test_index_fills_shards_over_batches(spark, tmp_path):
    """Shards are cut after so many documents whichever micro-batches they come in; the short last one is there."""
    src = tmp_path / "pages"
    src.mkdir()
    for i in range(4):
        ids = [5 * i + j for j in range(5)]
        pd.DataFrame({"page_id": ids, "url": [f"u{n}" for n in ids], "html": ["<body>" + f"word{'abcde'[n % 5]} " * 200 + "</body>" for n in ids]}).to_parquet(src / f"{i}.parquet")
    cfg = PROD.__class__(index_cap=6, n_cores=2)
    docs, postings = stream_index(spark, str(src), cfg, max_files=1)
    got = sorted((r.core, r.db, r.doc_id) for r in docs.collect())
    assert got == sorted((c, n // 6, n % 6) for c in range(2) for n in range(10))
    whole, lists = build_index(spark.read.parquet(str(src)), cfg)
    assert sorted(r.page_id for r in docs.collect()) == sorted(r.page_id for r in whole.collect())
    assert postings.count() == lists.count() == 20 and postings.select("core", "db", "doc_id").distinct().count() == 20
