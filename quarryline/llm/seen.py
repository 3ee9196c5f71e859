"""Has this key been seen before? Generations of sealed ribbon filters.

Keys arrive in the order of an id. Rows of arrivals are cut into generations by
id, earlier keys into generations by hash, and all keys into shards by hash (a
partition is a shard). A shard goes through its generations in order: the keys
of a generation are probed in the filters of all earlier ones, then sealed into
a filter of their own and dropped. So a shard holds one open batch and about
two bytes a key, whether keys come from the arrivals or from the history.
Within a generation repeats are known exactly, as the open batch is still
there. A filter has no false negatives; its positives are looked up exactly.

Texts never move: a key travels as 128 bits of hash, which a filter sees 64 of,
and keys are equal if all 128 are. Among 10^12 keys two different ones agree
with a chance of about 10^-15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, width
from ..sources import read_table
from .ribbon import seal

GENERATIONS = 16
OLD_GENERATIONS = 8
SHARD_KEYS = 1 << 20
BITS = 12
AUDITS = 2_000
_MERGE_ROWS = 1 << 18
_KEYS = "gen int, h long, h2 long, id long"
_VERDICTS = "gen int, h long, h2 long, id long, hit boolean, audits long, audit_hits long"
_NO_ID = -1


def _first_of_each(gen: np.ndarray, h: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the smallest id of each (gen, h, h2), in that order."""
    order = np.lexsort((ids, h2, h, gen))
    g, a, b = gen[order], h[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[new]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partition function over _KEYS: equal keys of a generation become one row, before anything moves."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def close() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        cols = [t.column(i).to_numpy() for i in range(4)]
        at = _first_of_each(*cols)
        return pa.RecordBatch.from_arrays([pa.array(c[at]) for c in cols], ["gen", "h", "h2", "id"])

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= _MERGE_ROWS:
            yield close()
            held, rows = [], 0
    if held:
        yield close()


def _walk(bits: int, audits: int):
    """Partition function over _KEYS sorted by gen: verdicts and, with ``audits``, one audit row a sealed batch."""

    def close(gen: int, cols: list[np.ndarray], filters: list, made: list) -> Iterator[pa.RecordBatch]:
        at = _first_of_each(np.zeros(len(cols[0]), np.int32), *cols)
        h, h2, ids = (c[at] for c in cols)
        keys = h.view(np.uint64)
        hit = np.zeros(len(keys), bool)
        if gen >= 0:
            for f in filters:
                left = np.flatnonzero(~hit)
                hit[left[f.contains(keys[left])]] = True
        for a in range(0, len(keys), 50_000):
            z = min(len(keys), a + 50_000)
            none = pa.nulls(z - a, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(z - a, gen, np.int32)), pa.array(h[a:z]), pa.array(h2[a:z]), pa.array(ids[a:z]), pa.array(hit[a:z]), none, none], _NAMES)
        sealed = seal(keys, bits)
        filters.append(sealed)
        if audits:
            # absent keys in all filters that this batch was probed in; a batch's own keys are no longer absent after it
            absent, matched = made
            if gen >= 0:
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([gen], pa.int32()), none, none, none, pa.nulls(1, pa.bool_()), pa.array([len(absent)]), pa.array([int(matched.sum())])], _NAMES)
            still = ~np.isin(absent, keys)
            made[:] = absent[still], matched[still] | sealed.contains(absent[still])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: list = []
        made = [np.array([xxhash.xxh64_intdigest(f"absent key {i}", 42) for i in range(audits)], np.uint64), np.zeros(audits, bool)]
        gen, held = None, []
        for b in batches:
            g = b.column(0).to_numpy()
            cols = [b.column(i).to_numpy() for i in (1, 2, 3)]
            cuts = np.flatnonzero(np.diff(g)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(g)]):
                if a == z:
                    continue
                if gen is not None and g[a] != gen:
                    yield from close(gen, [np.concatenate(c) for c in zip(*held)], filters, made)
                    held = []
                gen = int(g[a])
                held.append([c[a:z] for c in cols])
        if held:
            yield from close(gen, [np.concatenate(c) for c in zip(*held)], filters, made)

    return walk


_NAMES = ["gen", "h", "h2", "id", "hit", "audits", "audit_hits"]


def generation(id_: Column, low: int, high: int, generations: int = GENERATIONS) -> Column:
    """The generation of an id between ``low`` and ``high``."""
    return F.floor((id_ - low) / max(1, (high - low) // generations + 1)).cast("int")


def probe_generations(arrivals: DataFrame, history: DataFrame, n_keys: int, bits: int = BITS, audits: int = 0) -> DataFrame:
    """Verdicts (gen, h, h2, id, hit): each key once in each generation, with its smallest id.

    ``arrivals``: (gen, id, key), ``history``: (key), which gets the generations
    below 0, id -1 and no hits. ``n_keys``: rows of both, which the number of
    shards follows. Equal keys are merged before they move, so a key of a third
    of all rows is one row a task and generation. With ``audits``, rows with a
    null id tell for each batch how many certainly absent keys were probed in
    all filters that the batch was probed in, and how many matched any.
    """
    h, h2 = F.xxhash64("key"), F.xxhash64(F.lit(1), "key")
    new = arrivals.select("gen", h.alias("h"), h2.alias("h2"), F.col("id").cast("long").alias("id"))
    old = history.where(F.col("key").isNotNull()).select(h.alias("h"), h2.alias("h2"))
    old = old.select((-1 - F.pmod("h2", F.lit(OLD_GENERATIONS))).cast("int").alias("gen"), "h", "h2", F.lit(_NO_ID).cast("long").alias("id"))
    shards = max(width(arrivals.sparkSession), n_keys // SHARD_KEYS + 1)
    rows = new.unionByName(old).mapInArrow(_merge, _KEYS)
    return rows.repartition(shards, "h").sortWithinPartitions("gen").mapInArrow(_walk(bits, audits), _VERDICTS)


def _refuted(verdicts: DataFrame) -> DataFrame:
    """Ids of positives whose key is nevertheless the first of its kind.

    Only keys with a positive are looked up.
    """
    hits = verdicts.where("hit").select("h", "h2").distinct()
    near = verdicts.select("h", "h2", "gen", "id", "hit").join(hits, ["h", "h2"], "left_semi")
    first = near.groupBy("h", "h2").agg(F.min_by(F.struct("gen", "id", "hit"), "gen").alias("f"))
    return first.where("f.gen >= 0 and f.hit").select("f.id")


def _prepare(jobs: DataFrame, history: DataFrame, id_col: str, key_col: str) -> tuple[DataFrame, int]:
    arrivals = jobs.select(F.col(id_col).alias("id"), F.col(key_col).alias("key")).where(F.col("key").isNotNull() & F.col("id").isNotNull())
    low, high, n = arrivals.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    low, high = low or 0, high or 0
    return arrivals.withColumn("gen", generation(F.col("id"), low, high)), n + history.count()


def seen_before(jobs: DataFrame, history: DataFrame, id_col: str, key_col: str, bits: int = BITS) -> DataFrame:
    """Ids of the rows whose key occurs in ``history`` or in a row of smaller id.

    ``history``: one column ``key``, repeats and nulls allowed. ``id_col`` is
    unique and rises in order of arrival.

    Defined cases: rows with a null id or key are never reported; the empty
    string is a key; rows of equal key are reported but for the first; empty
    tables give no rows; further columns are not read.
    """
    arrivals, n = _prepare(jobs, history, id_col, key_col)
    verdicts = cut(probe_generations(arrivals, history, n, bits))
    new = verdicts.where("gen >= 0 and not hit").select("id").unionByName(_refuted(verdicts))
    return arrivals.select("id").join(new, "id", "left_anti").withColumnRenamed("id", id_col)


def seen_report(jobs: DataFrame, history: DataFrame, id_col: str, key_col: str, bits: int = BITS) -> DataFrame:
    """For each generation and, with a null ``gen``, for all rows: rows, keys probed, positives, wrong answers and their rate, and the audit's rate.

    ``wrong`` counts positives that the exact lookup refutes. Each is one row's
    answer: a key's further rows in a generation are told exactly, and
    negatives are never wrong. ``wrong_rate`` is their share of the rows,
    ``audit_rate`` the share of certainly absent keys that matched any of the
    filters that the generation's keys are probed in. The history's generations
    have no rows to answer and are not listed.
    """
    arrivals, n = _prepare(jobs, history, id_col, key_col)
    verdicts = cut(probe_generations(arrivals, history, n, bits, AUDITS))
    bad = _refuted(verdicts).withColumn("wrong", F.lit(1))
    answers = verdicts.where("gen >= 0").join(bad, "id", "left")
    each = answers.groupBy("gen").agg(
        F.count("id").alias("keys"), F.count_if(F.coalesce("hit", F.lit(False))).alias("positives"), F.count("wrong").alias("wrong"), F.sum("audits").alias("audits"), F.sum("audit_hits").alias("audit_hits")
    )
    each = cut(each.join(arrivals.groupBy("gen").agg(F.count(F.lit(1)).alias("rows")), "gen", "left").withColumn("rows", F.coalesce("rows", F.lit(0))))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in each.columns if c != "gen"]
    both = each.unionByName(each.agg(F.lit(None).cast("int").alias("gen"), *sums))
    return both.select("gen", "rows", "keys", "positives", "wrong", F.try_divide("wrong", "rows").alias("wrong_rate"), "audits", F.try_divide("audit_hits", "audits").alias("audit_rate"))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda t: read_table(spark, sf, t).select(F.col("url").alias("key"))
    return one("root_set").unionByName(one("seen_urls"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs whose url is already known when they arrive."""
    return seen_before(read_table(spark, sf, "jobs"), _history(spark, sf), "job_id", "url")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """The rate of wrong answers over rows of jobs, by generation and in total."""
    return seen_report(read_table(spark, sf, "jobs"), _history(spark, sf), "job_id", "url")


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

SQL = {
    "p1_found": """
        WITH old AS (SELECT url FROM root_set UNION SELECT url FROM seen_urls),
             f AS (SELECT url, min(job_id) AS first_id FROM jobs WHERE url IS NOT NULL GROUP BY url)
        SELECT job_id FROM jobs JOIN f USING (url)
        WHERE job_id > first_id OR url IN (SELECT url FROM old WHERE url IS NOT NULL)""",
}
