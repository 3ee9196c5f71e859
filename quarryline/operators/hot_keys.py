"""Per-key results when a handful of keys hold most rows.

Every input split encodes its keys in a dictionary of its own and adds its rows
into dense arrays (``numpy.bincount`` and scatter-reduce), so a split costs the
same whichever keys it holds. The arrays leave a split cut into a fixed number
of blocks by the key's hash; one entry of a block then stands for all rows a
split had of a key. Blocks are placed evenly on the tasks of a distributed
reduction, which sums one block after the other, so that a key that holds a
third of all rows weighs no more than a rare one and a task's memory is one
block's keys, however many keys there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import width

BLOCKS = 1 << 12
_LOW, _HIGH = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class DenseAccumulator:
    """A growing dictionary of keys and one dense int64 array per statistic.

    Statistics: ``rows`` and, for each measure, its non-null values' ``n``,
    ``sum``, ``min`` and ``max``.
    """

    def __init__(self, n_measures: int):
        self.codes: dict[str, int] = {}
        self.identity = [0] + [0, 0, _LOW, _HIGH] * n_measures
        self.stats = [np.full(64, x, np.int64) for x in self.identity]

    def code(self, keys: list[str]) -> np.ndarray:
        """Dense codes of ``keys``; new keys get the next ones."""
        codes = self.codes
        out = np.fromiter((codes.setdefault(k, len(codes)) for k in keys), np.int64, len(keys))
        if len(codes) > len(self.stats[0]):
            more = 2 * len(codes) - len(self.stats[0])
            self.stats = [np.concatenate([s, np.full(more, x, np.int64)]) for s, x in zip(self.stats, self.identity)]
        return out

    def add_rows(self, keys: pa.Array, measures: list[pa.Array]) -> None:
        """Adds raw rows; ``keys`` has no nulls."""
        encoded = keys.dictionary_encode()
        local, code = encoded.indices.to_numpy(zero_copy_only=False), self.code(encoded.dictionary.to_pylist())
        self.stats[0][code] += np.bincount(local, minlength=len(code))
        for i, m in enumerate(measures):
            there = m.is_valid().to_numpy(zero_copy_only=False)
            at, v = code[local[there]], m.drop_null().to_numpy(zero_copy_only=False)
            n, total, low, high = self.stats[1 + 4 * i : 5 + 4 * i]
            n[code] += np.bincount(local[there], minlength=len(code))
            np.add.at(total, at, v)
            np.minimum.at(low, at, v)
            np.maximum.at(high, at, v)

    def add_block(self, keys: list[str], stats: list[np.ndarray]) -> None:
        """Adds blocks of other accumulators; a key may come once from each."""
        at = self.code(keys)
        for i, (mine, other) in enumerate(zip(self.stats, stats)):
            f = np.add if i == 0 or i % 4 in (1, 2) else np.minimum if i % 4 == 3 else np.maximum
            f.at(mine, at, other)

    def take(self) -> tuple[list[str], list[np.ndarray]]:
        keys = list(self.codes)
        return keys, [s[: len(keys)] for s in self.stats]


def _names(measures: list[str]) -> list[str]:
    return ["rows", *(f"{m}_{x}" for m in measures for x in ("n", "sum", "min", "max"))]


def dense_reduce(df: DataFrame, key: str, measures: list[str] | None = None, tasks: int | None = None, max_keys: int = 1 << 18) -> DataFrame:
    """One row per non-null ``key``: ``rows`` and ``<measure>_n/_sum/_min/_max``.

    ``key``: a string column; ``measures``: integer columns. A split hands on
    its arrays whenever its dictionary reaches ``max_keys``, which bounds its
    memory. Keys fall into ``BLOCKS`` blocks; the reduction has ``tasks`` tasks
    (default: the session's shuffle width), each with every ``tasks``-th block.

    Defined cases: rows with a null key belong to no key and are left out; null
    measures count in ``rows`` only, and a key without any value has n 0, sum 0
    and null min and max; an empty string is a key like any other; an empty
    table gives no rows; columns besides these are not read. Sums are 64-bit.
    """
    measures = measures or []
    tasks = tasks or width(df.sparkSession)
    names = _names(measures)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = DenseAccumulator(len(measures))

        def flush() -> Iterator[pa.RecordBatch]:
            keys, stats = acc.take()
            if not keys:
                return
            import xxhash

            block = np.fromiter((xxhash.xxh64_intdigest(k) % BLOCKS for k in keys), np.int32, len(keys))
            order = np.argsort(block, kind="stable")
            there, first = np.unique(block[order], return_index=True)
            offsets = pa.array(np.append(first, len(keys)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(keys, pa.string()).take(pa.array(order)))]
            lists += [pa.ListArray.from_arrays(offsets, pa.array(s[order])) for s in stats]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *lists], ["block", "keys", *names])

        for b in batches:
            acc.add_rows(b.column(0), [b.column(i + 1) for i in range(len(measures))])
            if len(acc.codes) >= max_keys:
                yield from flush()
                acc = DenseAccumulator(len(measures))
        yield from flush()

    def summed(acc: DenseAccumulator) -> Iterator[pa.RecordBatch]:
        keys, stats = acc.take()
        for at in range(0, len(keys), 10_000):
            part = [s[at : at + 10_000] for s in stats]
            out = [pa.array(keys[at : at + 10_000], pa.string())]
            for i, s in enumerate(part):
                empty = part[i - (i - 1) % 4] == 0 if i and i % 4 in (3, 0) else None
                out.append(pa.array(s, mask=empty))
            yield pa.RecordBatch.from_arrays(out, ["key", *names])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, now = DenseAccumulator(len(measures)), None
        for b in batches:
            block = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(block)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(block)]):
                if a == z:
                    continue
                if now is not None and block[a] != now:
                    yield from summed(acc)
                    acc = DenseAccumulator(len(measures))
                now = block[a]
                lists = [b.column(i + 1).slice(a, z - a).flatten() for i in range(1 + len(names))]
                acc.add_block(lists[0].to_pylist(), [x.to_numpy() for x in lists[1:]])
        yield from summed(acc)

    longs = T.ArrayType(T.LongType())
    block_schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("keys", T.ArrayType(T.StringType())), *(T.StructField(n, longs) for n in names)])
    out_schema = T.StructType([T.StructField("key", T.StringType()), *(T.StructField(n, T.LongType()) for n in names)])
    rows = df.where(F.col(key).isNotNull()).select(F.col(key), *(F.col(m).cast("long") for m in measures))
    parts = rows.mapInArrow(split, block_schema).repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block")
    return parts.mapInArrow(merge, out_schema).withColumnRenamed("key", key)
