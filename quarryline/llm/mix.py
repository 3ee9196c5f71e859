"""Mixing sources to target weights by pivotal dependent rounding.

A source that needs f copies of each document gets floor(f) for certain and the
rest as a probability. Pivotal rounding pairs two documents and moves token
mass from one to the other, in a random direction that keeps both
expectations, until one of them is 0 or 1; the source's tokens stay the same
all along. Each leaf of documents leaves few undecided ones a source, and a
tree over the leaves decides those, so a source misses its tokens by less
than one document. Leaves are a fixed number of groups by the document's hash
and draws are hashes of the paired documents, so a seed gives the same mix on
any cluster and for any layout of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import cut, spread, width
from ..sources import read_table
from .encode import VOCABULARY, encode_texts
from .ribbon import mix

LEAVES = 4096
FAN_IN = 64
CHUNK = 4096
HOT_ROWS = 100_000
SEED = 42
_STATE = "source string, doc_id long, tokens long, p double"
_EPS = 1e-12


def draws(i: np.ndarray, j: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each pair of ids."""
    h = mix(mix(i.astype(np.int64).view(np.uint64), salt) ^ j.astype(np.int64).view(np.uint64), salt + 1)
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def pivot(tokens: np.ndarray, p: np.ndarray, ids: np.ndarray, segment: np.ndarray, salt: int) -> np.ndarray:
    """Rounds probabilities to 0 or 1 but for at most one in each segment; sum(tokens * p) of a segment stays.

    Rows of a segment are neighbours. Rounds of disjoint pairs of neighbouring
    undecided rows, all segments at once; a pair leaves at most one undecided.
    """
    p = np.where(p <= _EPS, 0.0, np.where(p >= 1 - _EPS, 1.0, p))
    open_ = np.flatnonzero((p > 0) & (p < 1))
    while len(open_) > 1:
        seg, n = segment[open_], np.arange(len(open_))
        new = np.append(True, seg[1:] != seg[:-1])
        first = (n - np.maximum.accumulate(np.where(new, n, 0))) % 2 == 0
        first &= np.append(~new[1:], False)  # its neighbour is of the same segment
        if not first.any():
            break
        at = np.flatnonzero(first)
        i, j = open_[at], open_[at + 1]
        wi, wj = tokens[i].astype(float), tokens[j].astype(float)
        up_i, up_j = np.minimum((1 - p[i]) * wi, p[j] * wj), np.minimum(p[i] * wi, (1 - p[j]) * wj)
        to_i = draws(ids[i], ids[j], salt) * (up_i + up_j) < up_j
        full = np.where(to_i, (1 - p[i]) * wi <= p[j] * wj, p[i] * wi <= (1 - p[j]) * wj)  # i is the one decided
        moved = np.where(to_i, up_i, -up_j)
        pi, pj = p[i] + moved / wi, p[j] - moved / wj
        p[i] = np.where(full, to_i.astype(float), pi)
        p[j] = np.where(full, pj, (~to_i).astype(float))
        both = np.concatenate([i, j])
        p[both] = np.where(p[both] <= _EPS, 0.0, np.where(p[both] >= 1 - _EPS, 1.0, p[both]))
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    return p


def _rounding(last: bool, salt: int):
    """Partition function over (leaf, _STATE) sorted by (leaf, source, doc_id).

    Rows of one leaf and source are a run; a run's every ``CHUNK`` rows from
    its first one are rounded by themselves, wherever Arrow's batches end. At
    the ``last`` level a run is one segment, and its one undecided document is
    decided by its own probability.
    """

    def settle(source: pa.Array, ids: np.ndarray, tokens: np.ndarray, p: np.ndarray, segment: np.ndarray) -> pa.RecordBatch:
        q = pivot(tokens, p, ids, segment, salt)
        if last:
            open_ = np.flatnonzero((q > 0) & (q < 1))
            q[open_] = (draws(ids[open_], ids[open_], salt + 2) < q[open_]).astype(float)
        return pa.RecordBatch.from_arrays([source, pa.array(ids), pa.array(tokens), pa.array(q)], ["source", "doc_id", "tokens", "p"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the rows of a segment that may go on
        run, seen = None, 0  # that segment's run, and how many of the run's rows were settled before it
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            table = table.combine_chunks()
            leaf = table.column(0).to_numpy()
            source = table.column(1).combine_chunks().dictionary_encode().indices.to_numpy()
            n = np.arange(len(leaf))
            new = np.append(True, (leaf[1:] != leaf[:-1]) | (source[1:] != source[:-1]))
            starts = np.maximum.accumulate(np.where(new, n, 0))
            place = n - starts
            key = (int(leaf[0]), table.column(1)[0].as_py())
            if key == run:
                place[starts == 0] += seen
            segment = np.cumsum(new | ((place % CHUNK == 0) & ~last))
            z = int(np.searchsorted(segment, segment[-1]))  # all but the last segment are whole
            if z:
                yield settle(table.column(1).combine_chunks().slice(0, z), *(table.column(i).to_numpy()[:z] for i in (2, 3, 4)), segment[:z])
            run, seen = (int(leaf[z]), table.column(1)[z].as_py()), int(place[z])
            held = table.slice(z)
        if held is not None:
            yield settle(held.column(1).combine_chunks(), *(held.column(i).to_numpy() for i in (2, 3, 4)), np.zeros(held.num_rows, np.int64))

    return work


def round_copies(state: DataFrame, seed: int = SEED) -> DataFrame:
    """``state`` (source, doc_id, tokens, p) with every p rounded to 0 or 1.

    Leaves are by document, so no source makes one of them large. Level by
    level the undecided documents, about one a source and leaf, go to a 64th
    of the leaves; those of the root, a few a source, are spread by source.
    """
    out, level, leaves, rows = [], 0, LEAVES, state
    while True:
        last = leaves == 1
        leaf = F.floor(F.pmod(F.xxhash64("doc_id"), F.lit(LEAVES)) / FAN_IN**level).cast("int")
        spread = rows.select(leaf.alias("leaf"), "source", "doc_id", "tokens", "p").repartition(width(state.sparkSession), *(["source"] if last else ["leaf"]))
        done = cut(spread.sortWithinPartitions("leaf", "source", "doc_id").mapInArrow(_rounding(last, seed + 3 * level), _STATE))
        out.append(done.where("p = 0 or p = 1"))
        if last:
            break
        rows, level, leaves = done.where("p > 0 and p < 1"), level + 1, leaves // FAN_IN
    both = out[0]
    for d in out[1:]:
        both = both.unionByName(d)
    return both


def _positive(c: str) -> Column:
    return F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def plan_copies(targets: DataFrame, sizes: DataFrame, total: int | None) -> DataFrame:
    """(source, whole, part): copies of each document of a source, its part of ``total`` over its tokens, at most max_repeats, as whole copies and the rest."""
    have = targets.select("source", "target_share", "max_repeats").where("source is not null").join(sizes.groupBy("source").agg(F.sum("tokens").alias("have")), "source")
    have = cut(have.where("have > 0"))
    total = have.agg(F.coalesce(F.sum("have"), F.lit(0))).first()[0] if total is None else total
    f = F.least(_positive("target_share") * total / F.col("have"), _positive("max_repeats"))
    return have.withColumn("f", f).select("source", F.floor("f").alias("whole"), (F.col("f") - F.floor("f")).alias("part"))


def mix_sources(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents that enter the mix.

    ``sizes``: (doc_id, source, tokens), read more than once; ``targets``:
    (source, target_share, max_repeats), any number of sources. ``total``: the
    mix's size in tokens; by default all tokens of the targets' sources. A
    source whose documents, each repeated max_repeats times, don't reach its
    part gives all of that; what it lacks isn't made up by others, so the
    others stand to one another as their targets do.

    Defined cases: documents without tokens, of a null source or of a source
    without target don't enter; a null share or repeat limit is 0; ids and
    target sources are unique; an empty table gives no rows. The same seed
    gives the same mix, however the table is laid out and whatever the cluster.
    """
    rows = sizes.select("source", "doc_id", "tokens").where(F.col("tokens") > 0)
    state = lookup_join(rows, plan_copies(targets, sizes, total), "source", hot_rows)
    undecided = state.where(F.col("part") > _EPS).select("source", "doc_id", (F.col("tokens")).alias("tokens"), F.col("part").alias("p"))
    extra = round_copies(undecided, seed).where("p = 1").select("doc_id", "source", "tokens", F.lit(1).cast("long").alias("copies"))
    certain = state.where("whole > 0").select("doc_id", "source", "tokens", F.col("whole").cast("long").alias("copies"))
    return certain.unionByName(extra).groupBy("doc_id", "source", "tokens").agg(F.sum("copies").alias("copies"))


def mix_report(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: what the source has, what it gives, and its share of the mix.

    ``enough`` tells whether its documents and repeats suffice for its part of
    the planned total, ``reached`` whether its share of the mix comes to the
    target but for less than its largest document; where others lack, it is
    above. A source without documents has share 0.
    """
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("available"), F.max("tokens").alias("largest"))
    gave = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.max("copies").alias("most_copies"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = targets.select("source", "target_share", "max_repeats").join(have, "source", "left").join(gave, "source", "left")
    rows = rows.select("source", "target_share", "max_repeats", zero("docs"), zero("available"), zero("mixed"), zero("most_copies"), zero("largest"))
    whole, planned = rows.agg(F.sum("mixed")).scalar(), rows.agg(F.sum("available")).scalar()
    share = lambda of: F.coalesce(F.try_divide(F.col("mixed").cast("double"), of), F.lit(0.0))
    out = rows.withColumns({"share": share(whole), "share_of_plan": share(planned), "enough": F.col("available") * F.col("max_repeats") >= F.col("target_share") * planned})
    return out.withColumn("reached", F.coalesce(F.col("mixed") + F.greatest("largest", F.lit(1)) > F.col("target_share") * whole, F.lit(False))).drop("largest")


def _inputs(spark: SparkSession, sf: str, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    targets = read_table(spark, sf, "mix_targets")
    documents = spread(read_table(spark, sf, "documents").select("doc_id", "source", "text"))
    wanted = documents.join(targets.select("source"), "source", "left_semi")
    return cut(encode_texts(wanted, vocabulary=vocabulary, keep=["doc_id", "source"], ids=False, deal=False).withColumnRenamed("n_tokens", "tokens")), targets


def p9_copies(spark: SparkSession, sf: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents of the mix with their tokens and copies."""
    sizes, targets = _inputs(spark, sf, vocabulary)
    return mix_sources(sizes, targets)


def p9_shares(spark: SparkSession, sf: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The shares reached, for every target."""
    sizes, targets = _inputs(spark, sf, vocabulary)
    return mix_report(cut(mix_sources(sizes, targets)), sizes, targets)


QUERIES = {"p9_copies": p9_copies, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
