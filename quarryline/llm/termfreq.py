"""Frequency of every distinct term or n-gram, by suffix arrays with common-prefix intervals.

A block of whole records is one sequence of coded tokens. Its suffixes, sorted
by their first ``max_n`` tokens, make every n-gram an interval of suffixes
that share n tokens; the interval's weight is the n-gram's occurrences. Two
neighbouring suffixes of one record inside an interval are a duplicate within
that record, so the interval's records are its suffixes less those duplicate
adjacencies. Intervals of different blocks are summed by n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, width
from ..sources import read_table
from .clean import RECORD, distinct_postings

RARE_BELOW = 3
COMMON_OVER = 5
MAX_WORDS = 3  # of an n-gram of documents
_COUNTS = "gram array<string>, occurrences long, records long"


def suffix_intervals(tokens: np.ndarray, record: np.ndarray, weight: np.ndarray, sequence: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: an example position of every distinct n-gram, its weight and its records.

    ``tokens``: codes in order; n-grams don't cross from one ``sequence`` to
    another. A record may have several sequences; an n-gram weighs as its
    first token.
    """
    n_tokens = len(tokens)
    columns = [tokens]
    for k in range(1, max_n):
        nxt = np.full(n_tokens, -1, np.int64)
        same = sequence[k:] == sequence[: n_tokens - k]
        nxt[: n_tokens - k] = np.where(same, tokens[k:], -1)
        columns.append(nxt)
    suffixes = np.lexsort((record, *reversed(columns)))
    shared = np.zeros(n_tokens, np.int64)  # tokens that a suffix shares with the one before it
    alike = np.ones(max(n_tokens - 1, 0), bool)
    for c in columns:
        s = c[suffixes]
        alike &= (s[1:] == s[:-1]) & (s[1:] >= 0)
        shared[1:] += alike
    # a suffix and the one of the same record before it in sorted order share some tokens
    by_record = np.argsort(record[suffixes], kind="stable")
    rec = record[suffixes][by_record]
    prev, at = by_record[:-1][rec[1:] == rec[:-1]], by_record[1:][rec[1:] == rec[:-1]]
    repeated = np.zeros(n_tokens, np.int64)
    alike = np.ones(len(at), bool)
    for c in columns:
        s = c[suffixes]
        alike &= (s[at] == s[prev]) & (s[at] >= 0)
        repeated[at] += alike
    for n in range(1, max_n + 1):
        full = columns[n - 1][suffixes] >= 0
        begins = np.flatnonzero(full & (shared < n))
        if not len(begins):
            continue
        # suffixes too short for n lie outside the intervals and weigh nothing
        yield n, suffixes[begins], np.add.reduceat(weight[suffixes] * full, begins), np.add.reduceat((full & (repeated < n)).astype(np.int64), begins)


def _emit(values: pa.Array, tokens: np.ndarray, record: np.ndarray, weight: np.ndarray, sequence: np.ndarray, max_n: int) -> Iterator[pa.RecordBatch]:
    if not len(tokens):
        return
    for n, example, occurrences, records in suffix_intervals(tokens, record, weight, sequence, max_n):
        for a in range(0, len(example), 20_000):
            e = example[a : a + 20_000]
            grams = values.take(pa.array((tokens[e[:, None] + np.arange(n)]).ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(e) + 1, n, dtype=np.int32)), grams.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(occurrences[a : a + 20_000]), pa.array(records[a : a + 20_000])], ["gram", "occurrences", "records"])


def _sum(parts: DataFrame) -> DataFrame:
    return parts.groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def ngram_counts(df: DataFrame, tokens: str, max_n: int = 3, block_tokens: int = 1 << 20) -> DataFrame:
    """(gram, occurrences, records) of every n-gram up to ``max_n``; a row of ``df`` is a record.

    ``tokens``: a column array<string>. Blocks close at a row's end once they
    hold ``block_tokens``; a longer record is a block of its own.

    Defined cases: null and empty arrays hold no n-gram; null tokens are no
    token, and n-grams don't reach over them; repeated rows are records of
    their own; an empty table gives no rows; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        n = 0

        def close() -> Iterator[pa.RecordBatch]:
            lists = pa.chunked_array(held).combine_chunks()
            flat = lists.flatten()
            record = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()) if not lists.null_count else lists.value_lengths().fill_null(0).to_numpy())
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            sequence = record * (len(flat) + 1) + np.cumsum(~there)
            code = flat.drop_null().dictionary_encode()
            yield from _emit(code.dictionary, code.indices.to_numpy().astype(np.int64), record[there], np.ones(there.sum(), np.int64), sequence[there], max_n)

        for b in batches:
            size = b.column(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            a = 0
            for z in range(len(size)):
                n += int(size[z])
                if n >= block_tokens:
                    held.append(b.column(0).slice(a, z + 1 - a))
                    yield from close()
                    held, n, a = [], 0, z + 1
            if a < len(size):
                held.append(b.column(0).slice(a))
        if held:
            yield from close()

    return _sum(df.select(F.col(tokens).cast("array<string>")).mapInArrow(work, _COUNTS))


def _codes(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """One number for each row, equal for rows equal in all columns; null is a value."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        code = c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.unique(out * (code.max(initial=0) + 1) + code, return_inverse=True)[1]
    return out


def term_counts(df: DataFrame, record: list[str], term: str, weight: str, block_rows: int = 1 << 18) -> DataFrame:
    """(term, occurrences, records) of rows that each hold one weighted term of a record.

    A record's rows may lie anywhere and repeat a term. Rows are spread by a
    hash of record and term, so equal pairs meet in one partition while a term
    or a record of a third of all rows is spread over all; a block is so many
    rows of a partition, and its suffix array is that of sequences of one
    token. A pair that a block's end cuts in two is a duplicate adjacency over
    the edge and taken off there, so blocks are bounded however often a pair
    is repeated.

    Defined cases: null terms are left out; a null weight adds no occurrence
    but the row holds the term; null record parts are values; the empty term is
    a term; an empty table gives no rows; other columns are not read.
    """
    parts = [f"r{i}" for i in range(len(record))]
    rows = df.where(F.col(term).isNotNull()).select(F.col(term).alias("t"), F.coalesce(F.col(weight), F.lit(0)).cast("long").alias("w"), *(F.col(c).alias(p) for c, p in zip(record, parts)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal last
            table = pa.Table.from_batches(held)
            pair = lambda i: [table.column(j)[i].as_py() for j in (0, *range(2, 2 + len(parts)))]
            if pair(0) == last:
                yield pa.RecordBatch.from_arrays([pa.array([[last[0]]], pa.list_(pa.string())), pa.array([0]), pa.array([-1])], ["gram", "occurrences", "records"])
            last = pair(table.num_rows - 1)
            t = table.column(0).combine_chunks().dictionary_encode()
            record = _codes([table.column(2 + i) for i in range(len(parts))])
            yield from _emit(t.dictionary, t.indices.to_numpy().astype(np.int64), record, table.column(1).to_numpy(), np.arange(table.num_rows), 1)

        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= block_rows:
                yield from close()
                held, n = [], 0
        if n:
            yield from close()

    spread = rows.repartition(width(df.sparkSession), "t", *parts).sortWithinPartitions(*reversed(parts), "t")
    each = spread.mapInArrow(work, _COUNTS).select(F.col("gram")[0].alias("term"), "occurrences", "records")
    return each.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, n_records: DataFrame, rare_below: int = RARE_BELOW, common_over: int = COMMON_OVER) -> DataFrame:
    """``counts`` with ``mark``: rare below ``rare_below`` records, common above 1/``common_over`` of all, else null.

    ``n_records``: one row, one column. In collections so small that a term is
    both, it is rare.
    """
    n = n_records.scalar()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_over > n, "common")
    return counts.withColumn("mark", mark)


def p2_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every term of the index cache: occurrences, documents, mark."""
    counts = term_counts(distinct_postings(read_table(spark, sf, "postings")), RECORD, "term", "cnt")
    return marked(counts, read_table(spark, sf, "docs").agg(F.count(F.lit(1))))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that are too rare or too common."""
    return p2_terms(spark, sf).where(F.col("mark").isNotNull()).select("term", "mark")


def p2_query_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """N-grams of up to three words of the recorded query texts, with the rows that hold them."""
    words = F.filter(F.split(F.lower(F.trim("query_text")), r"\s+"), lambda w: w != "")
    counts = ngram_counts(read_table(spark, sf, "search_results").select(words.alias("words")), "words", 3)
    return counts.select(F.array_join("gram", " ").alias("gram"), F.size("gram").alias("n"), "occurrences", "records")


def p2_document_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """N-grams of up to MAX_WORDS words of whole documents, with the documents that hold them; words are what ASCII white space separates, as written."""
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    counts = ngram_counts(spread(read_table(spark, sf, "documents")).select(words.alias("words")), "words", MAX_WORDS)
    return counts.select(F.array_join("gram", " ").alias("gram"), F.size("gram").alias("n"), "occurrences", "records")


QUERIES = {"p2_found": p2_found, "p2_terms": p2_terms, "p2_query_ngrams": p2_query_ngrams, "p2_document_ngrams": p2_document_ngrams}

_RAW_SQL = """
    raw AS (SELECT DISTINCT core, db, doc_id, term, cnt, wt FROM postings WHERE term IS NOT NULL),
    counts AS (SELECT trim(lower(term)) AS term, CAST(sum(cnt) AS BIGINT) AS occurrences,
                      count(DISTINCT (core, db, doc_id)) AS records FROM raw GROUP BY 1),
    marked AS (SELECT *, CASE WHEN records < 3 THEN 'rare'
                              WHEN records * 5 > (SELECT count(*) FROM docs) THEN 'common' END AS mark FROM counts)"""

SQL = {
    "p2_found": f"WITH {_RAW_SQL} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p2_terms": f"WITH {_RAW_SQL} SELECT term, occurrences, records, mark FROM marked",
    "p2_query_ngrams": """
        WITH w AS (SELECT row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(trim(query_text)), '\\s+'), lambda x: x <> '') AS words
                   FROM search_results),
             g AS (SELECT r, n, unnest(list_transform(range(1, greatest(len(words) - n + 2, 1)), lambda i: array_to_string(words[i:i+n-1], ' '))) AS gram
                   FROM w, (VALUES (1), (2), (3)) AS v(n))
        SELECT gram, n, count(*) AS occurrences, count(DISTINCT r) AS records FROM g GROUP BY gram, n""",
    "p2_document_ngrams": r"""
        WITH w AS (SELECT doc_id AS r, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
             g AS (SELECT r, n, unnest(list_transform(range(1, greatest(len(words) - n + 2, 1)), lambda i: array_to_string(words[i:i+n-1], ' '))) AS gram
                   FROM w, (VALUES (1), (2), (3)) AS v(n))
        SELECT gram, n, count(*) AS occurrences, count(DISTINCT r) AS records FROM g GROUP BY gram, n""",
}
