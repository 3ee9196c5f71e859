"""Encoding of a corpus with a public byte-level tokenizer, by forced-boundary splitting.

A text is parted by the tokenizer's own pattern; merges never leave a part.
Inside a part, two neighbouring bytes that no vocabulary token holds side by
side can never be merged over, so there the part is cut for certain. The
fragments are encoded independently, each distinct one once a worker, and their
ids are concatenated.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from ..sources import read_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the byte-level tokenizers' pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND = re.compile("[\U00010000-\U0010ffff]")  # the first plane
_SAFE_CUT = regex.compile(r"\p{L}(?= \p{L})")
_SEGMENT = 1 << 20
_CACHED = 400_000
_FLUSH = 1 << 21


@lru_cache(maxsize=2)
def splitter(top: int) -> re.Pattern:
    """``PATTERN`` for texts of characters up to ``top``, its classes of characters written out for the standard matcher, which is faster with short sets."""
    every = "".join(chr(c) for c in range(top + 1) if not 0xD800 <= c < 0xE000)

    def members(name: str) -> str:
        ends = ((ord(every[a]), ord(every[z - 1])) for a, z in (m.span() for m in regex.finditer(f"{name}+", every)))
        return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in ends)

    letters, numbers, blanks = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+")


class Encoder:
    """One vocabulary: a file of base64 tokens and ranks."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode_bytes = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        #: whether two bytes occur side by side inside any token
        self.joins = np.zeros((256, 256), bool)
        for t in self.ranks:
            if len(t) > 1:
                b = np.frombuffer(t, np.uint8)
                self.joins[b[:-1], b[1:]] = True
        self.joined = self.joins.tobytes()
        self.ascii, self.plane, self.any = splitter(0x7F).findall, splitter(0xFFFF).findall, regex.compile(PATTERN).findall
        self.parts: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[bytes, tuple[int, ...]] = {}

    def cut(self, part: bytes) -> list[bytes]:
        """``part`` cut at every forced boundary."""
        if len(part) <= 64:
            joined = self.joined
            at = [i for i, (a, b) in enumerate(zip(part, part[1:]), 1) if not joined[a << 8 | b]]
        else:
            b = np.frombuffer(part, np.uint8)
            at = (np.flatnonzero(~self.joins[b[:-1], b[1:]]) + 1).tolist()
        return [part[a:z] for a, z in zip([0, *at], [*at, len(part)])] if at else [part]

    def split(self, text: str) -> list[str]:
        """The parts of a text by ``PATTERN``."""
        return (self.ascii if text.isascii() else self.any if _BEYOND.search(text) else self.plane)(text)

    def _part(self, part: str) -> tuple[int, ...]:
        out: list[int] = []
        for f in self.cut(part.encode()):
            ids = self.fragments.get(f)
            if ids is None:
                ids = tuple(self.encode_bytes(f))
                if len(f) <= 64:
                    if len(self.fragments) >= _CACHED:
                        self.fragments.clear()
                    self.fragments[f] = ids
            out += ids
        return tuple(out)

    def _segments(self, text: str) -> Iterator[str]:
        """Long texts in pieces, cut before a single blank between letters, where the pattern always parts."""
        at = 0
        while len(text) - at > _SEGMENT and (m := _SAFE_CUT.search(text, at + _SEGMENT)):
            yield text[at : m.end()]
            at = m.end()
        yield text[at:]

    def _encoded(self, text: str | None) -> Iterator[Iterator[tuple[int, ...]]]:
        """The ids of each part of each segment. Distinct parts are encoded once and remembered if they are of usual length."""
        known = self.parts
        for s in self._segments(text or ""):
            parts = self.split(s)
            distinct = set(parts)
            new = distinct.difference(known)
            if new and len(known) + len(new) > _CACHED:
                known.clear()
                new = distinct
            for p in new:
                known[p] = self._part(p)
            yield map(known.__getitem__, parts)
            for p in new:
                if len(p) > 64:
                    del known[p]

    def encode(self, text: str | None) -> list[int]:
        """The ids; null and empty texts have none. Strings that look special are text."""
        out: list[int] = []
        for ids in self._encoded(text):
            out.extend(chain.from_iterable(ids))
        return out

    def count(self, text: str | None) -> int:
        """The number of ids."""
        return sum(sum(map(len, ids)) for ids in self._encoded(text))


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(vocabulary)


def encode_texts(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep: list[str] | None = None, ids: bool = True, deal: bool = True) -> DataFrame:
    """The columns ``keep`` of ``df`` with ``ids`` array<int>, or with ``n_tokens`` if not ``ids``.

    ``vocabulary``: a tokenizer's file, at the same path on every executor.
    ``deal``: deal a few files' rows out to all cores; not for a ``df`` that
    would have to be computed to be counted.

    Defined cases: null and empty texts have an empty list and 0 tokens; blank
    texts are encoded like any text; nulls in kept columns stay; repeated rows
    stay; texts of any length are encoded whole; an empty table gives no rows.
    """
    keep = keep or []
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = df.select(*named, F.col(text).alias("t"))
    rows = spread(rows) if deal else rows
    last = "ids array<int>" if ids else "n_tokens long"
    schema = ", ".join([*(f"k{i} {t}" for i, (_, t) in enumerate(rows.dtypes[:-1])), last])
    names = [*(f"k{i}" for i in range(len(keep))), last.split()[0]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            others, texts = [b.column(i) for i in range(len(keep))], b.column(len(keep))
            if not ids:
                n = pa.array([enc.count(t) for t in texts.to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*others, n], names)
                continue
            flat, ends, first = [], [0], 0
            for r in range(len(texts)):
                flat += enc.encode(texts[r].as_py())
                ends.append(len(flat))
                if len(flat) >= _FLUSH or r + 1 == len(texts):
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, r + 1 - first) for c in others), lists], names)
                    flat, ends, first = [], [0], r + 1

    out = rows.mapInArrow(work, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), names[-1])


def decode_digests(ids: DataFrame, key: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_ids, n_bytes, digest): the bytes that lists of ids stand for, as their number and MD5.

    An empty list stands for no bytes. ``key``: a long; ``ids``: a column array<int>.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: t for t, i in encoder(vocabulary).ranks.items()}
        for b in batches:
            raw = [b"".join(map(token.__getitem__, x.as_py())) for x in b.column(1)]
            n = b.column(1).value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(map(len, raw), pa.int64()), pa.array([hashlib.md5(r).hexdigest() for r in raw])], ["k", "n_ids", "n_bytes", "digest"])

    out = ids.select(F.col(key).cast("long").alias("k"), "ids").mapInArrow(work, "k long, n_ids long, n_bytes long, digest string")
    return out.withColumnRenamed("k", key)


def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids decoded again: number of bytes and digest, which are those of the text."""
    return decode_digests(p8_ids(spark, sf), "doc_id").drop("n_ids")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(read_table(spark, sf, "documents"), keep=["doc_id"])


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
SQL = {"p8_round_trip": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents"}
