"""Visually identical texts with different characters, brought to one form.

Full-width forms, no-break and fixed spaces become ordinary characters,
ignorable characters go, accents are composed. What is left are letters that
look alike across alphabets: a word is a lattice with all look-alikes of each
letter, and a Viterbi search picks the path of fewest changes of script and,
among those, of the best character n-gram score. The lattice depends on the
word's looks alone, so words that look the same get the same form, and each
form looks like its word. The n-gram scores are counted over the tokens of a
public multilingual vocabulary, so a text has the same form in every corpus.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import cut, spread
from ..sources import read_table

#: Letters of one look, as Latin, then Cyrillic, Greek and Armenian.
LOOKS = """
    AАΑ BВΒ CСϹ EЕΕ GԌ HНΗ IІӀΙ JЈͿ KКΚ MМΜ NΝ OОΟՕ PРΡ QԚ SЅՏ TТΤ UՍ VѴ WԜ XХΧ YҮΥ ZΖ
    aа cсϲ dԁ eе hһհ iі jјϳ nո oоοօ pр qԛ sѕ uս vѵν wԝ xх yу
""".split()
#: Format characters that show (signs that span digits or words).
_SHOWN = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
#: Ignorable characters outside the format category (joiners, fillers, variation selectors).
_IGNORABLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
HOT_ROWS = 100_000
BLOCK = 1_000  # copies of a text, or texts of a class, that a task pairs at once
_LATIN, _CYRILLIC, _GREEK, _ARMENIAN = 1, 2, 3, 4
_TOP = 0x590


def _scripts() -> np.ndarray:
    """Script by code point, for the letters of the four alphabets below _TOP."""
    out = np.zeros(_TOP, np.int8)
    for c in range(_TOP):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = _LATIN if c < 0x80 else 0 if c < 0x370 else _GREEK if c < 0x400 else _CYRILLIC if c < 0x530 else _ARMENIAN
    return out


SCRIPT = _scripts()


@lru_cache(maxsize=1)
def _plain() -> dict[int, str | None]:
    """Characters to replace or delete, by rule from the character database."""
    out: dict[int, str | None] = {}
    for c in range(0x80, sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind == "Cf" and c not in _SHOWN or any(a <= c <= z for a, z in _IGNORABLE):
            out[c] = None
        elif kind == "Zs" and c != 0x1680:  # the ogham space shows a stroke
            out[c] = " "
        elif unicodedata.decomposition(chr(c)).startswith(("<wide>", "<noBreak>")):
            out[c] = unicodedata.normalize("NFKC", chr(c))
    return out


def _set(points: list[int], escape: str = "\\U{:08x}") -> str:
    """The inside of a character set: code points as ranges."""
    runs: list[list[int]] = []
    for c in sorted(points):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(escape.format(a) + ("" if a == z else "-" + escape.format(z)) for a, z in runs)


#: Each letter's class: the first (Latin) letter of its look.
_CLASS = {ord(c): look[0] for look in LOOKS for c in look[1:]}
_MEMBERS = {look[0]: look for look in LOOKS}

# Letters as they occur in skeletons: Latin ones with look-alikes (open), other Latin ones, and those of other alphabets.
_OPEN = "".join(_MEMBERS)
_SHUT = "".join(c for c in map(chr, range(0x80)) if c.isalpha() and c not in _OPEN)
_OTHER = _set([c for c in range(0x370, _TOP) if SCRIPT[c] and c not in _CLASS])
_MARKS = "\u0300-\u036f"
_LETTER = f"A-Za-z{_OTHER}"
#: Words that hold no Latin letter without look-alikes: the only ones whose letters are in question if no word mixes such letters with other alphabets.
_OPEN_WORD = re.compile(f"[{_OPEN}{_OTHER}](?<![{_LETTER}{_MARKS}].)[{_OPEN}{_OTHER}{_MARKS}]*+(?![{_LETTER}])")
_ASCII_WORD = re.compile(f"[{_OPEN}](?<![A-Za-z].)[{_OPEN}]*+(?![A-Za-z])")
_WORD = re.compile(f"[{_LETTER}](?<![{_LETTER}{_MARKS}].)[{_LETTER}{_MARKS}]*+")
_MIXED = re.compile(f"[{_SHUT}][{_OPEN}{_MARKS}]*+[{_OTHER}]|[{_OTHER}][{_OPEN}{_MARKS}]*+[{_SHUT}]")


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, dict[str, str]]:
    """What each decomposed character becomes in a skeleton, by code point, and those that become more than one."""
    table, several = np.arange(sys.maxunicode + 1, dtype=np.uint32), {}
    for c, r in _plain().items():
        if r is None:
            table[c] = _GONE
        elif len(r) == 1:
            table[c] = ord(r)
        else:
            several[chr(c)] = r
    for c, r in _CLASS.items():
        table[c] = ord(r)
    return table, several


_GONE = 0xFFFFFFFF


def skeleton(text: str) -> str:
    """``text`` decomposed, without differences of form, every letter replaced by its look's class."""
    if text.isascii():
        return text
    table, several = _table()
    for c, r in several.items():
        text = text.replace(c, r)
    points = np.frombuffer(unicodedata.normalize("NFD", text).encode("utf-32-le", "surrogatepass"), np.uint32)
    looks = table[points]
    looks = looks[looks != _GONE]
    return unicodedata.normalize("NFD", looks.tobytes().decode("utf-32-le", "surrogatepass"))


def letter_pairs(texts: dict[str, int]) -> dict[tuple[int, int], int]:
    """Counts of neighbouring letters of one script in weighted texts."""
    out: dict[tuple[int, int], int] = {}
    for t, n in texts.items():
        c = [ord(x) for x in unicodedata.normalize("NFD", t) if not "\u0300" <= x <= "\u036f"]
        for a, b in zip(c, c[1:]):
            if a < _TOP and b < _TOP and SCRIPT[a] and SCRIPT[a] == SCRIPT[b]:
                out[a, b] = out.get((a, b), 0) + n
    return out


@lru_cache(maxsize=2)
def speller(vocabulary: str) -> Speller:
    """The worker's speller: neighbouring letters in a vocabulary's tokens, which are the commoner the smaller their rank."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    texts: dict[str, int] = {}
    for t, r in ranks.items():
        try:
            texts[t.decode()] = 1 + 10_000_000 // (r + 256)
        except UnicodeDecodeError:
            continue  # a piece of a character
    return Speller(letter_pairs(texts))


class Speller:
    """Chooses the letters of words given as skeletons; ``counts``: {(a, b): n} of neighbouring letters of one script."""

    def __init__(self, counts: dict[tuple[int, int], int]):
        self.pairs = counts
        self.firsts: dict[int, int] = {}
        for (a, _), n in counts.items():
            self.firsts[a] = self.firsts.get(a, 0) + n
        self.whole = {s: 1 + sum(n for a, n in self.firsts.items() if SCRIPT[a] == s) for s in (_LATIN, _CYRILLIC, _GREEK, _ARMENIAN)}
        self.words: dict[str, str] = {}

    def _first(self, c: int) -> float:
        """How usual the letter is over all scripts, so that usual scripts come first."""
        return log((self.firsts.get(c, 0) + 0.5) / sum(self.whole.values()))

    def _next(self, a: int, b: int) -> float:
        return log((self.pairs.get((a, b), 0) + 0.5) / (self.firsts.get(a, 0) + 64.0))

    def search(self, word: str) -> str:
        """The best path through the word's lattice; marks keep their places."""
        letters = [i for i, c in enumerate(word) if not "\u0300" <= c <= "\u036f"]
        # each letter's best way so far, (changes of script, -score), and for every step the letters they came from
        states: dict[str, tuple[int, float]] = {}
        came: list[dict[str, str]] = []
        for n, i in enumerate(letters):
            new: dict[str, tuple[int, float]] = {}
            back: dict[str, str] = {}
            for c in _MEMBERS.get(word[i], word[i]):
                b = ord(c)
                if not n:
                    new[c] = (0, -self._first(b))
                    continue
                for a, (changes, cost) in states.items():
                    same = SCRIPT[ord(a)] == SCRIPT[b]
                    way = (changes + (not same), cost - (self._next(ord(a), b) if same else self._first(b)))
                    if c not in new or way < new[c]:
                        new[c], back[c] = way, a
            states = new
            came.append(back)
        out = list(word)
        c = min(states, key=states.get) if states else ""
        for i, back in zip(reversed(letters), reversed(came)):
            out[i] = c
            c = back.get(c, "")
        return "".join(out)

    def spelled(self, w: str) -> str:
        """``search``, remembered for words of usual length."""
        got = self.words.get(w)
        if got is None:
            got = self.search(w)
            if len(w) <= 64:
                if len(self.words) >= 400_000:
                    self.words.clear()
                self.words[w] = got
        return got

    def _respelled(self, words: re.Pattern, text: str) -> str:
        """``text`` with its words spelled; most texts hold none that changes, which their distinct words tell."""
        if all(self.spelled(w) == w for w in set(words.findall(text))):
            return text
        return words.sub(lambda m: self.spelled(m.group()), text)

    def form(self, text: str) -> str:
        """The one form of all texts that look like ``text``."""
        if text.isascii():
            return self._respelled(_ASCII_WORD, text)
        plain = skeleton(text)
        return unicodedata.normalize("NFC", self._respelled(_WORD if _MIXED.search(plain) else _OPEN_WORD, plain))


def _forms(df: DataFrame, id_col: str, text: str, hashed: bool, vocabulary: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form_of = speller(vocabulary).form
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).digest()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                raw = part.column(1).to_pylist()
                form = [None if t is None else form_of(t) for t in raw]
                if not hashed:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(form, pa.string())], ["id", "form"])
                    continue
                shown = [bool(f and f.strip()) for f in form]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([digest(f) if s else None for f, s in zip(form, shown)], pa.binary()), pa.array([digest(t) if s else None for t, s in zip(raw, shown)], pa.binary())], ["id", "form", "raw"])

    schema = "id long, form binary, raw binary" if hashed else "id long, form string"
    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text))).mapInArrow(work, schema)


def one_form(df: DataFrame, id_col: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, form): each text in the form that it shares with all texts of its looks.

    ``vocabulary``: a public vocabulary's file, at the same path on every
    executor. Defined cases: a null text has a null form, an empty one an empty
    form; case, accents, raised digits, punctuation, line breaks and the number
    of blanks stay; repeated rows stay; an empty table gives no rows; other
    columns are not read.
    """
    return _forms(df, id_col, text, False, vocabulary).withColumnRenamed("id", id_col)


def look_classes(df: DataFrame, id_col: str, text: str, vocabulary: str = VOCABULARY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, class_id): one row a document; class_id is the smallest id of the documents that look like it.

    Defined cases: null texts and those without any visible character are in no
    class; ids are unique; an empty table gives no rows; other columns are not
    read.
    """
    rows = cut(_forms(df, id_col, text, True, vocabulary).where("form is not null").select("id", "form"))
    first = rows.groupBy("form").agg(F.min("id").alias("class_id"))
    return lookup_join(rows, first, "form", hot_rows).select(F.col("id").alias(id_col), "class_id")


def look_the_same(df: DataFrame, id_col: str, text: str, vocabulary: str = VOCABULARY, hot_rows: int = HOT_ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all rows that look the same but differ as strings.

    Texts are classed by form (as SHA-256 of form and text). Pairs are built
    between distinct texts first; exact copies only multiply finished pairs
    and are never paired with one another. A text's copies are cut into blocks
    of about ``block`` rows and a class's texts into as large ones, and what is
    joined are blocks: a text of a third of all rows is many rows of ids, and no
    task holds more than one block of it.

    Defined cases: null texts and those without any visible character are in
    no pair; ids are unique; an empty table gives no rows; other columns are
    not read.
    """
    rows = cut(_forms(df, id_col, text, True, vocabulary).where("form is not null"))
    texts = rows.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n"))
    several = texts.groupBy("form").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    texts = cut(texts.join(several, "form").select("form", "raw", parts("n").alias("blocks"), parts("d").alias("salts")))
    left = texts.select("form", F.pmod(F.xxhash64("raw"), "salts").cast("int").alias("salt"), F.col("raw").alias("raw_a"), F.col("blocks").alias("blocks_a"))
    right = texts.select("form", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("raw").alias("raw_b"), F.col("blocks").alias("blocks_b"))
    alike = left.join(right, ["form", "salt"]).where("raw_a < raw_b")
    every = lambda s: F.explode(F.sequence(F.lit(0), F.col(f"blocks_{s}") - 1)).alias(f"block_{s}")
    alike = alike.select("raw_a", "raw_b", "blocks_b", every("a")).select("raw_a", "block_a", "raw_b", every("b"))
    copies = lookup_join(rows.select("raw", "id"), texts.select("raw", "blocks"), "raw", hot_rows)
    ids = copies.groupBy("raw", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block")).agg(F.collect_list("id").alias("ids"))
    side = lambda s: ids.select(F.col("raw").alias(f"raw_{s}"), F.col("block").alias(f"block_{s}"), F.col("ids").alias(f"ids_{s}"))
    both = alike.join(side("a"), ["raw_a", "block_a"]).join(side("b"), ["raw_b", "block_b"])
    pairs = both.select(F.explode("ids_a").alias("a"), "ids_b").select("a", F.explode("ids_b").alias("b"))
    return pairs.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))


def p10_found(spark: SparkSession, sf: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents that look the same but differ as strings."""
    return look_the_same(read_table(spark, sf, "documents"), "doc_id", "text", vocabulary)


def p10_classes(spark: SparkSession, sf: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every visible document with the smallest document that looks like it."""
    return look_classes(read_table(spark, sf, "documents"), "doc_id", "text", vocabulary)


def p10_forms(spark: SparkSession, sf: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document's text in its one form."""
    return one_form(read_table(spark, sf, "documents"), "doc_id", "text", vocabulary)


QUERIES = {"p10_found": p10_found, "p10_classes": p10_classes, "p10_forms": p10_forms}


def _looks_sql() -> str:
    """Documents with what they look like (CTE looks): single replacements on composed texts, no decomposition and no search."""
    lit = lambda t: "'" + t.replace("'", "''") + "'"
    plain = _plain()
    gone = _set([c for c, r in plain.items() if r is None], "\\x{{{:x}}}")
    letters = {chr(c): r for c, r in _CLASS.items()}
    for c in range(0x80, 0x2000):
        whole = unicodedata.normalize("NFD", chr(c))
        if len(whole) > 1 and ord(whole[0]) in _CLASS:
            letters[chr(c)] = unicodedata.normalize("NFC", _CLASS[ord(whole[0])] + whole[1:])

    def swapped(x: str, table: dict[str, str]) -> str:
        one = {a: b for a, b in table.items() if len(b) == 1}
        for a, b in table.items():
            if len(b) > 1:
                x = f"replace({x}, {lit(a)}, {lit(b)})"
        return f"translate({x}, {lit(''.join(one))}, {lit(''.join(one.values()))})"

    step = f"nfc_normalize(regexp_replace(text, '[{gone}]', '', 'g'))"
    step = swapped(step, {chr(c): r for c, r in plain.items() if r is not None})
    step = f"nfc_normalize({swapped(f'nfc_normalize({step})', letters)})"
    blank = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{1680}\\x{2028}\\x{2029}]"
    return f"""
        looks AS MATERIALIZED (SELECT * FROM (SELECT doc_id, text, {step} AS look FROM documents WHERE text IS NOT NULL)
                               WHERE regexp_replace(look, '{blank}', '', 'g') <> '')"""


SQL = {
    "p10_found": f"WITH {_looks_sql()} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM looks a JOIN looks b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p10_classes": f"WITH {_looks_sql()} SELECT doc_id, min(doc_id) OVER (PARTITION BY look) AS class_id FROM looks",
}
