"""Corpus encoding, mixing, look-alike texts."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.llm import mix
from quarryline.llm.encode import VOCABULARY, Encoder, encode_texts, encoder
from quarryline.llm import lookalike
from quarryline.llm.lookalike import LOOKS, Speller, look_classes, look_the_same, one_form, skeleton, speller


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- encoding ----

ODD = ["", " ", "  a", "a  ", "\n\n x", "<|endoftext|>", "don't I'LL", "naïve 中文字 🕸️👩‍💻", "0123 ²½", "\t 　x", "\x00�", "ab " * 50, "aaaa" * 500, "漢" * 300]


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_encode_any_text(public, text):
    assert encoder(VOCABULARY).encode(text) == public(text)


def test_encode_odd_texts(public):
    for t in ODD:
        assert encoder(VOCABULARY).encode(t) == public(t), t


def test_forced_cuts_are_in_no_token():
    e = encoder(VOCABULARY)
    for part in ("hello", "中文字典", "qzxj9", "éééé"):
        raw = part.encode()
        pieces = e.cut(raw)
        assert b"".join(pieces) == raw
        for a, b in zip(pieces, pieces[1:]):
            assert not any(a[-1:] + b[:1] in t for t in e.ranks)
    assert any(len(e.cut(p.encode())) > 1 for p in ("中文字典", "qzxj9"))


def test_long_texts_in_segments(public, monkeypatch):
    import quarryline.llm.encode as m

    monkeypatch.setattr(m, "_SEGMENT", 50)
    e = Encoder(VOCABULARY)
    rnd = random.Random(1)
    for _ in range(50):
        t = "".join(rnd.choice(["word", " ", "  ", "\n", "9", "'s", "é", "."]) for _ in range(300))
        assert e.encode(t) == public(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_encode_texts(spark, name):
    """Ids decode to the very bytes of the text, for either vocabulary."""
    data = [(i, t, None, "x") for i, t in enumerate([*ODD, None, "a" * 200_000])]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, ids string")
    path = f"/opt/tokenizers/{name}.tiktoken"
    back = {v: k for k, v in Encoder(path).ranks.items()}
    got = {r.doc_id: r.ids for r in encode_texts(df, vocabulary=path, keep=["doc_id"]).collect()}
    for i, t, *_ in data:
        assert b"".join(back[x] for x in got[i]) == (t or "").encode()
    n = {r.doc_id: r.n_tokens for r in encode_texts(df, vocabulary=path, keep=["doc_id", "lang"], ids=False).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert encode_texts(df.limit(0), keep=["doc_id"]).collect() == []


# ---- mixing ----


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 1000), st.floats(0.01, 0.99), st.integers(0, 3)), max_size=60), st.integers(0, 9))
def test_pivot(items, seed):
    items = sorted(items, key=lambda x: x[2])
    w, p, seg = np.array([x[0] for x in items], np.int64), np.array([x[1] for x in items], float), np.array([x[2] for x in items], np.int64)
    q = mix.pivot(w, p, np.arange(len(w)), seg, seed)
    for s in set(seg.tolist()):
        at = seg == s
        assert ((q > 0) & (q < 1))[at].sum() <= 1
        assert (w * q)[at].sum() == pytest.approx((w * p)[at].sum(), abs=1e-6 * (1 + w.sum()))


def test_pivot_keeps_expectations():
    w, p = np.array([5, 50, 7, 90, 20]), np.array([0.3, 0.5, 0.9, 0.1, 0.6])
    mean = np.mean([mix.pivot(w, p, np.arange(5), np.zeros(5, int), 3 * s) for s in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


@pytest.mark.parametrize(("leaves", "chunk"), [(1, 4096), (64, 4096), (4096, 4096), (64, 2)])
def test_round_copies(spark, leaves, chunk, monkeypatch):
    monkeypatch.setattr(mix, "LEAVES", leaves)
    monkeypatch.setattr(mix, "CHUNK", chunk)
    rnd = random.Random(leaves)
    data = [("hot" if i % 3 else "b", i, rnd.randrange(1, 400), 0.37) for i in range(900)]
    out = mix.round_copies(spark.createDataFrame(data, mix._STATE)).collect()
    assert len(out) == 900 and {r.p for r in out} <= {0.0, 1.0}
    for s in ("hot", "b"):
        want = sum(t * p for x, _, t, p in data if x == s)
        assert abs(sum(r.tokens * r.p for r in out if r.source == s) - want) < 400


@pytest.mark.parametrize("hot", [0, 100_000])
def test_mix_sources(spark, hot):
    rnd = random.Random(2)
    sources = ["big"] * 6 + ["mid", "tiny", "other", None]
    data = [(i, rnd.choice(sources) if i % 40 else "tiny", rnd.choice([0, *range(1, 200)]), 0.5, "x") for i in range(1200)]
    sizes = spark.createDataFrame(data, "doc_id long, source string, tokens long, p double, copies string")
    targets = [("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.15, 2), ("none", 0.05, 4), ("null", None, None), (None, 0.1, 1)]
    table = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    have = {s: sum(t for _, x, t, *_ in data if x == s) for s in ("big", "mid", "tiny")}
    mixed = mix.mix_sources(sizes, table, hot_rows=hot)
    got = mixed.collect()
    total = sum(have.values())
    for s, share, repeats in targets[:3]:
        out = sum(r.tokens * r.copies for r in got if r.source == s)
        assert abs(out - min(share * total, have[s] * repeats)) < 200
        assert all(1 <= r.copies <= repeats for r in got if r.source == s)
    assert {r.source for r in got} <= {"big", "mid", "tiny"} and len({r.doc_id for r in got}) == len(got)
    report = {r.source: r for r in mix.mix_report(mixed, sizes.where(F.col("source").isin("big", "mid", "tiny")), table).collect()}
    assert report["none"].share == 0 and not report["none"].enough and not report["none"].reached and report["big"].reached and report["big"].enough
    assert sum(r.share for r in report.values()) == pytest.approx(1)
    assert mix.mix_sources(sizes.limit(0), table).count() == mix.mix_sources(sizes, table.limit(0)).count() == 0


def test_mix_is_the_same_on_any_cluster(spark):
    """Neither partitions nor Arrow batches nor the shuffle's width change a seed's mix."""
    data = [(i, "hot" if i % 3 else f"s{i % 5}", 1 + i * 7919 % 300) for i in range(3_000)]
    sizes = spark.createDataFrame(data, "doc_id long, source string, tokens long")
    table = spark.createDataFrame([("hot", 0.4, 2), ("s0", 0.2, 3), ("s3", 0.1, 1)], "source string, target_share double, max_repeats int")
    one = rows(mix.mix_sources(sizes, table))
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert rows(mix.mix_sources(sizes.repartition(5), table)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows(mix.mix_sources(sizes, table, seed=7)) != one


# ---- look-alike texts ----

ALIKE = [
    ("Verweise", "Verweіse"), ("Café", "Café"), ("ｆｕｌｌ　ｗｉｄｅ！", "full wide!"), ("a​b­c﻿", "abc"),
    ("a b c d", "a b c d"), ("ПОРТ", "ПOPT"), ("й", "й"), ("ë", "ё"), ("K", "K"),
    ("Ở", "Ở"), ("и‍̆", "й"), ("ο ν", "o v"), ("ジ", "ジ"),
]
APART = [
    ("a", "á"), ("a", "A"), ("x2", "x²"), ("a b", "a  b"), ("a\nb", "a b"), ("a.", "a;"), ("ab", "ac"), ("fi", "ﬁ"), ("к", "k"), ("½", "1/2"),
    ("n", "п"), ("a\tb", "a b"), ("1", "l"), ("ü", "u"), ("à", "á"),
]


def test_forms():
    s = Speller({})
    for a, b in ALIKE:
        assert s.form(a) == s.form(b), (a, b)
        assert s.form(s.form(a)) == s.form(a)
    for a, b in APART:
        assert s.form(a) != s.form(b), (a, b)


@settings(max_examples=200, deadline=None)
@given(st.text("".join(LOOKS) + "bgкя ǘ1", max_size=8), st.randoms(use_true_random=False))
def test_swapped_letters_have_one_form(text, rnd):
    """Swapping letters within a look changes nothing, and a form keeps its text's looks."""
    other = "".join(rnd.choice(next((x for x in LOOKS if c in x), c)) for c in text)
    s = Speller({(ord("o"), ord("p")): 5, (ord("о"), ord("р")): 9})
    assert s.form(text) == s.form(other)
    assert skeleton(s.form(text)) == unicodedata.normalize("NFD", skeleton(text))


def test_scripts_are_consistent():
    co, lat = (0x441, 0x43E), (ord("c"), ord("o"))
    s = Speller({co: 100, lat: 5})
    assert s.form("слоvо") == s.form("слоνо") and s.form("слoжо") == "сложо"
    assert s.form("wоrd") == "word"
    assert s.form("co") == "со"  # only the counts can tell
    assert Speller({lat: 100}).form("со") == "co"


def independent_look(text):
    """What a text looks like, by the names of its characters alone."""
    out = []
    for c in unicodedata.normalize("NFD", text):
        name = unicodedata.name(c, "")
        if name.startswith("FULLWIDTH"):
            c = unicodedata.normalize("NFKC", c)
        elif "SPACE" in name.split() and "ZERO WIDTH" not in name or name in ("EN QUAD", "EM QUAD"):
            c = " "
        elif "ZERO WIDTH" in name or name in ("SOFT HYPHEN", "WORD JOINER", "COMBINING GRAPHEME JOINER"):
            c = ""
        else:
            c = next((ch for names, ch in NAMED if name in names), c)
        out.append(c)
    return unicodedata.normalize("NFD", "".join(out))


NAMED = [
    ({"CYRILLIC SMALL LETTER A"}, "a"), ({"CYRILLIC SMALL LETTER IE"}, "e"), ({"CYRILLIC SMALL LETTER O", "GREEK SMALL LETTER OMICRON", "ARMENIAN SMALL LETTER OH"}, "o"), ({"CYRILLIC SMALL LETTER ER"}, "p"),
    ({"CYRILLIC SMALL LETTER ES", "GREEK LUNATE SIGMA SYMBOL"}, "c"), ({"CYRILLIC SMALL LETTER HA"}, "x"), ({"CYRILLIC SMALL LETTER BYELORUSSIAN-UKRAINIAN I"}, "i"), ({"GREEK SMALL LETTER NU"}, "v"),
    ({"CYRILLIC CAPITAL LETTER O"}, "O"), ({"CYRILLIC CAPITAL LETTER ER"}, "P"), ({"CYRILLIC CAPITAL LETTER TE"}, "T"), ({"CYRILLIC CAPITAL LETTER IZHITSA"}, "V"), ({"CYRILLIC LETTER PALOCHKA"}, "I"), ({"GREEK CAPITAL LETTER YOT"}, "J"),
]


def brute_pairs(texts):
    docs = [(i, t, independent_look(t)) for i, t in texts if t is not None and independent_look(t).strip()]
    return sorted((min(i, j), max(i, j)) for i, t, f in docs for j, u, g in docs if i < j and f == g and t != u)


@pytest.mark.parametrize(("hot", "block"), [(100_000, 1_000), (0, 2)])
def test_look_the_same(spark, hot, block):
    texts = [t for p in ALIKE for t in p] + [t for p in APART for t in p] + ["abc"] * 7 + ["аbc"] * 5 + ["ab\u0441", None, "", " ", " ", "​", "\n"]
    texts = [*enumerate(texts), (900, "x" * 300_000), (901, "\u0445" + "x" * 299_999)]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in texts], "doc_id long, text string, form string, raw string")
    got = rows(look_the_same(df, "doc_id", "text", hot_rows=hot, block=block))
    assert got == brute_pairs(texts) and (900, 901) in got and len(got) > len(ALIKE)
    assert rows(look_the_same(df.limit(0), "doc_id", "text")) == []
    forms = {r.doc_id: r.form for r in one_form(df, "doc_id", "text").collect()}
    assert len(forms) == len(texts) and all((forms[i] is None) == (t is None) for i, t in texts)
    classes = dict(rows(look_classes(df, "doc_id", "text", hot_rows=hot)))
    seen = [(i, independent_look(t)) for i, t in texts if t is not None and independent_look(t).strip()]
    assert classes == {i: min(j for j, g in seen if g == f) for i, f in seen}


def test_forms_do_not_depend_on_the_corpus(spark):
    """A text has one form whatever it stands beside, spelled in the alphabet of its language."""
    alone = spark.createDataFrame([(1, "слoвo и \u0441\u043e")], "doc_id long, text string")
    many = alone.union(spark.createDataFrame([(i, "co so as he she") for i in range(2, 60)], alone.schema))
    form = {r.doc_id: r.form for r in one_form(many, "doc_id", "text").collect()}
    assert [form[1]] == [r.form for r in one_form(alone, "doc_id", "text").collect()] and form[1].startswith("слово и ")
    assert speller(lookalike.VOCABULARY).form("he has a cop as he is so") == "he has a cop as he is so"


def test_the_short_cuts_change_nothing():
    """Words passed over have the form that a search would give them."""
    s = speller(lookalike.VOCABULARY)
    rnd = random.Random(5)
    letters = "acopxsebdgкяжиАОР́̆ .1"
    for _ in range(3_000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 12)))
        assert s.form(t) == unicodedata.normalize("NFC", lookalike._WORD.sub(lambda m: s.spelled(m.group()), skeleton(t))), t
