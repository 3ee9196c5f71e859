"""Seen keys, term frequencies, frequent items, caps, weights, hidden duplicates."""

import random
from collections import Counter
from fractions import Fraction
from math import log2

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.llm import canon, cap, clean, distinctive, heavy, seen, termfreq
from quarryline.llm.ribbon import Ribbon, mix, seal


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- ribbon filters ----


@pytest.mark.parametrize("n", [0, 1, 63, 1_000, 30_000])
def test_ribbon(n):
    keys = mix(np.arange(n, dtype=np.uint64), 5)
    f = Ribbon.load(seal(np.concatenate([keys, keys[: n // 2]]), bits=12).dump())
    assert f.contains(keys).all()
    absent = mix(np.arange(10**6, 10**6 + 40_000, dtype=np.uint64), 5)
    assert f.contains(absent).mean() < 3 / 2**12
    assert f.planes.nbytes <= 2 * (1.2 * n + 200)  # about one fingerprint of 12 bits a key


def test_ribbon_on_close_keys():
    keys = np.arange(5_000, dtype=np.uint64)
    f = seal(keys)
    assert f.contains(keys).all() and not f.contains(keys + np.uint64(2**40)).all()


# ---- seen before ----


def brute_seen(jobs, old):
    known, out = set(old), []
    for i, u in sorted((j for j in jobs if None not in j), key=lambda j: j[0]):
        if u in known:
            out.append((i,))
        known.add(u)
    return out


@pytest.mark.parametrize("bits", [1, 12])
def test_seen_before(spark, bits):
    """With one bit a filter answers half of all absent keys wrongly; results stay exact."""
    rnd = random.Random(bits)
    urls = ["hot"] * 40 + ["", "é", None] + [f"u{i}" for i in range(60)]
    jobs = [(i, rnd.choice(urls)) for i in rnd.sample(range(-100, 5000), 900)] + [(None, "u1")]
    old = ["u3", "u3", None, "nowhere"]
    df = spark.createDataFrame([(i, u, 1, "x", 2) for i, u in jobs], "job_id long, url string, gen int, h string, id int")
    history = spark.createDataFrame([(u,) for u in old], "key string")
    assert rows(seen.seen_before(df, history, "job_id", "url", bits)) == brute_seen(jobs, [u for u in old if u])
    report = {r.gen: r for r in seen.seen_report(df, history, "job_id", "url", bits).collect()}
    assert sum(r.wrong for r in report.values()) <= sum(r.positives for r in report.values())
    assert all(0 <= r.audit_rate <= 1 for r in report.values()) and min(g for g in report if g is not None) >= 0
    first = len({u for _, u in jobs if u is not None} - {u for u in old if u})
    assert bits > 1 or sum(r.wrong for r in report.values()) > 0 and first > 0


def test_history_in_generations(spark, monkeypatch):
    """The history counts when shards are sized, and no batch holds it as a whole."""
    monkeypatch.setattr(seen, "SHARD_KEYS", 1_000)
    jobs = spark.createDataFrame([(1, "old5"), (2, "new")], "id long, key string").withColumn("gen", F.lit(0))
    history = spark.range(20_000).select(F.concat(F.lit("old"), "id").alias("key"))
    verdicts = seen.probe_generations(jobs, history, 20_002)
    assert verdicts.rdd.getNumPartitions() == 21
    sizes = {r.gen: r.n for r in verdicts.groupBy("gen").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes.pop(0) == 2 and set(sizes) == set(range(-8, 0)) and max(sizes.values()) < 20_000 / 8 * 1.2
    assert rows(seen.seen_before(jobs.withColumnRenamed("id", "i"), history, "i", "key")) == [(1,)]


def test_texts_of_keys_stay_where_they_are(spark):
    """No exchange carries a key's text."""
    df = spark.createDataFrame([(1, 0, "a")], "id long, gen int, key string")
    plan = seen.probe_generations(df, df.select("key"), 2)._jdf.queryExecution().executedPlan().toString()
    _, below = plan.split("Exchange")
    assert below.startswith(" hashpartitioning(h#") and "_merge(" in below.splitlines()[1] and "key" not in below.splitlines()[1]


def test_seen_before_empty(spark):
    none = spark.createDataFrame([], "job_id long, url string")
    key = spark.createDataFrame([], "key string")
    assert rows(seen.seen_before(none, key, "job_id", "url")) == []
    one = spark.createDataFrame([(7, "a")], "job_id long, url string")
    assert rows(seen.seen_before(one, key, "job_id", "url")) == []
    assert rows(seen.seen_before(one, spark.createDataFrame([("a",)], "key string"), "job_id", "url")) == [(7,)]


# ---- suffix arrays ----


def brute_grams(records, n_max):
    occ, rec = Counter(), Counter()
    for r in records:
        grams, run = [], []
        for t in [*(r or []), None]:
            if t is not None:
                run.append(t)
                continue
            grams += [tuple(run[i : i + n]) for n in range(1, n_max + 1) for i in range(len(run) - n + 1)]
            run = []
        occ.update(grams)
        rec.update(set(grams))
    return sorted((list(g), occ[g], rec[g]) for g in occ)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "", None, "é"]), max_size=9)), max_size=9))
def test_ngrams(spark, records):
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(records)], "i int, words array<string>, gram string")
    for block in (1, 5, 1 << 20):
        got = sorted((r.gram, r.occurrences, r.records) for r in termfreq.ngram_counts(df, "words", 3, block).collect())
        assert got == brute_grams(records, 3)


def test_ngrams_of_a_long_record(spark):
    text = ["x", "y"] * 150_000
    df = spark.createDataFrame([(text,), (["y"],)], "words array<string>")
    got = {" ".join(r.gram): (r.occurrences, r.records) for r in termfreq.ngram_counts(df, "words", 2).collect()}
    assert got == {"x": (150_000, 1), "y": (150_001, 2), "x y": (150_000, 1), "y x": (149_999, 1)}


def test_term_counts(spark):
    rnd = random.Random(3)
    data = [(rnd.choice([0, None]), 0, rnd.randrange(9), rnd.choice(["hot", "hot", "b", "", None]), rnd.choice([None, 1, 5])) for _ in range(400)]
    df = spark.createDataFrame([(*r, "x") for r in data], "core int, db int, doc_id long, term string, cnt long, t string")
    want = {}
    for c, d, i, t, n in data:
        if t is not None:
            w = want.setdefault(t, [0, set()])
            w[0] += n or 0
            w[1].add((c, d, i))
    for block in (1, 7, 1 << 18):
        assert rows(termfreq.term_counts(df, clean.RECORD, "term", "cnt", block)) == sorted((t, n, len(s)) for t, (n, s) in want.items())


def test_a_pair_longer_than_a_block(spark):
    """A pair of very many rows is one record however many blocks it fills."""
    df = spark.range(30_000).select(F.lit(0).alias("core"), F.lit(0).alias("db"), F.lit(5).alias("doc_id"), F.lit("t").alias("term"), F.lit(2).alias("cnt"))
    df = df.unionByName(spark.createDataFrame([(0, 0, 6, "t", 1), (None, 0, 5, "t", 1)], "core int, db int, doc_id int, term string, cnt int"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        assert rows(termfreq.term_counts(df, clean.RECORD, "term", "cnt", 1_000)) == [("t", 60_002, 3)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_marks(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("c", 1, 4)], "term string, occurrences long, records long")
    n = spark.createDataFrame([(15,)], "n long")
    assert [r.mark for r in termfreq.marked(df, n).orderBy("term").collect()] == ["rare", None, "common"]


# ---- clean postings and weights ----

POSTINGS = "core int, db int, doc_id long, term string, cnt long, wt int, score double"


def test_clean_postings(spark):
    data = [(0, 0, 1, " A", 2, 0, 1.0), (0, 0, 1, " A", 2, 0, 2.0), (0, 0, 1, "a", 3, 1, 0.0), (0, 0, 1, None, 9, 9, 0.0), (None, 0, 1, "a", None, 1, 0.0), (0, 0, 2, "a ", 2, 0, 0.0)]
    got = clean.clean_postings(spark.createDataFrame(data, POSTINGS))
    assert sorted(map(str, rows(got.select(F.coalesce("core", F.lit(-1)), "doc_id", "term", "cnt")))) == sorted(map(str, [(0, 1, "a", 5), (-1, 1, "a", 0), (0, 2, "a", 2)]))


@pytest.mark.parametrize("hot", [0, 3, 100])
def test_log_entropy(spark, hot):
    data = [(0, 0, i, "all", 2) for i in range(8)] + [(0, 0, 1, "one", 7), (0, 0, 1, "two", 1), (0, 0, 2, "two", 3), (0, 0, 3, "zero", 0)]
    df = spark.createDataFrame([(*r, 0.5, 7) for r in data], "core int, db int, doc_id long, term string, cnt long, entropy double, records int")
    got = {(r.doc_id, r.term): (r.score, r.records) for r in distinctive.log_entropy(df, 8, hot).collect()}
    h = -(0.25 * log2(0.25) + 0.75 * log2(0.75))
    assert got[1, "all"] == pytest.approx((0, 8)) and got[1, "one"] == pytest.approx((3, 1))
    assert got[2, "two"] == pytest.approx((2 * (1 - h / 3), 2)) and got[3, "zero"][0] == 0 and len(got) == len(data)
    assert rows(distinctive.log_entropy(df.limit(0), 0)) == []


# ---- caps ----


def brute_level(counts, share):
    met = max((l for l in range(max(counts, default=0) + 1) if l <= share * sum(min(n, l) for n in counts)), default=0)
    return met or min(counts, default=0)


@pytest.mark.parametrize("radix", [1, 2, 10])
def test_water_level(spark, monkeypatch, radix):
    monkeypatch.setattr(cap, "_RADIX", radix)
    rnd = random.Random(radix)
    for counts in ([], [1], [7, 7], [1, 60], *([int(1.3 ** rnd.randrange(24)) for _ in range(rnd.randrange(1, 40))] for _ in range(6))):
        df = spark.createDataFrame([(n,) for n in counts], "n long").cache()
        for part in (1, 3, 10, 20):
            share = Fraction(part, 20)
            assert cap.water_level(df, share) == brute_level(counts, share), (counts, share)
        assert cap.water_level(df, most=5) == min(max(counts, default=0), 5)


def test_best_k_of_a_hot_host(spark):
    """A cap beyond Spark's limit for windows is exact, and its rows are spread over tasks."""
    df = spark.range(0, 1_000_000, 1, 8).select(F.lit("hot").alias("host"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("priority"), F.col("id").alias("job_id"))
    df = df.unionByName(spark.createDataFrame([("b", 1, -1), ("b", None, -2), (None, 5, -3)], "host string, priority long, job_id long"))
    dropped = cap.over_cap(df, ["host"], "priority", "job_id", 5_000)
    assert dropped.count() == 1_000_000 - 5_000
    best = df.where("host = 'hot'").orderBy(F.col("priority").desc(), "job_id").limit(5_000).select("job_id")
    assert dropped.join(best, "job_id", "left_semi").count() == 0
    kept = cap.best_k(df.dropna(subset=["host"]), ["host"], "priority", "job_id", 5_000)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan[: plan.index("Join")] and rows(kept.where("host = 'b'").select("job_id")) == [(-2,), (-1,)]


def test_over_cap(spark):
    data = [(i, "hot" if i % 2 else "b", 1 if i < 60 else 2, [None, 5, 5, 9][i % 4]) for i in range(100)] + [(200, None, 1, 1), (201, "b", None, 1)]
    df = spark.createDataFrame([(*r, "x") for r in data], "job_id long, host string, day int, priority long, __n string")
    want = []
    for key in {r[1:3] for r in data if None not in r[1:3]}:
        g = sorted((r for r in data if r[1:3] == key), key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
        want += [(r[0],) for r in g[7:]]
    assert rows(cap.over_cap(df, ["host", "day"], "priority", "job_id", 7)) == sorted(want)
    assert rows(cap.over_cap(df.limit(0), ["host", "day"], "priority", "job_id", 7)) == []


def test_p5_goes_through_the_level(spark, monkeypatch):
    """p5_found keeps as many rows as water-filling says, not a number of its own."""
    from conftest import DATA

    whole = cap.p5_found(spark, str(DATA)).count()
    monkeypatch.setattr(cap, "water_level", lambda counts, share, most: {"host", "day", "n"} == set(counts.columns) and 1)
    assert cap.p5_found(spark, str(DATA)).count() > whole


@pytest.mark.parametrize("share", ["0.1", "0.25", "0.5", "0.01"])
def test_cap_share(spark, share, monkeypatch):
    monkeypatch.setattr(cap, "_RADIX", 3)
    rnd = random.Random(share)
    data = [(i, rnd.choice(["hot", "hot", "hot", "h2", "h2", *(f"s{k}" for k in range(12))]), rnd.choice([None, *range(-3, 40), 10**6])) for i in rnd.sample(range(10_000), 700)] + [(-1, None, 3), (-2, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in data], "job_id long, host string, priority long, q string")
    counts = Counter(h for _, h, _ in data if h)
    level = brute_level(list(counts.values()), Fraction(share))
    assert level > 0
    want = [(i,) for i, h, _ in data if h is None]
    for h in counts:
        g = sorted((r for r in data if r[1] == h), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        want += [(r[0],) for r in g[:level]]
    assert rows(cap.cap_share(df, "host", "priority", "job_id", share).select("job_id")) == sorted(want)
    assert cap.cap_share(df.limit(0), "host", "priority", "job_id", share).count() == 0


# ---- frequent items ----


@pytest.mark.parametrize(("share", "hashes"), [("0.05", 3), ("0.3", 1), ("1", 2)])
def test_frequent_items(spark, share, hashes):
    rnd = random.Random(9)
    data = [(rnd.choice(["hot", "hot", "", None, *(f"k{i}" for i in range(40))]), rnd.choice([None, -4, 0, 1, 3])) for _ in range(2000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "url string, w long, n int, item string")
    for weight in (None, "w"):
        sums = Counter()
        for u, w in data:
            if u is not None:
                sums[u] += 1 if weight is None else max(w or 0, 0)
        want = sorted((u, n) for u, n in sums.items() if n >= Fraction(share) * sums.total())
        got = heavy.frequent_items(df, "url", share, weight, hashes).collect()
        assert sorted((r.item, r.n) for r in got) == want and all(r.estimate >= r.n for r in got)
    assert rows(heavy.frequent_items(df.limit(0), "url", share)) == []
    assert rows(heavy.frequent_items(df.withColumn("w", F.lit(0)), "url", share, "w")) == []


# ---- hidden duplicates ----


def test_canonical_forms(spark):
    same_url = ["http://A.b/x?p=1&q=2", "HTTP://a.B/x/?q=2&&p=1&-", " http:--a-b-x?Q=2&p=1"]
    other = ["http://a.b/x?p=1", "http://a.b/x?p=1&p=1&q=2", "http://ab/x?p=1&q=2", "http://a.b/x&p=1&q=2", "http://a.b/xé?p=1&q=2x", "http://a.b/x?p=1?q=2"]
    df = spark.createDataFrame([(u,) for u in same_url + other], "u string").select(canon.canonical_url(F.col("u")).alias("f"))
    forms = [r.f for r in df.collect()]
    assert len(set(forms[:3])) == 1 and len(set(forms)) == 1 + len(other)
    recs = ["url: a/b; n=1|x", "N 1\tURL=A.B;;\"X\"", "x;n:1;url a b\n", "n=1;x", "url ab;n 1;x", "url a b;n 1;n 1;x"]
    forms = [r[0] for r in spark.createDataFrame([(r,) for r in recs], "r string").select(canon.canonical_record(F.col("r"))).collect()]
    assert len(set(forms[:3])) == 1 and len(set(forms)) == 4


@pytest.mark.parametrize("hot", [0, 2, 1000])
def test_hidden_duplicates(spark, hot):
    texts = ["a b", "A  B", "a b", "a b", None, "", "c", "C.", "d", "k", "\u212a", "?", "!", "\u00e9"]
    df = spark.createDataFrame([(10 + i, t, "x", 1) for i, t in enumerate(texts)], "id long, t string, raw string, n int")
    groups, members = canon.hidden_duplicates(df, "id", "t", canon.runs, hot)
    # the Kelvin sign and the accented letter are no ASCII letters, so they have no runs, like ? and !
    assert rows(groups) == [(10, 4), (16, 2), (20, 4)]
    assert rows(members) == [(10, 11), (10, 12), (10, 13), (16, 17), (20, 21), (20, 22), (20, 23)]
    groups, members = canon.hidden_duplicates(df.limit(0), "id", "t", canon.runs, hot)
    assert rows(groups) == rows(members) == []


# ---- the report's rates ----


def test_report_rates_are_those_of_rows(spark):
    """A hot key counts with all its rows, a total comes out, and absent keys meet as many filters as a generation's."""
    jobs = [(i, "hot" if i % 3 == 0 else f"u{i}") for i in range(3_200)] + [(None, "u1"), (5_000_000, None)]
    df = spark.createDataFrame(jobs, "job_id long, url string")
    history = spark.createDataFrame([(f"old{i}",) for i in range(200)], "key string")
    report = {r.gen: r for r in seen.seen_report(df, history, "job_id", "url", 1).collect()}
    assert set(report) == {None, *range(16)}
    gens = [report[g] for g in range(16)]
    assert all(r.rows == 200 and r.keys < r.rows and r.wrong_rate == r.wrong / r.rows for r in gens)
    total = report[None]
    assert total.rows == 3_200 and total.wrong == sum(r.wrong for r in gens) > 0 and total.wrong_rate == total.wrong / 3_200
    assert gens[0].audit_rate > 0.3 and gens[15].audit_rate > 0.9


def test_p4_found_needs_the_score(spark):
    """Entropies are in the plan that selects, not pruned away."""
    from conftest import DATA

    plan = distinctive.p4_found(spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "LOG2" in plan.upper() and "sum(CASE" in plan and "log2" in plan[plan.index("Aggregate") :].lower()


def test_score_bound_keeps_every_term_of_few_records(spark):
    """The score's bound loses no term of at most so many records, and drops even terms of many."""
    rnd = random.Random(4)
    data = [(0, 0, d, f"t{k}", rnd.choice([-1, 0, 1, 1, 5, 400])) for k in range(1, 25) for d in rnd.sample(range(200), k)] + [(0, 0, d, "all", 3) for d in range(200)]
    scored = distinctive.log_entropy(spark.createDataFrame(data, "core int, db int, doc_id long, term string, cnt long"), 200)
    for most in (1, 3, 10):
        got = distinctive.candidates(scored, 200, most)
        assert rows(got.where(F.col("records") <= most).select("doc_id", "term")) == sorted((d, t) for _, _, d, t, _ in data if t != "all" and int(t[1:]) <= most)
        assert got.where("term = 'all'").count() == 0
    assert distinctive.candidates(scored, 2, 3).count() == distinctive.candidates(scored, 200, 200).count() == len(data)


def test_document_ngrams(spark, tmp_path):
    """Whole texts, whatever their words' script, have their n-grams of up to three words."""
    texts = ["a b a b", "a\tb  é", None, " ", "x " * 5_000 + "last"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.gram: (r.n, r.occurrences, r.records) for r in termfreq.QUERIES["p2_document_ngrams"](spark, str(tmp_path)).collect()}
    assert got["a b"] == (2, 3, 2) and got["a b é"] == (3, 1, 1) and got["x x x"] == (3, 4_998, 1) and got["x x last"] == (3, 1, 1)
