"""Operators on small cases: edges, ties, nulls, empty tables, skew."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.config import DEBUG, PROD, load_config
from quarryline.operators import frontier, index, links, metrics, ordering, rle, robots, scheduling, search, skew, text
from quarryline.operators.hot_keys import dense_reduce


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- per-key results without imbalance ----


def brute_reduce(data):
    out = {}
    for k, v in data:
        if k is None:
            continue
        n, vs = out.setdefault(k, [0, []])
        out[k][0] += 1
        if v is not None:
            vs.append(v)
    return sorted((k, n, len(v), sum(v), min(v, default=None), max(v, default=None)) for k, (n, v) in out.items())


@pytest.mark.parametrize("max_keys", [1, 3, 1 << 18])
def test_dense_reduce(spark, max_keys):
    rnd = random.Random(max_keys)
    data = [(rnd.choice(["hot", "hot", "", "k%d" % rnd.randrange(50), None]), rnd.choice([None, rnd.randrange(-9, 10**15)])) for _ in range(3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "host string, p long, rows int, key string")
    assert rows(dense_reduce(df, "host", ["p"], tasks=3, max_keys=max_keys)) == brute_reduce(data)


def test_dense_reduce_empty(spark):
    df = spark.createDataFrame([], "host string, p long")
    assert rows(dense_reduce(df, "host", ["p"])) == []
    assert rows(dense_reduce(spark.createDataFrame([(None, 1)], "host string, p long"), "host", ["p"])) == []


def test_dense_reduce_is_even(spark):
    """Blocks lie evenly on the tasks of the reduction, and a task sums one block after the other."""
    df = spark.range(0, 100_000, 1, 4).select(F.concat(F.lit("k"), "id").alias("k"))
    sizes = [r["count"] for r in dense_reduce(df, "k", tasks=200).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 200 and sum(sizes) == 100_000 and max(sizes) < 1.5 * 500


def test_dense_reduce_partials_are_few(spark):
    """A key of all rows leaves each split as one row."""
    df = spark.range(0, 100_000, 1, 4).select(F.lit("hot").alias("k"))
    assert rows(dense_reduce(df, "k")) == [("hot", 100_000)]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize(("limit", "most"), [(0, 1000), (2, 1000), (2, 2), (100, 1000), (0, 1)])
def test_lookup_join(spark, how, limit, most):
    big = spark.createDataFrame([(i, k) for i, k in enumerate(["a"] * 7 + ["b", "c", None, "d"])], "i int, k string")
    small = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4), ("z", 9), (None, 0)], "k string, v int")
    assert rows(skew.lookup_join(big, small, "k", limit, how, most).select("i", F.coalesce("v", F.lit(-1)))) == rows(big.join(small, "k", how).select("i", F.coalesce("v", F.lit(-1))))


def test_few_keys_are_broadcast(spark):
    """However low the limit, no more than ``most`` keys are hot, and only those above it."""
    big = spark.range(0, 50_000, 1, 4).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"))
    assert len(skew.hot_hashes(big, "k", 0, 10)) == 1
    assert len(skew.hot_hashes(big, "k", 0, 1_000)) == 501
    assert skew.hot_hashes(big, "k", 20_000, 10) == [] and skew.hot_hashes(big.limit(0), "k", 0) == []


# ---- order and best rows ----


@pytest.mark.parametrize("width", ["1", "5"])
def test_ranked(spark, width):
    rnd = random.Random(7)
    data = [(rnd.choice(["hot", "hot", "b", None, ""]), i, rnd.choice([None, 1, 2])) for i in rnd.sample(range(10_000), 2_000)]
    df = spark.createDataFrame(data, "g string, i long, v int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        order = [F.col("v").desc_nulls_last(), F.col("i").asc()]
        got = {(r.g, r.i): r.n for r in ordering.ranked(df, ["g"], order, "n").collect()}
        best = {(r.g, r.i) for r in ordering.best(df, ["g"], order, 1_001).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {}
    for g in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        want |= {(g, r[1]): n for n, r in enumerate(mine)}
    assert got == want and best == {k for k, n in want.items() if n < 1_001}
    assert ordering.ranked(df.limit(0), ["g"], order, "n").count() == 0


# ---- text and index ----


def page(spark, *htmls):
    return spark.createDataFrame([(i, f"http://a.example/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_sections(spark):
    cases = {
        "<body>One <b>two</b></body>": ["one", "two"],
        "<BODY>One</BODY>": [],
        "<body>lost": [],
        "<body>a<script>b</script>c</body>": ["a", "c"],
        "<head><style>x</style>y<script>z</script></head>": ["y"],
        "<body>naïve &amp; 3d</body>": ["na", "ve", "amp", "d"],
        "": [],
    }
    got = {r.page_id: r.terms for r in text.page_terms(page(spark, *cases)).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert text.page_terms(page(spark, None)).count() == 0


def test_cap(spark):
    r = spark.range(1).select(text.capped(F.lit("aüb"), 2).alias("x"), text.capped(F.lit("abc"), 3).alias("y")).first()
    assert r.x == "a�" and r.y == "abc"


def test_weights_and_lengths(spark):
    df = spark.createDataFrame([(1, 10), (2, 5), (1, 3000)], "c long, n long")
    assert [r[0] for r in df.select(text.weight(F.col("c"), F.col("n"))).collect()] == [255, 255, 0]
    assert [r[0] for r in spark.range(1, 9).select(text.log2_floor(F.col("id"))).orderBy("id").collect()] == [0, 1, 1, 2, 2, 2, 2, 3]


def test_running_number(spark, monkeypatch):
    monkeypatch.setattr(index, "_ID_BLOCK", 7)
    ids = random.Random(1).sample(range(-50, 500), 200)
    df = spark.createDataFrame([(i % 3, i) for i in ids], "c int, i long")
    want = sorted((c, i, n) for c in range(3) for n, i in enumerate(sorted(x for x in ids if x % 3 == c)))
    assert rows(index.running_number(df, "c", "i", "n").select("c", "i", "n")) == want


def test_index_on_disk(spark, tmp_path):
    html = "<body>" + "alpha beta gamma delta " * 60 + "</body>"
    docs, postings = index.build_index(page(spark, *[html] * 7), DEBUG)
    index.write_index(docs, postings, str(tmp_path))
    d, p = index.read_index(spark, str(tmp_path))
    assert rows(d.select("core", "db", "doc_id", "page_id")) == rows(docs.select("core", "db", "doc_id", "page_id"))
    assert rows(p.select("core", "db", "doc_id", "term", "wt")) == rows(postings.select("core", "db", "doc_id", "term", "wt"))
    merged, urls = index.merge_shards(p, d, 10, DEBUG)
    assert merged.select("doc_id").distinct().count() == urls.count() == 7


# ---- search against a literal model of the byte arithmetic ----


def model(shards, words, scale, k):
    best = []
    for key, (post, log2) in sorted(shards.items()):
        if not words or any(w not in post for w in words):
            continue
        idfs = []
        for w in words:
            norm = sum(x > 0 for x in post[w].values()) * 65536 // scale
            idfs.append(1 << (norm.bit_length() // 2))
        ridf = [i // min(idfs) for i in idfs]
        total = sum(max(post[w].values()) // r for w, r in zip(words, ridf))
        den = total // 255 + 1
        shift = [(r * den - 1).bit_length() for r in ridf]
        for doc in set.intersection(*(set(post[w]) for w in words)):
            parts = [post[w][doc] >> s for w, s in zip(words, shift)]
            if all(parts) and log2[doc] >= 8:
                best.append((-sum(parts), *key, doc))
    return [(-s, c, d, i) for s, c, d, i in sorted(best)[:k]]


@pytest.mark.parametrize("seed", range(3))
def test_search(spark, seed):
    rnd = random.Random(seed)
    shards, post_rows, doc_rows = {}, [], []
    for c in range(2):
        for d in range(2):
            log2 = {i: rnd.choice([7, 8, 9]) for i in range(40)}
            post = {t: {i: rnd.choice([0, 1, 3, 40, 255]) for i in range(40) if rnd.random() < p} for t, p in (("a", 0.9), ("b", 0.4), ("c", 0.05))}
            post = {t: x for t, x in post.items() if x}
            shards[c, d] = post, log2
            doc_rows += [(c, d, i, f"u{i}", x) for i, x in log2.items()]
            post_rows += [(c, d, i, t, w) for t, x in post.items() for i, w in x.items()]
    docs = spark.createDataFrame(doc_rows, "core int, db int, doc_id long, url string, log2_terms int")
    postings = spark.createDataFrame(post_rows, "core int, db int, doc_id long, term string, wt int")
    texts = {1: "a", 2: "A b", 3: "b  a a", 4: "c b a", 5: "zz a", 6: "", 7: " \t"}
    cfg = PROD.__class__(shard_size=40, top_k=5)
    got = search.search(postings, docs, search.queries_table(spark, texts), cfg).orderBy("query_id", "pos").collect()
    for q, t in texts.items():
        assert [(r.score, r.core, r.db, r.doc_id) for r in got if r.query_id == q] == model(shards, t.lower().split(), 40, 5), t
    assert max([r.score for r in got], default=0) <= 255


# ---- links, robots, frontier ----


LONG = "<body>" + "word " * 200 + "</body>"


def test_trap_page_loses_all_links(spark):
    html = "<a href='/ok'><a href=\"/a/b/a/b/c\">"
    three = "<a href='/ok'><a href='/ok'><a href='https://b.example/x'>"
    assert rows(links.page_links(page(spark, LONG + html, LONG + three, None)).select("page_id", "source", "url", "cross")) == [
        (1, "http://a.example/1", "http://a.example/ok", False), (1, "http://a.example/1", "http://a.example/ok", False), (1, "http://a.example/1", "https://b.example/x", True)
    ]
    assert rows(links.trap_pages(page(spark, html, three, None))) == [(0,)]


def test_links_of_indexed_pages_only(spark):
    """A page too short to index hands on no links (F10), nor does what lies beyond the bytes that are read."""
    link = "<a href='/x'>"
    short, enough = "<body>" + "word " * 199 + "</body>" + link, "<body>" + "word " * 200 + "</body>" + link
    late = LONG + "<p>" + "é" * 130_000 + link
    lost = "<body>" + "<p>é" * 64_000 + "word " * 200 + "</body>"
    df = page(spark, short, enough, late, lost, LONG + link + "é" * 130_000)
    assert rows(links.page_links(df).select("page_id")) == [(1,), (4,)]
    assert rows(links.page_links(df, PROD.__class__(min_n_tokens=0, max_document_len=10**6)).select("page_id")) == [(0,), (1,), (2,), (4,)]


def test_links_need_a_domain(spark):
    df = spark.createDataFrame([(1, "http://1.2.3.4/", LONG + "<a href='/x'>"), (2, None, LONG + "<a href='/x'>"), (3, "", "")], "page_id long, url string, html string")
    assert rows(links.page_links(df)) == []


def test_legacy_links(spark):
    html = "<a href='http://b.edu/x?q'><a href='http://c.ac/x.xml'><a href='http://c.ac.uk/y'><a href='/a/b/a/b/c'><a href='http://b.edu/x'><a href='/z.css'>"
    df = spark.createDataFrame([(1, "http://a.edu/", html), (2, "http://a.example/", html), (3, "http://u.edu.test/", html)], "page_id long, url string, html string")
    assert rows(links.legacy_links(df, 7).select("url")) == [("http://a.edu/a/b/a/b/c",), ("http://b.edu/x",), ("http://c.ac/x.xml",)]
    assert "http://u.edu.test/a/b/a/b/c" in {r.url for r in links.legacy_links(df, 7, name=links.unreserved).collect()}


def test_legacy_terms(spark):
    df = page(spark, "a<body x>One<script>two</script></body>three<b>", "<BODY>x", None, "<body>")
    assert {r.page_id: r.terms for r in text.legacy_terms(df).collect()} == {0: ["one", "two", "three"], 3: []}


def test_legacy_robots(spark):
    body = "User-agent: *\nDisallow: /a\n"
    files = spark.createDataFrame([("h", body), ("long", body + "#" * 256_000)], "host string, body string")
    bad = spark.sql("SELECT 'bad' AS host, cast(concat(cast('User-agent: *\nDisallow: /a\n' AS BINARY), X'ff') AS STRING) AS body")
    assert rows(robots.legacy_rules(files.union(bad), "host", "body")) == [("h", "/a")]


def test_robots(spark):
    body = "User-agent: Other\nDisallow: /no1\nUser-agent: *\r\nDisallow: /a\r\nDisallow:/no2\nAllow: /a/b\ndisallow: /no3\nDisallow: \nUser-agent: Rustbot/2\nDisallow: /b c\nUser-agent: X\nUser-agent: Y\nDisallow: /no4"
    files = spark.createDataFrame([("h", body), ("h", None), (None, body), ("e", "")], "host string, body string")
    rules = robots.robots_rules(files, "host", "body")
    assert rows(rules) == [("h", "/a"), ("h", "/b")]
    urls = spark.createDataFrame([(1, "h", "/a/b"), (2, "h", "/A"), (3, "h", "/bc"), (4, "x", "/a"), (5, None, "/a")], "i int, host string, path string")
    for hot in (0, 100):
        assert rows(robots.allowed(urls, rules, hot).select("i", "allowed")) == [(1, False), (2, True), (3, False), (4, True), (5, True)]


def test_frontier(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3), ("a", 4)], "url string, inc long")
    pri = frontier.priorities(df)
    one = DEBUG.__class__(n_queues=1, page_capacity=2)
    popped = frontier.pop_order(pri, one)
    assert [r.url for r in popped.orderBy("rk").collect()] == ["a", "c", "b"]
    assert rows(frontier.split_pages(pri, one).select("url", "page")) == [("a", 0), ("b", 0), ("c", 1)]
    assert rows(frontier.pop_order(pri.withColumn("popped", F.col("url") == "a"), one, first=1).select("url")) == [("c",)]
    half = frontier.split_pages(pri.withColumn("popped", F.when(F.col("url") == "c", True)), one)
    assert rows(frontier.page_values(half)) == [(0, 0, "a", 2, 5), (0, 1, "c", 1, 0)]
    seen = spark.createDataFrame([("a",), (None,)], "url string")
    assert rows(frontier.unseen(pri, seen).select("url")) == [("b",), ("c",)]


@pytest.mark.parametrize("width", ["1", "4"])
def test_url_pages(spark, width):
    """Urls fall into the page whose interval holds them, whatever partition its bound lies in."""
    rnd = random.Random(3)
    urls = [(q, f"u{n:04}", 1) for q in (0, 1, 3) for n in rnd.sample(range(3_000), 400)]
    ranges = []
    for q in (0, 1):
        cuts = sorted(f"u{n:04}" for n in rnd.sample(range(3_000), 9))
        ranges += [(q, i, a, z) for i, (a, z) in enumerate(zip([None, *cuts], [*cuts, None])) if i != 4]  # a gap
    df = spark.createDataFrame(urls, "queue int, url string, priority long")
    bounds = spark.createDataFrame(ranges, "queue int, page long, lower string, upper string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        got = rows(frontier.url_pages(df, bounds))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == sorted((q, u, p, i) for q, u, p in urls for r, i, a, z in ranges if r == q and (a is None or u >= a) and (z is None or u < z))


def test_frontier_plans(spark):
    """Pages and lookups are made without a window over a queue and without an inequality join."""
    df = spark.createDataFrame([("a", 1)], "url string, priority long")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    pages = frontier.split_pages(df)
    assert "NestedLoop" not in plan(pages) and "Window [row_number" not in plan(pages)
    ranges = frontier.page_values(pages).select("queue", "page", "lower", F.lit(None).cast("string").alias("upper"))
    found = plan(frontier.url_pages(pages.select("queue", "url", "priority"), ranges))
    assert "NestedLoop" not in found and "Cartesian" not in found


def model_crawl(links_of, roots, rounds, per_queue, queue):
    cnt, popped, jobs = dict(roots), set(), []
    for n in range(rounds):
        now = []
        for q in sorted({queue(u) for u in cnt}):
            waiting = sorted(((c, u) for u, c in cnt.items() if u not in popped and queue(u) == q), reverse=True)
            now += [(n, q, u, c) for c, u in waiting[:per_queue]]
        jobs += now
        popped |= {u for _, _, u, _ in now}
        for _, _, u, _ in now:
            for v in links_of.get(u, []):
                cnt[v] = cnt.get(v, 0) + 1
    return sorted(jobs), sorted((u, c, u in popped) for u, c in cnt.items())


def test_crawl(spark):
    """Pops feed the next round; a popped url counts on and never comes out again."""
    import hashlib

    rnd = random.Random(2)
    links_of = {f"http://a.example/{i}": [f"http://a.example/{rnd.randrange(40)}" for _ in range(5)] for i in range(30)}
    df = spark.createDataFrame([(i, u + "?q=1#f", LONG + "".join(f"<a href='{v}'>" for v in vs)) for i, (u, vs) in enumerate(links_of.items())], "page_id long, url string, html string")
    roots = [("http://a.example/3", 2), ("http://a.example/7", 2), ("http://a.example/9", 1)]
    cfg = PROD.__class__(n_queues=2)
    jobs, left = frontier.crawl(df, spark.createDataFrame(roots, "url string, inc long"), 4, 2, cfg)
    queue = lambda u: int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % 2
    assert (rows(jobs), rows(left)) == model_crawl(links_of, roots, 4, 2, queue)


def test_workers(spark):
    recent = spark.createDataFrame([("h", 5), ("h", 2), ("h", 2), ("g", 5), ("e", 5), (None, 1), ("n", None)], "host string, tid int")
    loads = spark.createDataFrame([(5, 249), (2, 250), (9, 9)], "tid int, waiting long")
    hosts = spark.createDataFrame([("h",), ("g",), ("x",), ("n",), (None,), ("h",)], "host string")
    assert rows(scheduling.assign_workers(hosts, recent, loads)) == [("g", 5, "local"), ("h", 5, "local"), ("n", 9, "idle"), ("x", 9, "idle")]
    full = spark.createDataFrame([(5, 250), (2, 250), (9, 10)], "tid int, waiting long")
    assert rows(scheduling.assign_workers(hosts, recent, full).select("host", "kind")) == [("g", "stashed"), ("h", "stashed"), ("n", "stashed"), ("x", "stashed")]


# ---- runs, metrics, config ----


def model_segments(weights, least):
    """The codec's steps: gaps of ``least`` are runs, shorter ones single zeros; runs shorter than ``least`` go to the literal."""
    out, literal, run, size = [], [], [], 0

    def sync():
        nonlocal literal, run
        if literal:
            out.append((len(literal), None, literal))
        if run:
            out.append((len(run), run[0], None))
        literal, run = [], []

    def push(x):
        nonlocal run
        if run and run[-1] != x:
            if len(run) < least:
                literal.extend(run)
                run = []
            else:
                sync()
        run.append(x)

    def flush():
        nonlocal run
        if len(run) < least:
            literal.extend(run)
            run = []
        sync()

    for at, w in sorted(weights.items()):
        if at - size < least:
            for x in [0] * (at - size) + [w]:
                push(x)
        else:
            flush()
            out.append((at - size, 0, None))
            run.append(w)
        size = at + 1
    flush()
    firsts = [sum(n for n, *_ in out[:i]) for i in range(len(out))]
    return [(i, a, *x) for i, (a, x) in enumerate(zip(firsts, out))]


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(0, 2), min_size=1, max_size=45), st.integers(1, 6))
def test_segments(spark, weights, least):
    df = spark.createDataFrame([(0, 0, "t", d, w) for d, w in weights.items()], "core int, db int, term string, doc_id long, wt int")
    segs = rle.encode_segments(df, least)
    assert [tuple(r) for r in segs.orderBy("seg").select("seg", "first_doc", "len", "wt", "literal").collect()] == model_segments(weights, least)
    assert rows(rle.decode_segments(segs).select("doc_id", "wt")) == sorted((d, w) for d, w in weights.items() if w)


def test_log_jobs(spark):
    body = "00:42:40.114 [core00/x] fetched http://a.example/x \r\n00:42:40.114 [core07/x] not html: http://b.example/y -> 404\nnoise\n00:42:40.114 [core01/x] timeout on https://c.example/z 5468ms"
    df = spark.createDataFrame([(1, body), (2, None), (3, "")], "d long, t string")
    assert rows(metrics.log_jobs(df, "d", "t").na.fill(-1)) == [
        (1, 0, 0, "fetched", "http://a.example/x", 200, -1), (1, 1, 7, "not html", "http://b.example/y", 404, -1), (1, 3, 1, "timeout", "https://c.example/z", 200, 5468)
    ]


def test_pop_counts(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("c", 2)], "url string, priority long")
    assert rows(metrics.pop_counts(df, F.when(F.col("url") == "c", 2).otherwise(0), 3, 2)) == [(0, 2, 2, 0, 6), (1, 2, 0, 2, 0), (2, 2, 1, 1, 2)]


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(0, 3), max_size=40))
def test_runs_round_trip(spark, weights):
    df = spark.createDataFrame([(0, 0, "t", d, w) for d, w in weights.items()], "core int, db int, term string, doc_id long, wt int")
    runs = rle.posting_runs(df)
    assert rows(rle.decode_runs(runs).select("doc_id", "wt")) == sorted((d, w) for d, w in weights.items() if w)
    starts = {(r.first_doc, r.wt) for r in runs.collect()}
    assert len(starts) == sum(w and weights.get(d - 1) != w for d, w in weights.items() if w)


def test_metrics(spark):
    df = spark.createDataFrame([(200, "text/html; x"), (404, "image/png"), (None, None)], "s int, t string")
    got = df.select(metrics.http_success(F.col("s")), metrics.content_is_html(F.col("t")), metrics.oversize(F.lit(None).cast("long"))).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (False, False, False), (None, True, False)]
    zero = metrics.ratios(spark.createDataFrame([(0, 0, 0, 0, 0)], "completed long, successful long, skipped long, failed long, ms long")).first()
    assert zero.pct_failed is None and zero.ms_per_success is None
    checks = spark.createDataFrame([("a",), ("a",), ("b",)], "host string")
    assert rows(metrics.robots_hits(checks, "host")) == [(3, 1)]
    assert 0 < metrics.sampled(spark.range(10_000), 0.1).count() < 2_000
    snaps = spark.createDataFrame([(1, 5), (2, 9)], "t int, c long")
    assert [r.d_c for r in metrics.deltas(snaps, "t", ["c"]).orderBy("t").collect()] == [5, 4]


def test_config(monkeypatch):
    monkeypatch.setenv("CRAWLER_DIR", "/x")
    assert load_config().root == "/x" and load_config(debug=True).index_cap == 100 and PROD.max_url_len == 250


# ---- whole results, whatever the size ----


def test_whole_frontier_is_popped(spark):
    """Queues of more than 20 and frontiers of more than 500 urls come out whole, queues in turn."""
    pri = spark.createDataFrame([(f"http://h.example/{i}", i % 7) for i in range(700)], "url string, priority long")
    two = DEBUG.__class__(n_queues=2)
    order = [tuple(r) for r in frontier.round_robin(frontier.pop_order(pri, two)).collect()]
    assert len(order) == 700 and [r[:2] for r in order] == sorted(r[:2] for r in order)
    for q in (0, 1):
        mine = [(p, u) for _, k, u, p in order if k == q]
        assert len(mine) > 20 and mine == sorted(mine, reverse=True)


def test_whole_frontier_queries(spark):
    from quarryline.plans import frontier as plans

    from conftest import DATA

    urls = rows(plans.frontier_priority(spark, str(DATA)).select("url"))
    for name in ("frontier_pop_order_all", "frontier_round_robin_all"):
        assert rows(plans.QUERIES[name](spark, str(DATA)).select("url")) == urls


def test_merge_of_more_shards_than_a_core_has_room_for(spark):
    """Documents of different shards keep different ids, however many shards a core has."""
    at = [(c, d, i) for c in range(2) for d in (0, 1, 2, 5) for i in range(3)]
    docs = spark.createDataFrame([(*k, f"u{k}", 8) for k in at], "core int, db int, doc_id long, url string, log2_terms int")
    postings = spark.createDataFrame([(*k, str(k), 1) for k in at], "core int, db int, doc_id long, term string, wt int")
    cfg = DEBUG.__class__(index_cap=3)
    merged, urls = index.merge_shards(postings, docs, 2, cfg)
    assert merged.select("doc_id").distinct().count() == urls.select("doc_id").distinct().count() == len(at)
    assert rows(merged.select("doc_id")) == rows(urls.select("doc_id"))
    roomy, _ = index.merge_shards(postings, docs, 10, cfg)
    assert rows(roomy.select("doc_id", "term")) == sorted(((c * 10 + d) * 3 + i, str((c, d, i))) for c, d, i in at)
    assert index.merge_shards(postings.limit(0), docs.limit(0), 2, cfg)[0].count() == 0


def test_long_pages_are_read_whole(spark):
    """Terms beyond the fetch step's 256,000 bytes count, as in the SQL."""
    import duckdb

    from quarryline.plans import corpus

    html = "<body>" + "alpha <b>beta</b> é " * 20_000 + "omega " * 50 + "</body>"
    df = page(spark, html, "<body>" + "gamma " * 300 + "</body>")
    assert len(html.encode()) > PROD.max_document_len
    terms = text.page_terms(df)
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [tuple(r) for r in df.collect()])
    sql = lambda name, *cols: sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({corpus.SQL[name]})").fetchall())
    assert (0, "omega", 50) in rows(text.term_counts(terms, "page_id"))
    assert rows(text.term_counts(terms, "page_id")) == sql("term_counts", "page_id", "term", "cnt")
    assert rows(text.doc_lengths(terms)) == sql("doc_lengths", "page_id", "url", "n_terms", "log2_terms")
    assert rows(text.posting_weights(terms)) == sql("posting_weights", "page_id", "term", "cnt", "wt")
    assert rows(text.article_terms(df)) == sql("article_terms", "page_id", "n_article_terms", "n_terms")
    docs, postings = index.build_index(df, corpus.SMALL)
    assert rows(postings.where("term = 'omega'").select("doc_id", "cnt")) == [(0, 50)]


def test_recorded_search_reaches_documents_without_stored_length(spark, tmp_path):
    """A null log2_terms is taken from n_terms, so the document can be a result."""
    from quarryline.plans import corpus

    docs = [(0, 0, 1, 1, "a", 300, None), (0, 0, 2, 2, "b", 255, None), (0, 0, 3, 3, "c", 300, 8), (0, 0, 4, 4, "d", None, None)]
    spark.createDataFrame(docs, "core int, db int, doc_id long, page_id long, url string, n_terms long, log2_terms int").write.parquet(f"{tmp_path}/docs.parquet")
    spark.createDataFrame([(0, 0, i, "x", 9, 90) for i in range(1, 5)], "core int, db int, doc_id long, term string, cnt long, wt int").write.parquet(f"{tmp_path}/postings.parquet")
    spark.createDataFrame([(7, "x")], "query_id long, query_text string").write.parquet(f"{tmp_path}/search_results.parquet")
    got = corpus.QUERIES["search_recorded_all"](spark, str(tmp_path))
    assert rows(got.select("query_id", "pos", "url", "log2_terms")) == [(7, 1, "a", 8), (7, 2, "c", 8)]
