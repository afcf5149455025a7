"""WARC, URL filters, HTML extraction, embedding near-dedup, pipeline."""

import gzip
import hashlib
import math
import os
import random

import numpy as np
import pytest
import reference as ref
from pyspark.sql import functions as F

import corpus_pipeline
from siftstone.llm import embedding_dedup, html_text, mixing, substring_dedup, toxicity, url_filters, warc
from siftstone.llm.queries import ORACLES, QUERIES
from siftstone.session import scratch_path
from siftstone.sources.stores import open_store

PAGES = "page_id long, url string, html string"
BIG = "<p>" + "payload " * 40 + "</p>"
ROWS = [(1, "http://a/x", BIG), (2, "http://b/y", BIG), (0, "http://c/z", BIG + "é漢"), (3, None, None), (4, "no scheme", ""), (5, "http://a/\r\nX: y", "short"), (6, "http://q", "short"), (7, "http://r", "x" * 99), (8, "http://r", "x" * 99), (9, "http://r", "y" * 100), (10, "http://r", "y" * 100), (11, "http://s", "z" * 300_000), (None, "http://t", BIG), (1, "http://a/x", BIG)]


@pytest.fixture(scope="module")
def pages(spark, docs):
    return spark.createDataFrame(ROWS, PAGES).withColumns({"digest": F.lit(1), "payload": F.lit("clash"), "first": F.lit(True), "text": F.lit(0), "host": F.lit(2), "verdict": F.lit(3)})


# WARC


def fields(r):
    return r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)


def test_warc_round_trip(spark, pages):
    archives = warc.write_archives(pages.repartition(3), scratch_path(spark, "warc"))
    assert sum(a.records for a in archives) == len(ROWS)
    expected = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        same = [j for j, _, h in ROWS if j is not None and (h or "").encode() == data]
        first = min(same) if same and len(data) >= warc.LEAST else i
        revisit = first != i
        expected.append((f"urn:page:{i}", "revisit" if revisit else "response", len(data), hashlib.sha256(data).hexdigest(), f"urn:page:{first}" if revisit else None, None if revisit else data))
    whole = sorted(map(fields, warc.read_archives(spark, archives).collect()), key=str)
    assert whole == sorted(expected, key=str)
    for split in (1, 57, 1000, 4096):
        if split == 1:
            archives_ = [a for a in archives if a.size < 3000][:1]
        else:
            archives_ = archives
        some = sorted(map(fields, warc.read_archives(spark, archives_, split).collect()), key=str)
        assert len(some) == sum(a.records for a in archives_) and (split == 1 or some == whole)
    urls = {r.target_uri for r in warc.read_archives(spark, archives).collect()}
    assert "http://a/%0D%0AX: y" in urls and None in urls
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0), scratch_path(spark, "warc"))).count() == 0


def test_every_split_owns_its_records(tmp_path):
    rng = random.Random(1)
    members = [warc.record_bytes(f"urn:page:{k}", None, rng.randbytes(rng.randrange(3000)), "d", None, "now") for k in range(30)]
    decoys = [b"\x1f\x8b\x08 not a member", gzip.compress(b"no header in here"), b"\x1f", b"\x1f\x8b"]
    data = b"".join(m + (decoys[k % 4] if k % 5 == 0 else b"") for k, m in enumerate(members))
    (tmp_path / "a").write_bytes(data)
    for size in (1, 2, 700, 5000, len(data)):
        with open(tmp_path / "a", "rb") as f:
            found = [r for s in range(0, len(data), size) for r in warc.members(f, len(data), s, s + size)] if size > 2 else [r for s in range(0, 2000, size) for r in warc.members(f, len(data), s, s + size)]
        heads = [r.split(b"\r\n")[2] for r in found]
        assert heads == [f"WARC-Record-ID: <urn:page:{k}>".encode() for k in range(len(heads))] and (size <= 2 or len(heads) == 30)


def test_damaged_payload_is_an_error(tmp_path):
    record = gzip.decompress(warc.record_bytes("urn:page:1", None, b"abc" * 50, hashlib.sha256(b"abc" * 50).hexdigest(), None, "now"))
    assert warc.parse_record(record)[5] == 150
    with pytest.raises(warc.CorruptArchive):
        warc.parse_record(record.replace(b"abcabc", b"abcabd", 1))


def test_stale_attempts_are_not_read(spark, pages):
    folder = scratch_path(spark, "warc")
    archives = warc.write_archives(pages, folder)
    root = open_store(folder)[1]
    with open(os.path.join(root, "part-000000-999.warc.gz"), "wb") as f:
        f.write(warc.record_bytes("urn:page:77", None, b"", "", None, "now"))
    assert warc.read_archives(spark, archives).count() == len(ROWS)


# URL filters


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:cut].translate(ref.LOWER)
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for verdict, rule in rules:
        h, p = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, False, "", ""), (len(rule), len(h), verdict == "block", rule, verdict))
    return host, path, best[3] if best else None, best[4] if best else default


URLS = [None, "", "x", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/7", "http://example.com/en/71?x#y", "http://example.com/en/6", "http://badexample.com/en/7", "https://a.b.net/de/8", "http://example.net/de/8", "http://com/en/", "http://com/en", "ftp://org/es/x://y/", "http://É.org/es/", "http://a.org/es/?q", "http://.com/en/", "http://x.com.:80/en/", "http://u@x.com/en/"]


def test_url_verdicts(spark, pages):
    df = spark.createDataFrame([(k % 15, u) for k, u in enumerate(URLS * 2)], "page_id long, url string").withColumns({"path": F.lit(1), "Rule": F.lit(2), **{c: F.lit(4) for c in ("short", "digest", "_key", "_best", "key", "best", "judged", "row", "a.b")}})
    rules = [*url_filters.RULES, ("allow", "org/es/"), ("allow", "b.net/"), ("block", "www.example.com/en/7")]
    for rs in (url_filters.RULES, rules, []):
        got = url_filters.judge(df, rs)
        assert set(got.columns) == {*df.columns, "host", "path", "rule", "verdict"} - {"Rule"}
        assert sorted(map(str, (tuple(r) for r in got.select("page_id", "url", "host", "path", "rule", "verdict").collect()))) == sorted(str((k % 15, u, *judge(u, rs))) for k, u in enumerate(URLS * 2))
    as_table = url_filters.judge(df, spark.createDataFrame([*rules, (None, None)], "verdict string, rule string"))
    assert sorted(map(str, as_table.collect())) == sorted(map(str, url_filters.judge(df, rules).collect()))
    assert url_filters.judge(df.limit(0)).count() == 0


# HTML

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a>Menu</a></ul></nav><div id="cookie-notice">We use cookies</div><div class="sidebarLeft"><p>side</div>
<article><header><h2>Head  line</h2></header><p>One <b>bold</b>wo&shy;rd &amp; &eacute;<p>Two<br>lines<!-- no <p>x</p> --><ul><li>a<li>b</ul>
<div class="ad-slot">buy</div><aside>by the way</aside><form>Name <input></form><table><tr><td>c1<td>c2</table>
<section class="comments"><p>First!</p></section><p hidden>gone</p></article><footer>&copy; 2024</footer></body></html>"""


def test_structure():
    assert html_text.main_text(PAGE, None) == "Head line One boldwo\u00adrd & é Two lines a b c1 c2"
    assert html_text.main_text(None, None) == html_text.main_text("", [1]) == html_text.main_text("<nav>x", None) == ""
    assert html_text.main_text('<div class="content-sidebar-wrap"><p>x</p><article class="post header"><div class="post-header"><h1>T</h1></div>body</article></div>', None) == "T body"
    assert html_text.main_text('<article>body</article><section class="comments"><article>First</article></section>', None) == "body"
    assert html_text.main_text('<article class="comment">no</article><main><p>long enough text</p><article>card</article></main>', None) == "long enough text card"
    assert html_text.main_text('<main><p>teaser</p><article>the whole story is here</article></main>', None) == "the whole story is here"
    assert html_text.main_text("plain &lt;text&gt; <p>a<p>b", None) == "plain <text> a b"
    assert html_text.main_text("<p>open <b>never closed", None) == "open never closed"
    assert html_text.main_text("<p>1 < 2 and 3 > 2</p>", None) == "1 < 2 and 3 > 2"
    assert html_text.main_text("<div>" * 3000 + "deep", None) == "deep"
    assert len(html_text.main_text("<article>" + "<p>word word</p>" * 50_000 + "</article>", None)) == 50_000 * 10 - 1


@pytest.mark.parametrize("tag", ["article", "main"])
def test_structure_keeps_what_an_article_says(tag):
    inside = lambda body: html_text.main_text(f"<body><nav>Menu</nav><{tag}>{body}</{tag}></body>", None)
    for word in ("ad-hoc-queries", "login", "social-history", "navigation", "comments"):
        assert inside(f"<h2 id='{word}'>Title</h2><p id='{word}'>text</p>") == "Title text"
        assert inside(f'<h3 class="{word}">Title</h3><div id="{word}">text</div>') == "Title text"
    assert inside("<section id='related-work'><h2>Related work</h2><p>Others</p></section>") == "Related work Others"
    assert inside('<section class="related-work">Others</section><div class="ad-hoc">query</div>') == "Others query"
    assert inside('<pre><span class="comment"># note</span> x = <span class="hljs-comment">1</span></pre>') == "# note x = 1"
    assert inside("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>") == "Let x=1 be"
    for mark in ("ad", "advert", "comments", "ad-slot", "adSlot", "wide comment-list", "newsletter-signup", "sidebarLeft", "ad-300x250"):
        assert inside(f'<p>kept</p><div class="{mark}">gone</div>') == "kept"
    # outside of an article, words in ids and classes mark boilerplate as before
    assert html_text.main_text('<div id="cookie-notice">gone</div><span class="ad-hoc">gone</span><p>kept</p>', None) == "kept"


@pytest.mark.parametrize("seed", range(30))
def test_common_lines_are_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    got = [x for x, k in zip(a, html_text.common(a, b), strict=True) if k]
    assert len(got) == table[-1][-1]
    rest = iter(b)
    assert all(x in rest for x in got)


def test_differencing_pairs_nearest_paths(spark, docs):
    page = lambda body: f"<body><p>Welcome to the site</p>{body}<p>All rights kept</p></body>"
    rows = [(k, f"http://h.com/news/{k:03d}", page(f"<p>Story {k}</p>")) for k in range(40)]
    rows += [(100, "http://other.com/a", page("<p>alone</p>")), (101, "http://h.com/news/000", page("<p>Story 0</p>")), (102, None, page("<p>x</p>")), (103, "http://h.com/shop/1", "<p>Shop one</p><p>Buy</p>"), (104, "http://h.com/shop/2", "<p>Shop two</p><p>Buy</p>"), (105, "http://h.com/z", "<article><p>Buy</p></article><p>Buy</p>"), (None, "http://h.com/news/001", None)]
    frame = spark.createDataFrame(rows, PAGES).withColumns({"html2": F.lit("k"), "Text": F.lit(1), **{c: F.lit(2) for c in ("host", "path", "place", "row", "lines", "plain", "same", "neighbour", "_host", "_neighbour", "a.b")}})
    done = html_text.extract(frame.repartition(5))
    assert done.columns == [*(c for c in frame.columns if c not in ("html", "Text")), "text", "n_chars"]
    got = {(r.page_id, r.url): (r.text, r.n_chars, r.html2) for r in done.collect()}
    assert len(got) == len(rows)
    for k in range(40):
        assert got[(k, f"http://h.com/news/{k:03d}")] == (f"Story {k}", len(f"Story {k}"), "k")
    assert got[(100, "http://other.com/a")][0] == "Welcome to the site alone All rights kept"
    assert got[(103, "http://h.com/shop/1")][0] == "Shop one" and got[(104, "http://h.com/shop/2")][0] == "Shop two"
    assert got[(105, "http://h.com/z")][0] == "Buy" and got[(None, "http://h.com/news/001")][0] == ""
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_differencing_within_a_path_and_without_urls(spark, docs):
    page = lambda body: f"<body><p>Welcome to the site</p>{body}<p>All rights kept</p></body>"
    rows = [(k, f"http://q.com/index.php?id={k}", page(f"<p>Item {k}</p>")) for k in range(600)]
    rows += [(1000 + k, None, page(f"<p>Lost {k}</p>")) for k in range(5)] + [(1010 + k, f"no-scheme/{k}", page(f"<p>Odd {k}</p>")) for k in range(5)]
    # re-crawls, of one address and under several, and another page far behind them
    rows += [(2000 + k, "http://r.com/a", page("<p>Again</p>")) for k in range(3)] + [(2010 + k, f"http://r.com/b{k:03d}", page(f"<p>Again</p><!-- {k} -->")) for k in range(300)]
    rows += [(3000, "http://r.com/c", page("<p>Other</p>")), (3001, "http://s.com/?a", page("<p>Same</p>")), (3002, "http://s.com/?b", page("<p>Same</p>"))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES).repartition(5)).collect()}
    assert len(got) == len(rows)
    assert all(got[k] == f"Item {k}" for k in range(600))
    assert all(got[1000 + k] == f"Lost {k}" and got[1010 + k] == f"Odd {k}" for k in range(5))
    assert {got[k] for k in (*range(2000, 2003), *range(2010, 2310))} == {"Again"} and got[3000] == "Other"
    assert got[3001] == got[3002] == "Welcome to the site Same All rights kept"


def test_differencing_decides_what_is_unmarked(spark, docs, monkeypatch):
    page = lambda k: f"<body><p>Shop of things</p><h1>Title {k}</h1><article><p>Story {k}</p><p>Licence</p></article><p>Imprint</p></body>"
    frame = spark.createDataFrame([(k, f"http://h.com/{k}", page(k)) for k in range(20)], PAGES)
    assert {r.page_id: r.text for r in html_text.extract(frame).collect()} == {k: f"Title {k} Story {k} Licence" for k in range(20)}
    # without pairs nothing shows which unmarked lines are the page's own
    monkeypatch.setattr(html_text, "_paired", lambda pages: pages.select("host", "path", "same", F.col("plain").alias("neighbour")).limit(0))
    assert {r.page_id: r.text for r in html_text.extract(frame).collect()} == {k: f"Story {k} Licence" for k in range(20)}


def test_differencing_reads_marked_pages_too(spark, docs, monkeypatch):
    cards = "<article>Card of another story, long enough to outweigh this one</article><article>And one more of them</article>"
    rows = [(k, f"http://h.com/{k}", f"<nav>Menu {k}</nav><main><p>Story {k} in its own words, told at some length</p>{cards}</main>") for k in range(20)]
    # near copies of an article, equal pages, a page without a pair and pages without lines
    rows += [(100 + k, f"http://n.com/{k}", f"<main><p>Path {k}</p><article><p>One passage that stands on every page of this host</p><p>Of {k}</p></article></main>") for k in range(5)]
    rows += [(200 + k, f"http://c.com/{k}", "<article>Copy</article>") for k in range(5)] + [(300, None, "<article>Alone</article>")]
    rows += [(400 + k, "http://e.com/", (None, "", "<nav>Menu</nav>")[k % 3]) for k in range(6)]
    paired, seen = html_text._paired, []
    monkeypatch.setattr(html_text, "_paired", lambda pages: seen.append(pages.count()) or paired(pages))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES).repartition(5)).collect()}
    assert seen == [len(rows) - 6] and len(got) == len(rows)
    assert {got[k] for k in range(20)} == {f"Story {k} in its own words, told at some length Card of another story, long enough to outweigh this one And one more of them" for k in range(20)}
    assert all(got[100 + k] == f"One passage that stands on every page of this host Of {k}" and got[200 + k] == "Copy" for k in range(5))
    assert got[300] == "Alone" and all(got[400 + k] == "" for k in range(6))


def test_long_urls_and_repeated_pages(spark, docs):
    rows = [(k, "http://h.com/" + "p" * 40_000 + f"/{k % 60}", f"<p>Top</p><p>Own {k % 60}</p>") for k in range(100)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert got == {k: f"Own {k % 60}" for k in range(100)}
    pairs = [("", ""), ("abc", "abd"), ("漢字x", "漢字y"), ("same", "same"), ("a", "abc"), ("x", "y"), ("k" * 70_000 + "a", "k" * 70_000 + "b")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(html_text.shared_length(F.col("a"), F.col("b"))).collect()]
    assert got == [len(os.path.commonprefix(p)) for p in pairs]


# embeddings


def cosine_groups(rows, threshold=0.95):
    vectors = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            vectors[k] = np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))
    u, links = ref.Union(), [0] * len(rows)
    for a in vectors:
        for b in vectors:
            if a < b and len(vectors[a]) == len(vectors[b]) and vectors[a] @ vectors[b] >= threshold:
                links[a] += 1
                links[b] += 1
                u.join(a, b)
    parts = ref.grouped((u.find(k), rows[k][0]) for k in range(len(rows)))
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in parts.items()}
    return sorted(((rows[k][0], links[k], least[u.find(k)] if k in vectors else rows[k][0]) for k in range(len(rows))), key=str)


def test_near_vectors_against_brute_force(spark, docs):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = [(int(k), (b + rng.normal(0, s, 16)).tolist()) for k, (b, s) in enumerate((b, s) for b in base for s in (0.0, 0.05, 0.15, 0.3))]
    rows += [(1000 + k, rows[0][1]) for k in range(30)] + [(2000, [0.0] * 16), (2001, None), (2002, []), (2003, [1.0, None]), (2004, [float("nan")] * 16), (2005, [float("inf")] * 16), (2006, [1e-30] * 16), (2007, [1e30] * 16), (2008, [1.0]), (2009, [3.0]), (2010, [-1.0]), (None, rows[0][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "node": F.lit("x")})
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == cosine_groups(rows)
    assert all(r.kept == (r.component_id is None or r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_large_buckets_are_compared_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(k, (np.ones(8) + rng.normal(0, 0.02, 8)).tolist()) for k in range(150)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(149, 0)}


def test_recall_at_the_threshold():
    for n in (10, 10**4, 10**6, 10**9):
        signs, tables = embedding_dedup.hash_shape(n)
        met = (1 - math.acos(0.95) / math.pi) ** signs
        assert 1 - (1 - met) ** tables >= 0.999


# queries and pipeline


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    import test_entry

    df = QUERIES[name](spark, sf)
    r = test_entry.duck(sf).execute(ORACLES[name])
    names = sorted(d[0] for d in r.description)
    assert names == sorted(df.columns)
    at = [[d[0] for d in r.description].index(n) for n in names]
    expected = sorted(repr(test_entry.plain([x[k] for k in at])) for x in r.fetchall())
    assert sorted(repr(test_entry.plain(list(x))) for x in df.select(*names).collect()) == expected


def test_pipeline_stages(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    start = spark.read.parquet(f"{sf}/documents.parquet")
    df, seen = start, {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, df, sf).write.parquet(path)
        seen[name] = (df, spark.read.parquet(path))
        df = seen[name][1]
        if name != "packing":
            assert df.dtypes == start.dtypes
    before, after = seen["toxicity"]
    model = toxicity.train(before, labels.where(~toxicity.is_held_out()))
    assert sorted(map(tuple, after.collect())) == sorted(tuple(r)[:5] for r in toxicity.score(before, model).where("predicted = 0").collect())
    before, after = seen["jaccard"]
    groups = ref.jaccard_groups([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    before, after = seen["substring_dedup"]
    rows = before.collect()
    cut = {r.doc_id: x[2] for r, x in zip(rows, ref.without_repeats([r.text for r in rows]), strict=True)}
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {i: (t, len(t)) for i, t in cut.items()}
    before, after = seen["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.plan(before).collect()}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    before, after = seen["packing"]
    assert {r.doc_id: r.n for r in before.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {r.doc_id: r.n for r in after.groupBy("doc_id").agg((F.sum("length") / F.max("doc_tokens")).cast("long").alias("n")).collect()}
    whole = corpus_pipeline.run(spark, sf)
    pieces = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, whole.select(*pieces).collect())) == sorted(map(tuple, after.select(*pieces).collect()))


def test_pipeline_of_awkward_documents(spark, docs, no_docs, tmp_path):
    spark.createDataFrame([(3, 0, 0), (7, 1, 0), (10, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for df in (docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            path = scratch_path(spark, name)
            stage(spark, df, str(tmp_path)).write.parquet(path)
            df = spark.read.parquet(path)
    assert substring_dedup.remove_repeats(docs).count() == docs.count()
