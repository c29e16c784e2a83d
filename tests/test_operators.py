"""Small cases worked out by hand."""

import os

import pytest

from pyspark.sql import functions as F
from skeinquery.functions import text as T
from skeinquery.functions import urls as U
from skeinquery.operators import crawl, graph, index, search
from skeinquery.plans import web
from skeinquery.sources import readers, sinks
from skeinquery.sources.shared import shared_path
from skeinquery.streaming import frontier

DOCS = [("d1", "cat dog cat"), ("d2", "dog fish"), ("d3", "dog")]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


@pytest.fixture(scope="module")
def weights(spark):
    return index.tfidf(index.term_freq(spark.createDataFrame(DOCS, "docid string, contents string"))).cache()


@pytest.fixture(scope="module")
def ranks(spark):
    return spark.createDataFrame([("d1", 0.5), ("d2", 1.0)], "node string, rank double")


def test_tfidf(weights):
    got = {(r.word, r.docid): (r.tf, r.corpus_freq, r.normalized_tf, r.idf_count, round(r.idf, 6), round(r.tfidf, 6)) for r in weights.collect()}
    assert got == {
        ("cat", "d1"): (2, 2, 1.0, 1, 1.584963, 1.584963),
        ("dog", "d1"): (1, 3, 0.75, 3, 0.0, 0.0),
        ("dog", "d2"): (1, 3, 1.0, 3, 0.0, 0.0),
        ("dog", "d3"): (1, 3, 1.0, 3, 0.0, 0.0),
        ("fish", "d2"): (1, 1, 1.0, 1, 1.584963, 1.584963),
    }


@pytest.mark.parametrize("hot", [1, 100])
def test_chunks(weights, hot):
    got = {(r.word, r["rank"]): [d.docid for d in r.doc_list] for r in index.postings_chunked(weights, 2, hot).collect()}
    assert got == {("cat", 1): ["d1"], ("dog", 1): ["d3", "d2"], ("dog", 2): ["d1"], ("fish", 1): ["d2"]}


def test_slices_of_common_words_keep_the_order(spark):
    docs = spark.range(400).select(F.col("id").cast("string").alias("docid"), F.concat(F.lit("a "), F.expr("repeat('a ', cast(id % 7 as int))"), F.expr("repeat('b ', cast(id % 5 as int))")).alias("contents"))
    w = index.tfidf(index.term_freq(docs)).cache()
    plain, sliced = ({(r.word, r.place): r.docid for r in index.postings_ranked(w, 50, hot).collect()} for hot in (10_000, 10))
    assert plain == sliced


def near_weights(spark):
    """Shares 1/3 and 0.3335 lie within one step of 1/1024, and "9" comes after "1" by docid."""
    docs = [("1", "a " * 667 + "b " * 2000), ("9", "a b b b"), ("90", "a b b b"), ("5", "b"), (None, "a a b b b")]
    return index.tfidf(index.term_freq(spark.createDataFrame(docs, "docid string, contents string")))


@pytest.mark.parametrize("hot", [1, 100])
def test_slices_go_by_exact_weight(spark, hot):
    got = index.postings_ranked(near_weights(spark), 50, hot).where("word = 'a'").orderBy("place").collect()
    assert [(r.docid, r.place) for r in got] == [(None, 1), ("1", 2), ("90", 3), ("9", 4)]


def test_chunks_go_by_exact_weight(spark):
    got = {(r.word, r["rank"]): [d.docid for d in r.doc_list] for r in index.postings_chunked(near_weights(spark), 2, 1).where("word = 'a'").collect()}
    assert got == {("a", 1): [None, "1"], ("a", 2): ["90", "9"]}


def test_search(spark, weights, ranks):
    postings = index.postings_chunked(weights)
    ask = lambda q, **k: [(r.docid, r.score) for r in search.search_ranked(postings, ranks, q, **k).collect()]
    assert ask("cat") == [("d1", 3.012106)]
    assert ask("Cat CAT") == [("d1", 10.548425)]
    assert ask("cat cat", repeat_mode="linear") == [("d1", 5.524212)]
    assert ask("cat fish") == ask("dog bird") == ask("") == []
    assert ask("dog") == [("d2", 1.0), ("d1", 0.5)]
    assert ask("dog", k=1) == [("d2", 1.0)]
    assert ask("dog", missing_rank=0.0) == [("d2", 1.0), ("d1", 0.5), ("d3", 0.0)]


def test_pagerank(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("b", "c"), (None, "a"), ("a", None)], "src string, dst string")
    got = {r.node: round(r["rank"], 6) for r in graph.pagerank(edges, 1, epsilon=0.0).collect()}
    assert got == {"a": 0.575, "b": 1.0, "c": 1.425}
    assert {r.node: r["rank"] for r in graph.pagerank(edges, 0).collect()} == {"a": 1.0, "b": 1.0, "c": 1.0}
    ten = graph.pagerank(edges, 12, epsilon=0.0, cut_every=5).collect()
    assert abs(sum(r["rank"] for r in ten) - 3) < 1e-9


def test_rounds_move_ranks_only(spark):
    """Edges are read from their buckets; a hub's edges lie in parts; each round shuffles ranks to edges and sums to nodes."""
    edges = spark.range(200).select(F.lit("hub").alias("src"), F.concat(F.lit("n"), "id").alias("dst")).unionByName(spark.range(200).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("hub").alias("dst")))
    nodes, flat, name = graph.deal_edges(edges, 50)
    assert {r.src: r.parts for r in nodes.where("parts > 1").collect()} == {"hub": 4} and flat.where("src = 'hub'").select("part").distinct().count() == 4
    start = nodes.select(F.col("src").alias("node"), F.lit(1.0).alias("rank"))
    out = graph.hand_on(nodes, flat, start, 0.85, 0.0)
    got = {r.node: round(r["rank"], 9) for r in out.collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = graph.hand_on(nodes, flat, start, 0.85, 0.0)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.sql(f"DROP TABLE {name}")
    assert got == {"hub": round(0.15 + 0.85 * 200, 9)} | {f"n{i}": round(0.15 + 0.85 / 200, 9) for i in range(200)}
    scan = next(i for i, line in enumerate(plan.splitlines()) if "Bucketed: true" in line)
    join = max(i for i, line in enumerate(plan.splitlines()[:scan]) if "HashJoin" in line or "MergeJoin" in line)
    assert not any("Exchange" in line for line in plan.splitlines()[join:scan])


def test_an_index_tokenises_once(spark):
    plan = index.postings_chunked(index.tfidf(index.term_freq(spark.createDataFrame(DOCS, "docid string, contents string"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(filter" not in plan and "split(" not in plan


def test_search_reads_on(spark, weights):
    postings = index.postings_chunked(weights, 1)
    ask = lambda **k: [r.docid for r in search.search_and(postings, "dogs", lemma=lambda w: w.removesuffix("s"), **k).orderBy("docid").collect()]
    assert (ask(), ask(chunks=2), ask(chunks=None)) == (["d3"], ["d2", "d3"], ["d1", "d2", "d3"])


def test_pagerank_corner_cases(spark):
    loop = spark.createDataFrame([("x", "x"), ("a", "x")], "src string, dst string")
    assert {r.node: round(r["rank"], 6) for r in graph.pagerank(loop, 1, epsilon=0.0).collect()} == {"x": 1.0}
    assert graph.pagerank(loop, 2).collect() == []
    assert graph.sink_nodes(loop).collect() == []


def test_html(spark):
    html = "<html><head><title>T</title></head><body>a.b<b>X1</b><!-- c --><script>s</script> state-of<p>1112e</p>the</body></html>"
    page = spark.createDataFrame([(1, html), (2, None), (3, "<p>the cat &amp; I</p>")], "id int, html string")
    got = {r.id: r.contents.split() for r in T.clean_html(page).collect()}
    assert got == {1: ["ab", "X", "state-of"], 2: [], 3: ["the", "cat", "I"]}
    assert {r.id: r.contents.split() for r in T.clean_html(page, scope="token").collect()}[3] == ["cat"]
    assert one(spark, T.html_title(F.col("h")), h=html) == "T"


def test_normalize(spark):
    run = lambda s, **k: one(spark, T.normalized(F.col("s"), **k), s=s)
    assert [run(s) for s in ("  a.b-c\\d ", "1112e", "x1", "[y]")] == ["ab-c\\d", "", "x", ""]
    assert run("a-b!", hyphens=False) == "ab"
    assert run("dogs", lemma=lambda c: F.regexp_replace(c, "s$", "")) == "dog"


def hash32(s):
    h = 0
    for c in s:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def test_hashes(spark):
    assert one(spark, T.java_hash(F.col("s")), s="hello world, hello") == str(hash32("hello world, hello"))
    assert one(spark, T.java_hash(F.col("s")), s="") == "0"
    assert one(spark, T.md5_hex(F.col("s")), s="a") == "0cc175b9c0f1b6a831c399e269772661"


def test_urls(spark):
    run = lambda u: one(spark, U.parsed(F.col("u")), u=u)
    assert tuple(run(" https://h.com:8443/p?q=1")) == ("https", "h.com", 8443, "/p?q=1")
    assert tuple(run("http://H.com")) == ("http", "H.com", 80, "/")
    assert run("https://h.com:x/").port == 443
    assert run("ftp://h/") is None and run("") is None
    assert one(spark, U.base_url(F.col("u")), u="https://h.com:8443/p") == "https://h.com"
    ok = lambda u: one(spark, U.passes_blacklist(F.col("u")), u=u)
    assert [ok(u) for u in ("https://en.wikipedia.org/x", "https://fr.wikipedia.org/x", "https://a.tumblr.com", "", "http://a/")] == [True, False, False, False, True]
    to = lambda h: one(spark, U.resolved(F.lit("http://h:1/a/b?c#d"), F.col("h")), h=h)
    assert [to(h) for h in ("http://x/", "//x/y", "/r", "s", "?t")] == ["http://x/", "http://x/y", "http://h:1/r", "http://h:1/a/s", "http://h:1/a/b?t"]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /a # c\nCrawl-delay: 5\nDisallow:\n\nDisallow: /z"
    own = "User-agent: *\nDisallow: /\n\nuser-agent: Skein\ndisallow: /b:x\nCrawl-delay: x"
    run = lambda t: one(spark, U.robots_rules(F.col("t"), "skein"), t=t)
    assert (run(text).disallowed, run(text).delay) == (["/a"], 5)
    assert (run(own).disallowed, run(own).delay) == (["/b"], None)
    assert run("").disallowed == []
    assert one(spark, U.robots_allow(F.lit("/ab"), F.col("d")), d=["/x", "/a"]) is False
    visits = spark.createDataFrame([("a", 0, 0), ("b", 1000, 5), ("c", 4000, 5), ("d", None, 5)], "domain string, last_ms long, delay_s int")
    assert [r.domain for r in crawl.crawl_delay(visits, 6999).orderBy("domain").collect()] == ["a", "b", "d"]
    assert {r.domain for r in crawl.crawl_delay(visits, 6999).collect()} == {"a", "b", "d"}
    assert {r.domain for r in crawl.crawl_delay(visits, 5999).collect()} == {"a", "d"}


def test_quality_and_fixpoint(spark):
    pages = spark.createDataFrame([("u", "x" * 200 + '<a href="/y">'), ("v", "x" * 300), ("w", '<a href="/y">')], "url string, html string")
    assert [r.url for r in crawl.doc_quality(pages).collect()] == ["u"]
    edges = spark.createDataFrame([("http://a/", "http://b/"), ("http://b/", "http://c/"), ("http://c/", "http://a/"), ("http://b/", "http://x.tumblr.com")], "url string, link string")
    seeds = spark.createDataFrame([("http://a/",)], "url string")
    assert {(r.url, r.depth) for r in crawl.crawl_fixpoint(seeds, edges, 9).collect()} == {("http://a/", 0), ("http://b/", 1), ("http://c/", 2)}


def test_packs_rotate(spark):
    """A pack ends with the document that reaches the limit, and slices by offset give each record back."""
    docs = spark.createDataFrame([(f"{i:032x}", "x" * (37 * i % 90)) for i in range(60)], "id string, contents string")
    path, limit = shared_path(spark, "packs"), 400
    sinks.write_packs(docs, path, 3, limit)
    numbered = readers.packs(spark, path).withColumn("pack", F.regexp_extract("pack", r"pack=(\d+)", 1).cast("long"))
    offsets = sinks.pack_offsets(docs, 3, limit)
    assert {r.id: r.record for r in readers.pack_slice(offsets, numbered).collect()} == {r.id: r.record for r in sinks.pack_records(docs).collect()}
    sizes = {r.pack: len(r.content) for r in numbered.collect()}
    longest = max(r.length for r in offsets.collect())
    assert len(sizes) > 6 and max(sizes.values()) < limit + longest
    assert {r.pack: r.n for r in offsets.groupBy("pack").agg(F.sum("length").alias("n")).collect()} == sizes


def test_packs(spark):
    docs = spark.createDataFrame([(f"{i:032x}", f"text {i}\nmore*") for i in range(20)] + [("f" * 32, None)], "id string, contents string")
    path = shared_path(spark, "packs")
    sinks.write_packs(docs, path, 3)
    packed = readers.packs(spark, path)
    assert {r.id: r.contents for r in readers.unpack(packed).collect()} == {r.id: (r.contents or "").replace("\n", " ") for r in docs.collect()}
    assert readers.unpack(packed, drop_last=True).count() == 21 - packed.count()
    assert readers.unpack(packed, fuse_lines=True).where("id = '" + "0" * 32 + "'").first().contents == "text 0more*"
    numbered = packed.withColumn("pack", F.regexp_extract("pack", r"pack=(\d+)", 1).cast("long"))
    got = {r.id: r.record for r in readers.pack_slice(sinks.pack_offsets(docs, 3), numbered).collect()}
    assert got == {r.id: r.record for r in sinks.pack_records(docs).collect()}


def test_text_sources_and_sinks(spark, tmp_path):
    ranks = spark.createDataFrame([("a", 0.5)], "node string, rank double")
    sinks.write_rank_text(ranks, str(tmp_path / "r"))
    assert readers.rank_text(spark, str(tmp_path / "r")).collect() == ranks.collect()
    (tmp_path / "seeds").write_text(" http://a/ \n\nhttp://b/\n")
    assert [r.url for r in readers.seeds(spark, str(tmp_path / "seeds")).collect()] == ["http://a/", "http://b/"]
    (tmp_path / "t.csv").write_text("docid, url\n1, http://a/\n")
    assert readers.csv_trimmed(spark, str(tmp_path / "t.csv"), "docid string, url string").first().url == "http://a/"
    words = spark.createDataFrame([("b",), ("b",), ("a",)], "word string")
    sinks.append_words(words, str(tmp_path / "w"))
    sinks.append_words(words.limit(1), str(tmp_path / "w"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "w")).collect()) == ["a", "b", "b"]
    posting = spark.createDataFrame([("w", 1.0, [(0.5, "d")])], "word string, idf double, docs array<struct<t:double,d:string>>")
    assert sinks.kv_items(posting).first().item == '{"word":{"S":"w"},"idf":{"N":"1.0"},"docs":{"L":[{"M":{"t":{"N":"0.5"},"d":{"S":"d"}}}]}}'


def test_csv_keeps_values(spark, tmp_path):
    values = [" a", "a ", "\ta,b\n", "\n", "\r\n", "\r", "", " ", None, '"', '""', 'a"\0', "\0", "\\", '\\"', "\u00a0", "null", "#"]
    rows = [(f"{i}", v) for i, v in enumerate(values)] + [("\r", "a"), (" ", ""), ("", None), (None, "b")]
    sinks.write_csv(spark.createDataFrame(rows, "id string, contents string").coalesce(1), str(tmp_path / "csv"))
    assert [tuple(r) for r in readers.csv_quoted(spark, str(tmp_path / "csv")).collect()] == rows
    (tmp_path / "crlf.csv").write_bytes(b'id,contents\r\n1,"a ""b"""\r\n2,\r\n3,""\r\n')
    assert [tuple(r) for r in readers.csv_quoted(spark, str(tmp_path / "crlf.csv")).collect()] == [("1", 'a "b"'), ("2", None), ("3", "")]


def test_csv_query_on_odd_texts(spark, tmp_path):
    texts = ["", " a", "a\n", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.id: r.chars for r in web.scan_csv_quoted(spark, str(tmp_path)).collect()} == {"0": 0, "1": 2, "2": 2, "3": None}


def test_frontier_stream(spark, tmp_path):
    path = str(tmp_path / "requests")
    spark.sql("SELECT * FROM VALUES ('a', 'u1', timestamp '2024-01-01 00:00:00'), ('a', 'u2', timestamp '2024-01-01 00:00:01'), ('b', 'u3', timestamp '2024-01-01 00:00:01'), ('a', 'u4', timestamp '2024-01-01 00:01:00') AS t(domain, url, ts)").write.parquet(path)
    stream = spark.readStream.schema("domain string, url string, ts timestamp").parquet(path)
    start = 1_704_067_200_000
    got = {r.url: r.at_ms - start for r in frontier.run_to_table(frontier.frontier(stream, 5000), "f").collect()}
    assert got == {"u1": 0, "u2": 5000, "u3": 1000, "u4": 60_000}


def test_frontier_keeps_to_robots(spark, tmp_path):
    path = str(tmp_path / "requests")
    spark.sql("SELECT * FROM VALUES ('http://a', 'http://a/x', timestamp '2024-01-01 00:00:00'), ('http://a', 'http://a/no/1', timestamp '2024-01-01 00:00:00'), ('http://a', 'http://a/y', timestamp '2024-01-01 00:00:01'), ('http://b', 'http://b/no/1', timestamp '2024-01-01 00:00:01'), ('http://b', 'http://b/z', timestamp '2024-01-01 00:00:01') AS t(domain, url, ts)").write.parquet(path)
    stream = spark.readStream.schema("domain string, url string, ts timestamp").parquet(path)
    rules = spark.createDataFrame([("http://a", ["/no"], 7)], "domain string, disallowed array<string>, delay int")
    got = {r.url[7:]: r.at_ms - 1_704_067_200_000 for r in frontier.run_to_table(frontier.frontier(stream, 500, rules), "f").collect()}
    assert got == {"a/x": 0, "a/y": 7000, "b/no/1": 1000, "b/z": 1500}


@pytest.mark.parametrize("files", [1, 2, 9])
def test_queued_frontier_does_not_depend_on_batches(spark, tmp_path, files):
    path, start = tmp_path / "requests", 1_704_067_200_000
    rows = [("http://a", f"http://a/{k}", k) for k in range(6)] + [("http://a", "http://a/no/1", 0), ("http://b", "http://b/1", 3), ("http://b", "http://b/2", 3), ("http://c", "http://c/1", 40), ("http://c", "http://c/2", 90)]
    for k in range(0, len(rows), 2):
        df = spark.createDataFrame(sorted(rows, key=lambda r: r[2])[k : k + 2], "domain string, url string, s long")
        df.select("domain", "url", F.timestamp_seconds(F.col("s") + start // 1000).alias("ts")).coalesce(1).write.mode("append").parquet(str(path))
    rules = spark.createDataFrame([("http://a", ["/no"], 20)], "domain string, disallowed array<string>, delay int")
    stream = spark.readStream.schema("domain string, url string, ts timestamp").option("maxFilesPerTrigger", files).parquet(str(path))
    got = [(r.url[7:], (r.at_ms - start) // 1000) for r in frontier.run_to_table(frontier.queued_frontier(stream, 5000, rules), "q").collect()]
    # the newest request is of second 90, so what is due then or later still waits: a/5 at 100 and c/2 at 90
    assert sorted(got) == [("a/0", 0), ("a/1", 20), ("a/2", 40), ("a/3", 60), ("a/4", 80), ("b/1", 3), ("b/2", 8), ("c/1", 40)]


def test_streams_agree_with_batch_over_two_runs(spark, tmp_path):
    pages = [(i, f"http://h{i % 3}/{i}", f"<a href='x'><a href=\"/{i % 4}\">{i % 5}") for i in range(12)]
    path = str(tmp_path / "pages")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.repartition(4).write.parquet(path)
    assert frontier.run_to_table(frontier.content_dedup(frontier.page_stream(spark, path, 1)), "d").count() == df.select("html").distinct().count()
    links = crawl.extract_links(frontier.page_stream(spark, path, 1)).select(F.col("link").alias("url"))
    got = {r.url for r in frontier.run_to_table(frontier.link_filter(links), "l").collect()}
    assert got == {r.link for r in crawl.extract_links(df).collect()} and len(got) == 12


def test_fetch_over_http(spark):
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread

    from skeinquery.sources import http

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            known = self.path == "/a"
            self.send_response(200 if known else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", "9")
            self.end_headers()
            self.wfile.write(f" {self.headers['User-Agent'][:5]}\xe9 ".encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    asked = spark.createDataFrame([(f"{base}/a",), (f"{base}/none",), ("no url",), (None,), (f"{base}/a",)], "url string")
    try:
        got = http.fetch(asked).collect()
        assert [tuple(r) for r in got] == [(f"{base}/a", 200, "text/html", 9, None, "skein\xe9")] * 2
        kept = http.fetch(asked, keep_failed=True).collect()
        assert len(kept) == 5 and sum(r.html is None for r in kept) == 3
        assert http.answer(f"{base}/a", most_bytes=3)["html"] == "sk"
    finally:
        server.shutdown()
        server.server_close()


def test_pushed_rows_and_lines(spark, tmp_path):
    from skeinquery.sources import http

    path = str(tmp_path / "in")
    spark.createDataFrame([('{"k": "a", "v": 1}',), ("no json",), ("[1]",), ('{"v": 2}',)], "value string").write.text(path)
    stream = http.pushed(spark, path, "k string, v int")
    frontier.write_lines(stream, "k", "v", str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["(,2)", "(a,1)"]


def test_pack_slice_moves_a_pack_once(spark):
    packs = spark.createDataFrame([("p", "ab\u00e9\U0001f600d"), ("q", ""), ("r", None)], "pack string, content string")
    meta = spark.createDataFrame([(1, "p", 0, 2), (2, "p", 2, 4), (3, "p", 4, 99), (4, "q", 0, 1), (5, "r", 0, 1), (6, "s", 0, 1), (7, "p", None, 1), (None, "p", 1, 1)], "id long, pack string, start_idx long, end_idx long")
    got = sorted(((r.id, r.record) for r in readers.pack_slice(meta, packs).collect()), key=str)
    assert got == sorted([(1, "ab"), (2, "\u00e9\U0001f600"), (3, "d"), (4, ""), (7, None), (None, "")], key=str)


def test_jobs(spark, tmp_path, capsys):
    from skeinquery.plans import jobs

    pages = [("d1", '<body>cat <b>dog</b> "cat"</body>'), ("d2", "<p>dog fish</p>"), ("d3", "<p>dog</p>")]
    at = {n: str(tmp_path / n) for n in ("csv", "raw", "list", "edges", "ranks", "docs")}
    sinks.write_csv(spark.createDataFrame(pages, "id string, contents string"), at["csv"])
    sinks.write_edges(spark.createDataFrame([("d1", "d2"), ("d2", "d1")], "src string, dst string"), at["edges"])
    spark.createDataFrame([("d1", "one")], "id string, title string").write.parquet(at["docs"])
    jobs.main(["index", "--input_uri", at["csv"], "--output_path_raw", at["raw"], "--output_path_list", at["list"]])
    jobs.main(["pagerank", "--input_uri", at["edges"], "--output_uri", at["ranks"], "--pr_iterations", "2"])
    capsys.readouterr()
    jobs.main(["search", "--postings", at["list"], "--ranks", at["ranks"], "--documents", at["docs"], "--q", "cat"])
    assert capsys.readouterr().out.startswith('{"id":"d1","title":"one","score":3.51210')


def test_lists_and_times(spark):
    assert one(spark, T.worker_list(F.col("s")), s="[a:1, http://b:2]") == ["http://a:1", "http://b:2"]
    assert one(spark, T.request_seconds(F.lit(1000), F.col("s")), s=2500) == 1.5


def test_groupings(spark):
    df = spark.range(10)
    assert frontier.grouped(df, "all", 3).count() == 30
    assert frontier.grouped(df, "first", 3).rdd.getNumPartitions() == 1
    assert frontier.grouped(df, "fields", 3, ["id"]).rdd.getNumPartitions() == 3
    routed = frontier.route_fields(df, ["id"], 4).collect()
    assert all(0 <= r.route < 4 for r in routed)
    with pytest.raises(ValueError):
        frontier.grouped(df, "other", 3)


def test_entry_imports_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/skeinquery", tmp_path / "skeinquery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'tfidf' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
