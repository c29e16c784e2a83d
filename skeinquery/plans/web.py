"""The engine's queries over the driver's tables. Inputs and outputs are whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinquery.functions import text as T
from skeinquery.functions import urls as U
from skeinquery.operators import crawl, graph, index, search
from skeinquery.sources import readers, sinks
from skeinquery.sources.shared import cut, shared_path
from skeinquery.streaming import frontier

Query = Callable[[SparkSession, str], DataFrame]
WORDS = "the of"  # the keyword query of the search operators
NOW_MS = 1_700_000_000_000
ROUNDS = 10
#: A robots file for each site, dealt by the length of its name.
ROBOTS = ("User-agent: *\nDisallow: /en # closed\nCrawl-delay: 5\n\nDisallow: /z", "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow:\nDisallow: /de/")
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("docid"), F.col("text").alias("contents"))


def page_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(T.md5_hex(F.col("url")).alias("docid"), T.visible(F.col("html")).alias("contents"))


def tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_freq(corpus(spark, sf_dir))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tfidf(tf(spark, sf_dir))


def page_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings_chunked(index.tfidf(index.term_freq(page_corpus(spark, sf_dir))))


def page_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(crawl.link_graph(table(spark, sf_dir, "pages")), ROUNDS)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from parts to their suppliers."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


def sites(pages: DataFrame) -> DataFrame:
    """(domain, disallowed, delay) by the robots file of each site."""
    rows = pages.select(U.base_url(F.col("url")).alias("domain")).where("domain is not null").distinct()
    file = F.when(F.length("domain") % 2 == 0, ROBOTS[0]).otherwise(ROBOTS[1])
    return rows.select("domain", U.robots_rules(file, "skein").alias("r")).select("domain", "r.disallowed", "r.delay")


# Sources and sinks


@query
def scan_csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "csv")
    sinks.write_csv(corpus(spark, sf_dir).select(F.col("docid").alias("id"), "contents"), path)
    return readers.csv_quoted(spark, path).select("id", F.length("contents").cast("long").alias("chars"), F.md5(F.col("contents").cast("binary")).alias("md5"))


@query
def scan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "edges")
    sinks.write_edges(graph.edges_clean(trade(spark, sf_dir)), path)
    return readers.edges_csv(spark, f"{path}/*.csv")


@query
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "index")
    sinks.write_parquet(index.postings_chunked(weights(spark, sf_dir)), path)
    return readers.parquet(spark, path).select("word", F.round("idf", 6).alias("idf"), "rank", F.size("doc_list").cast("long").alias("docs"))


@query
def scan_rank_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "ranks")
    sinks.write_rank_text(graph.pagerank_basic(trade(spark, sf_dir)), path)
    return readers.rank_text(spark, path).select("node", F.round("rank", 6).alias("rank"))


@query
def unpack_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "packs")
    docs = corpus(spark, sf_dir).select(T.md5_hex(F.col("docid")).alias("id"), "contents")
    sinks.write_packs(docs, path)
    out = readers.unpack(readers.packs(spark, path))
    return out.select("id", T.md5_hex(F.col("contents")).alias("md5"))


@query
def blob_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).select(T.md5_hex(F.col("docid")).alias("id"), "contents")
    return sinks.pack_offsets(docs)


@query
def blob_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "packs")
    docs = corpus(spark, sf_dir).select(T.md5_hex(F.col("docid")).alias("id"), "contents")
    sinks.write_packs(docs, path)
    packed = readers.packs(spark, path).withColumn("pack", F.regexp_extract("pack", r"pack=(\d+)", 1).cast("long"))
    return readers.pack_slice(sinks.pack_offsets(docs), packed).select("id", T.md5_hex(F.col("record")).alias("md5"))


@query
def scan_csv_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "csv")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("docid"), F.concat(F.lit("  "), "url").alias("url"))
    rows.write.options(header=True, ignoreLeadingWhiteSpace=False).csv(path)
    return readers.csv_trimmed(spark, path, "docid string, url string")


@query
def scan_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "seeds")
    table(spark, sf_dir, "pages").select(F.concat(F.lit(" "), "url", F.lit("  ")).alias("value")).write.text(path)
    return readers.seeds(spark, path)


@query
def append_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = shared_path(spark, "words"), table(spark, sf_dir, "documents")
    for name in ("lang", "source"):
        sinks.append_words(docs.select(F.col(name).alias("word")), path)
    return spark.read.text(path).select(F.col("value").alias("word"))


@query
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("long").alias("chars"))
    return search.from_json(search.as_json(pages), "page_id long, url string, chars long")


@query
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit(" text/"), "lang", F.lit(" ; charset=utf-8"))
    return table(spark, sf_dir, "documents").groupBy(crawl.content_type(header).alias("type")).agg(F.count("*").alias("n"))


@query
def request_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", T.request_seconds(F.col("o_custkey"), F.col("o_orderkey") + F.col("o_custkey")).alias("seconds"))


@query
def worker_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = T.worker_list(F.concat(F.lit("["), "lang", F.lit(", http://"), "source", F.lit(",]")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(names).cast("long").alias("n"), F.array_join(names, " ").alias("workers"))


@query
def distinct_docnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("docname")).distinct()


@query
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda n: table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one("documents").unionByName(one("pages")).unionByName(one("lineitem"))


@query
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.kv_get(table(spark, sf_dir, "documents"), doc_id=42).select("doc_id", "lang", "source", "n_chars")


@query
def batch_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return search.batch_get(table(spark, sf_dir, "documents"), keys, "doc_id", "lang", "source")


@query
def fetch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    linked = crawl.extract_links(pages).select(F.col("link").alias("url"))
    wanted = pages.select("url").unionByName(linked).unionByName(spark.sql("SELECT 'http://nowhere.example/' AS url"))
    return crawl.fetch_pages(wanted, pages).select("url", T.md5_hex(F.col("html")).alias("md5"))


@query
def kv_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.kv_items(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"))


@query
def put_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sinks.put_new(docs, table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


# Text


@query
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(T.tokens(T.visible(F.col("html")))).alias("word"))
    return rows.groupBy("page_id", "word").agg(F.count("*").alias("n"))


@query
def html_parsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the real parser; SQL has none."""
    return T.clean_html(table(spark, sf_dir, "pages").select("page_id", "html"), scope="token")


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "node"))
    return rows.select("doc_id", "pos", T.normalized(F.col("node")).alias("text"))


@query
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("word"))
    return rows.where(~T.is_stop_word(F.col("word"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.md5_hex(url).alias("md5"), T.sha256_hex(url).alias("sha256"), T.java_hash(url).alias("java_hash"))


@query
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    clock = T.clock(F.col("n_chars"))
    return docs.select("doc_id", T.ceil5(F.col("n_chars")).cast("long").alias("up5"), clock["hours"].alias("hours"), clock["minutes"].alias("minutes"), clock["seconds"].alias("seconds"), F.md5(T.single_line(F.col("text")).cast("binary")).alias("line_md5"))


# Index


@query
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf(spark, sf_dir)


@query
def corpus_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.corpus_freq(tf(spark, sf_dir))


@query
def max_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.max_tf(tf(spark, sf_dir))


@query
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.doc_freq(tf(spark, sf_dir))


@query
def num_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.num_docs(tf(spark, sf_dir))


@query
def term_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.term_map(tf(spark, sf_dir))
    return rows.select("word", "corpus_freq", F.explode("occ").alias("docid", "tf"))


@query
def tf_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tf_normalized(tf(spark, sf_dir)).withColumn("normalized_tf", F.round("normalized_tf", 6))


@query
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("normalized_tf", "idf", "tfidf")}
    return weights(spark, sf_dir).withColumns(rounded)


@query
def top_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.top_tfidf(weights(spark, sf_dir))


@query
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lists, a row for each document with its place."""
    rows = index.postings_ranked(weights(spark, sf_dir))
    return rows.select("word", F.round("idf", 6).alias("idf"), (F.col("place") - 1).cast("int").alias("pos"), "docid", F.round("tfidf", 6).alias("tfidf"))


@query
def postings_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In chunks of 50, so that small inputs have several."""
    rows = index.postings_chunked(weights(spark, sf_dir), 50)
    return rows.select("word", F.round("idf", 6).alias("idf"), "rank", F.posexplode("doc_list").alias("pos", "d")).select("word", "idf", "rank", "pos", "d.docid")


# Graph


@query
def edges_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_clean(trade(spark, sf_dir))


@query
def reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse_edges(graph.edges_clean(trade(spark, sf_dir)))


@query
def sink_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sink_nodes(trade(spark, sf_dir))


@query
def sink_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sink_repair(trade(spark, sf_dir))


@query
def drop_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return graph.drop_self_loops(graph.edges_clean(items.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))))


@query
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_degree(graph.sink_repair(trade(spark, sf_dir)))


@query
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(graph.edges_clean(trade(spark, sf_dir))).select("src", F.array_join("dsts", ",").alias("dsts"))


@query
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.link_graph(table(spark, sf_dir, "pages"))


@query
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(trade(spark, sf_dir), ROUNDS).withColumn("rank", F.round("rank", 6))


@query
def pagerank_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank_basic(trade(spark, sf_dir)).withColumn("rank", F.round("rank", 6))


@query
def top_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_ranks(graph.pagerank(trade(spark, sf_dir), ROUNDS))


# Search


@query
def search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_and(page_postings(spark, sf_dir), WORDS).withColumn("score", F.round("score", 6))


@query
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_ranked(page_postings(spark, sf_dir), page_ranks(spark, sf_dir), WORDS, 9)


@query
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = crawl.doc_meta(table(spark, sf_dir, "pages")).select("id", "url", "domain", "title", "length", "num_links")
    return search.search_results(page_postings(spark, sf_dir), page_ranks(spark, sf_dir), docs, WORDS)


@query
def pagerank_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "pages").select(T.md5_hex(F.col("url")).alias("id")).unionByName(spark.sql("SELECT 'unknown' AS id"))
    return search.rank_of(page_ranks(spark, sf_dir), ids).withColumn("rank", F.round("rank", 6))


# Crawling


@query
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", U.parsed(F.col("url")).alias("u"), U.base_url(F.col("url")).alias("base"))
    return rows.select("page_id", "u.scheme", "u.host", "u.port", "u.path", "base")


@query
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url").where(U.passes_blacklist(F.col("url")))


@query
def num_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.num_links(table(spark, sf_dir, "pages"))


@query
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.extract_links(table(spark, sf_dir, "pages"))


@query
def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.doc_quality(table(spark, sf_dir, "pages")).select("page_id")


@query
def doc_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.doc_meta(table(spark, sf_dir, "pages"))


@query
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.content_dedup(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def url_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return crawl.url_unseen(crawl.extract_links(pages).select(F.col("link").alias("url")), pages.select("url"))


@query
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(table(spark, sf_dir, "pages")).select("domain", F.array_join("disallowed", " ").alias("disallowed"), "delay")


@query
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return crawl.robots_allowed(pages.select("url"), sites(pages))


@query
def crawl_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("domain")).agg(F.max(F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))).alias("last_ms"))
    visits = last.withColumn("delay_s", (F.col("domain") % 3 * 86_400 * 5).cast("int"))
    latest = last.agg(F.max("last_ms")).first()[0]
    return crawl.crawl_delay(visits, latest or 0)


@query
def crawl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    queues = crawl.extract_links(pages).select("domain", F.col("link").alias("url")).distinct()
    return crawl.crawl_stats(pages, crawl.content_dedup(pages, "page_id", "html"), pages.select("url").distinct(), sites(pages), queues)


@query
def crawl_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("count"), (F.lit(NOW_MS) - F.col("s_suppkey") * 1000).alias("last_active"))
    return crawl.crawl_rate(workers, NOW_MS, NOW_MS - 90_000)


@query
def crawl_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.sink_repair(trade(spark, sf_dir)).select(F.col("src").alias("url"), F.col("dst").alias("link"))
    return crawl.crawl_fixpoint(spark.sql("SELECT 'p1' AS url"), cut(edges))


# Streams


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: users are hosts."""
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(f"{sf_dir}/events.parque?")
    return events.select(F.col("user_id").cast("string").alias("domain"), F.col("event_id").cast("string").alias("url"), "ts")


@query
def stream_content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = frontier.content_dedup(frontier.page_stream(spark, f"{sf_dir}/pages.parque?"))
    return frontier.run_to_table(stream.select("md5"), "stream-dedup")


@query
def stream_link_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = crawl.extract_links(frontier.page_stream(spark, f"{sf_dir}/pages.parque?")).select(F.col("link").alias("url"))
    return frontier.run_to_table(frontier.link_filter(links), "stream-links")


@query
def stream_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.run_to_table(frontier.frontier(event_requests(spark, sf_dir), 60_000), "stream-frontier")


@query
def stream_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.run_to_table(frontier.queued_frontier(event_requests(spark, sf_dir), 3_600_000), "stream-queue")


@query
def stream_crawl_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "stream-crawl")
    frontier.crawl_step(frontier.page_stream(spark, f"{sf_dir}/pages.parque?"), f"{path}/edges", f"{path}/documents", f"{path}/progress").awaitTermination()
    return spark.read.parquet(f"{path}/edges").select("src", "dst").distinct()


@query
def route_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.route_fields(table(spark, sf_dir, "pages").select("page_id", U.base_url(F.col("url")).alias("domain")), ["domain"], 8)
