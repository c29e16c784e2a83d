"""Crawling in batch: links, documents, de-duplication, rules, the frontier as a fixpoint, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinquery.functions import text as T
from skeinquery.functions import urls as U
from skeinquery.sources.shared import shared_path

#: The least length of a page, the lengths of an excerpt and the time after which a worker counts as gone.
LEAST_LENGTH, EXCERPT, ALIVE_MS = 200, 300, 30_000


def fetch_pages(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, html) of frontier(url) that the page store has; the offline stand-in for a fetch."""
    return frontier.select("url").distinct().join(pages.select("url", "html"), "url")


def content_type(header: "F.Column") -> "F.Column":  # type: ignore[name-defined]
    """The type of a Content-Type header, without its parameters."""
    return F.trim(F.split(header, ";")[0])


def doc_quality(pages: DataFrame) -> DataFrame:
    """Pages of LEAST_LENGTH characters or more with a link or more; null html has neither."""
    return pages.where((F.length("html") >= LEAST_LENGTH) & (F.size(U.hrefs(F.col("html"))) > 0))


def num_links(pages: DataFrame) -> DataFrame:
    """(url, num_links), malformed links included."""
    return pages.select("url", F.size(U.hrefs(F.col("html"))).cast("long").alias("num_links"))


def extract_links(pages: DataFrame) -> DataFrame:
    """(url, link, domain) for each well-formed absolute link of a page, a row per occurrence; domain is the link's base URL."""
    rows = pages.select("url", F.explode(U.hrefs(F.col("html"))).alias("href"))
    rows = rows.select("url", U.resolved(F.col("url"), F.col("href")).alias("link"))
    return rows.where(U.is_url(F.col("link"))).withColumn("domain", U.base_url(F.col("link")))


def link_graph(pages: DataFrame, dst: str = "domain") -> DataFrame:
    """Distinct (src, dst) of md5 ids: a page, and the base URL ("domain") or the whole URL ("page") of its links."""
    if dst not in ("domain", "page"):
        raise ValueError(dst)
    to = F.col("domain") if dst == "domain" else F.col("link")
    return extract_links(pages).select(T.md5_hex(F.col("url")).alias("src"), T.md5_hex(to).alias("dst")).distinct()


def doc_meta(pages: DataFrame) -> DataFrame:
    """A row per page: id, url, domain, title, doc_excerpt, length, num_links, content_hash."""
    shown = F.trim(F.regexp_replace(T.visible(F.col("html")), T.SPACES, " "))
    return pages.select(
        T.md5_hex(F.col("url")).alias("id"), "url", U.base_url(F.col("url")).alias("domain"), T.html_title(F.col("html")).alias("title"), F.substring(shown, 1, EXCERPT).alias("doc_excerpt"),
        F.length("html").cast("long").alias("length"), F.size(U.hrefs(F.col("html"))).cast("long").alias("num_links"), T.md5_hex(F.col("html")).alias("content_hash"),
    )


def content_dedup(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, md5): of documents with equal text the one with the smallest key; a group by hash with partial minima."""
    return docs.groupBy(T.md5_hex(F.coalesce(F.col(text), F.lit(""))).alias("md5")).agg(F.min(key).alias(key)).select(key, "md5")


def url_unseen(links: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct (url) of links(url) that seen(url) does not have and the blacklist passes."""
    return links.select("url").where(U.passes_blacklist(F.col("url"))).distinct().join(seen.select("url").distinct(), "url", "left_anti")


def robots_allowed(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """urls(url) that their site's robots(domain, disallowed) allow; malformed URLs go, sites without rules allow all."""
    rows = urls.where(U.is_url(F.col("url"))).withColumn("domain", U.base_url(F.col("url")))
    rows = rows.join(robots.select("domain", "disallowed"), "domain", "left")
    return rows.where(U.robots_allow(U.parsed(F.col("url"))["path"], F.col("disallowed"))).select("url", "domain")


def crawl_fixpoint(seeds: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(url, depth): what `depth` rounds, or as many as add something, reach from seeds(url) over edges(url, link), with the first round that does.

    Each round joins only the newest URLs with the edges and leaves out what is seen; it ends when none is new. A round writes
    only what is new to the shared folder.
    """
    spark, path = seeds.sparkSession, shared_path(seeds.sparkSession, "crawl")
    seen = lambda: spark.read.schema("url string, depth int").parquet(path)
    front, d = seeds.select("url").where(U.passes_blacklist(F.col("url"))).distinct(), 0
    while True:
        front.write.parquet(f"{path}/depth={d}")
        front = spark.read.schema("url string").parquet(f"{path}/depth={d}")
        if front.isEmpty() or d == depth:
            return seen()
        links = edges.join(front, "url").select(F.col("link").alias("url"))
        front, d = url_unseen(links, seen()), d + 1


def crawl_stats(documents: DataFrame, content: DataFrame, urls: DataFrame, robots: DataFrame, queues: DataFrame) -> DataFrame:
    """(documents, contents, urls, robots, domains, queued): rows of each store, and the sites and URLs of queues(domain, url), whose rows are distinct."""
    n = lambda d: d.agg(F.count("*")).scalar()
    out = queues.agg(F.count_distinct("domain").alias("domains"), F.count("*").alias("queued"))
    return out.select(n(documents).alias("documents"), n(content).alias("contents"), n(urls).alias("urls"), n(robots).alias("robots"), "domains", "queued")


def crawl_rate(workers: DataFrame, now_ms: int, started_ms: int) -> DataFrame:
    """(total, rate): counts of workers(count, last_active) heard of within ALIVE_MS; rate is the whole number total / (seconds + 1)."""
    alive = workers.where(F.lit(now_ms) - F.col("last_active") <= ALIVE_MS)
    total = F.coalesce(F.sum("count"), F.lit(0)).cast("long")
    return alive.agg(total.alias("total")).withColumn("rate", F.floor(F.col("total") / ((now_ms - started_ms) // 1000 + 1)).cast("long"))


def crawl_delay(visits: DataFrame, now_ms: int) -> DataFrame:
    """visits(domain, last_ms, delay_s) that may be asked at now_ms."""
    return visits.where(U.delay_passed(F.lit(now_ms), F.col("last_ms"), F.col("delay_s")))
