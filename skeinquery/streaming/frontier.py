"""Streams: de-duplication, the link filter, routing by key, and a frontier with a queue and a timer for each host.

Every function takes and returns a streaming DataFrame; `run_to_table` drains one into the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinquery.functions import text as X
from skeinquery.functions import urls as U
from skeinquery.sources.shared import shared_path


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """(page_id, url, html) as files arrive."""
    return spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def route_fields(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """rows with `route_key` (values joined by commas) and `route`, the number of the worker out of n that gets the key."""
    key = F.concat_ws(",", *(F.col(c).cast("string") for c in columns))
    return rows.withColumn("route_key", key).withColumn("route", F.pmod(F.conv(F.substring(X.md5_hex(F.col("route_key")), 1, 8), 16, 10).cast("long"), F.lit(n)))


def grouped(rows: DataFrame, how: str, n: int, columns: list[str] | None = None) -> DataFrame:
    """Deals rows out as a stream engine's groupings do: "fields", "shuffle", "first" (all to one) or "all" (to each of n)."""
    if how == "fields":
        return rows.repartition(n, *(columns or []))
    if how == "shuffle":
        return rows.repartition(n)
    if how == "first":
        return rows.coalesce(1)
    if how == "all":
        return rows.withColumn("route", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    raise ValueError(how)


def content_dedup(pages: DataFrame) -> DataFrame:
    """The first page of each content, by md5; state is one hash for each content, dealt by hash."""
    return pages.withColumn("md5", X.md5_hex(F.coalesce("html", F.lit("")))).dropDuplicates(["md5"])


def link_filter(links: DataFrame) -> DataFrame:
    """(url): links(url) that the blacklist passes, each once over the whole stream."""
    return links.select("url").where(U.passes_blacklist(F.col("url"))).dropDuplicates(["url"])


OUT = T.StructType([T.StructField("domain", T.StringType()), T.StructField("url", T.StringType()), T.StructField("at_ms", T.LongType())])
STATE = T.StructType([T.StructField("next_ms", T.LongType())])
REQUEST = T.StructType([T.StructField("asked_ms", T.LongType()), T.StructField("url", T.StringType()), T.StructField("wait_ms", T.LongType())])
QUEUE = T.StructType([T.StructField("waiting", T.ArrayType(REQUEST)), T.StructField("next_ms", T.LongType())])


def asked(requests: DataFrame, delay_ms: int, robots: DataFrame | None) -> DataFrame:
    """(domain, url, ts, delay_ms) of the requests that robots(domain, disallowed, delay) allows, with the delay of each host."""
    rows, wait = requests.select("domain", "url", "ts"), F.lit(delay_ms)
    if robots is not None:
        rows = rows.join(robots.select("domain", "disallowed", "delay"), "domain", "left")
        rows = rows.where(U.robots_allow(U.parsed(F.col("url"))["path"], F.col("disallowed")))
        wait = F.coalesce(F.col("delay") * 1000, wait)
    return rows.select("domain", "url", "ts", wait.cast("long").alias("delay_ms"))


def frontier(requests: DataFrame, delay_ms: int = 0, robots: DataFrame | None = None) -> DataFrame:
    """(domain, url, at_ms) of requests(domain, url, ts): when each URL may be fetched.

    With robots(domain, disallowed, delay), a static table, URLs that their host disallows go, and a host's own delay in
    seconds stands in for delay_ms; hosts without rules allow all.

    A host hands out a URL at most every delay_ms, first in first out. Every URL gets its time in the batch it comes
    in, so order holds within a batch; `queued_frontier` waits and orders over batches. Times are event times, so a
    replay of the same batches gives the same answer. A host keeps only its next free time; no lock is shared.
    """

    def serve(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_ms = state.get[0] if state.exists else None
        rows = sorted((t.value // 1_000_000, u, int(d)) for f in frames for t, u, d in zip(f["ts"], f["url"], f["delay_ms"], strict=True))
        out = []
        for at, url, wait in rows:
            at = at if next_ms is None else max(at, next_ms)
            out.append((key[0], url, at))
            next_ms = at + wait
        state.update((next_ms,))
        yield pd.DataFrame(out, columns=["domain", "url", "at_ms"])

    return asked(requests, delay_ms, robots).groupBy("domain").applyInPandasWithState(serve, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def queued_frontier(requests: DataFrame, delay_ms: int = 0, robots: DataFrame | None = None, lateness: str = "0 seconds") -> DataFrame:
    """(domain, url, at_ms) as `frontier` gives them, each handed out once the stream's time has passed at_ms.

    Until then a URL waits in its host's queue, ordered by (ts, url) over all batches: the watermark runs `lateness`
    behind the newest request, what it has passed is final, and requests that come later than that are left out. Times
    and order thus do not depend on how the stream is cut into batches. A host's timer wakes it without new requests; at
    the end of a bounded stream URLs whose time has not passed stay in the state. Repeated requests are handed out as
    often as they come. Rows without a time never wait: they are left out. A queue is one row of state, as one
    politeness clock orders it.
    """

    def serve(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, next_ms = state.get if state.exists else ([], None)
        new = [(t.value // 1_000_000, u, int(d)) for f in frames for t, u, d in zip(f["ts"], f["url"], f["delay_ms"], strict=True)]
        queue = sorted([*map(tuple, waiting), *new], key=lambda row: (row[0], row[1] or "", row[2]))
        now, out = state.getCurrentWatermarkMs(), []
        for asked_ms, url, wait in queue:
            at = asked_ms if next_ms is None else max(asked_ms, next_ms)
            if at >= now:
                break
            out.append((key[0], url, at))
            next_ms = at + wait
        queue = queue[len(out) :]
        state.update((queue, next_ms))
        if queue:
            state.setTimeoutTimestamp(queue[0][0] if next_ms is None else max(queue[0][0], next_ms))
        yield pd.DataFrame(out, columns=["domain", "url", "at_ms"])

    timed = requests.where("ts is not null").withWatermark("ts", lateness)
    return asked(timed, delay_ms, robots).groupBy("domain").applyInPandasWithState(serve, OUT, QUEUE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that its source has now, exactly once, and returns what it wrote."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def write_lines(stream: DataFrame, key: str, value: str, path: str, progress: str):
    """A query that writes the lines `(key,value)` of a stream as text files."""
    line = F.concat(F.lit("("), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(","), F.coalesce(F.col(value).cast("string"), F.lit("")), F.lit(")"))
    return stream.select(line.alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", progress).trigger(availableNow=True).start()


def crawl_step(pages: DataFrame, edges_out: str, documents_out: str, progress: str):
    """A query that writes the links and the documents of each micro-batch of pages; two sinks, one pass over a batch."""
    from skeinquery.operators import crawl

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        crawl.link_graph(batch).write.mode("overwrite").parquet(f"{edges_out}/batch={number}")
        crawl.doc_meta(batch).write.mode("overwrite").parquet(f"{documents_out}/batch={number}")
        batch.unpersist()

    return content_dedup(pages).writeStream.foreachBatch(both).option("checkpointLocation", progress).trigger(availableNow=True).start()
