"""Pages over HTTP, and rows that other programs push as JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the time that a connection or an answer may take.
TIMEOUT_S = 1.2
ANSWER = pa.schema([("url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("length", pa.int64()), ("last_modified", pa.string()), ("html", pa.string())])


def answer(url: str | None, method: str = "GET", agent: str = "skeinquery", most_bytes: int = 1 << 20, timeout_s: float = TIMEOUT_S) -> dict:
    """What a server answers: status, headers and the first most_bytes of the body, trimmed; nulls after any error."""
    found = dict.fromkeys(ANSWER.names) | {"url": url}
    try:
        with urlopen(Request(url or "", method=method, headers={"User-Agent": agent}), timeout=timeout_s) as got:
            body, head, size = got.read(most_bytes), got.headers, got.headers.get("Content-Length", "").strip()
            return found | {
                "status": got.status, "content_type": head.get("Content-Type", "").split(";")[0].strip() or None, "length": int(size) if size.isdigit() else None,
                "last_modified": head.get("Last-Modified", "").strip() or None, "html": body.decode("utf-8", "replace").strip() if method == "GET" else None,
            }
    except (OSError, ValueError):
        return found


def fetch(requests: DataFrame, get: Callable[[str | None], dict] = answer, keep_failed: bool = False) -> DataFrame:
    """(url, status, content_type, length, last_modified, html) of each row of requests(url), through `get`.

    Requests that fail go, or stay with nulls (keep_failed). A lost task asks again, so a page may be fetched twice;
    write the result before it is used twice. Answers leave in batches of 64, so a task holds few bodies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(0).to_pylist()
            for at in range(0, len(urls), 64):
                yield pa.RecordBatch.from_pylist([get(u) for u in urls[at : at + 64]], schema=ANSWER)

    rows = requests.select("url").mapInArrow(run, "url string, status int, content_type string, length long, last_modified string, html string")
    return rows if keep_failed else rows.where("status is not null")


def decoded(text: Column, schema: str) -> Column:
    """A JSON object as a struct; null where it is none."""
    return F.from_json(text, schema)


def pushed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the JSON tuples, a line each, that others put into a folder; lines that are no JSON object go.

    The folder stands between the two sides, so a restart reads again what it had not finished.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.where(F.get_json_object("value", "$").startswith("{")).select(decoded(F.col("value"), schema).alias("row")).select("row.*")
