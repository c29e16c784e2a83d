"""A content-addressed archive of web records.

Payload bytes are stored once, under their SHA-256; exact record headers are stored apart, as the bytes that a WARC file
has. All that reading tells of a record, its type, ids and payload, comes from these bytes: a header names its payload's
digest, and a join rebuilds the record. A payload that does not match its address, or that is missing, stops the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads of fewer bytes than this are always stored as responses.
LEAST_SHARED = 100
#: Fixed value: the profile of revisits with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, digest, payload_bytes of each row of pages(page_id, url, html); a null html is an empty payload."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def headers_of(rows: DataFrame, date: str) -> DataFrame:
    """(headers): the exact header bytes of the record of each row of digests().

    Of the records with equal payloads of LEAST_SHARED bytes or more, the one with the smallest page_id is the response
    and the others revisit it. A null url leaves its header out; line breaks in a url are written %0D and %0A. Repeated
    page_ids: each row is a record, and all rows that hold the smallest page_id are responses. A null page_id is never the
    response unless all ids of its payload are null. A hot digest is combined before the shuffle, and the join back is by
    digest, where the smaller side has one row for each.
    """
    shared = rows.where(F.col("payload_bytes") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first_id")
    out = rows.join(shared, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    headers = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("first_id"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return out.select(headers.cast("binary").alias("headers"))


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes path/index, path/headers and path/payloads as Parquet; `date` is the WARC-Date of all records.

    The index has ids and digests only; headers, and which row stores a payload (the one with the smallest page_id), come
    from it alone. Then payloads meet their choice in one join on digest and id, which spreads the copies of a hot
    payload. Only payloads whose chosen row repeats, page_id and all, pass a second shuffle that keeps one.
    """
    spark = pages.sparkSession
    digests(pages).write.mode("error").parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    headers_of(index, date).write.mode("error").parquet(f"{path}/headers")
    own_id = F.coalesce("page_id", F.lit(-1)).alias("own_id")
    per_id = index.groupBy("digest", own_id).agg(F.min(F.col("page_id").isNull()).alias("nameless"), F.count("*").alias("ties"))
    chosen = per_id.groupBy("digest").agg(F.min(F.struct("nameless", "own_id", "ties")).alias("c")).select("digest", "c.own_id", "c.ties")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), payload.alias("payload")).select(F.sha2("payload", 256).alias("digest"), own_id, "payload")
    told = rows.join(chosen, ["digest", "own_id"])
    kept = told.where("ties = 1").select("digest", "payload").unionByName(told.where("ties > 1").select("digest", "payload").dropDuplicates(["digest"]))
    kept.write.mode("error").parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload, payload_bytes, payload_digest of an archive, verified: a payload whose hash is not its address stops the read."""
    stored = spark.read.parquet(f"{path}/payloads")
    found = F.sha2("payload", 256)
    wrong = F.raise_error(F.concat(F.lit("payload does not match its address "), F.col("digest")))
    return stored.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(found == F.col("digest"), found).otherwise(wrong).alias("payload_digest"))


def parsed(headers: DataFrame) -> DataFrame:
    """headers, and what they say: page_id, url, record_type, refers_to, digest, length. Bytes that are no record's headers stop the read."""
    text = F.col("headers").cast("string")
    value = lambda name: F.nullif(F.regexp_extract(text, f"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    id_of = lambda name: F.regexp_extract(value(name), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    kind, digest = value("WARC-Type"), F.regexp_extract(value("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1)
    whole = text.startswith("WARC/1.1\r\n") & text.endswith("\r\n\r\n") & F.coalesce(kind.isin("response", "revisit"), F.lit(False)) & F.coalesce(digest != "", F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("not the headers of a record: "), text))
    return headers.select(
        "headers", id_of("WARC-Record-ID").alias("page_id"), value("WARC-Target-URI").alias("url"), F.when(whole, kind).otherwise(wrong).alias("record_type"),
        id_of("WARC-Refers-To").alias("refers_to"), digest.alias("digest"), value("Content-Length").try_cast("long").alias("length"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page_id, url, headers, record_type, refers_to, payload, payload_bytes, payload_digest.

    The payload of a revisit is that of the record it refers to. A response whose stated length is not its payload's, or
    a record whose payload is missing, stops the read. Where only lengths and digests are selected, payload bytes are
    hashed where they lie and not moved. An archive of no pages has no records.
    """
    read = parsed(spark.read.parquet(f"{path}/headers")).join(payloads(spark, path), "digest", "left")
    missing = F.raise_error(F.concat(F.lit("missing payload "), F.col("digest")))
    short = F.raise_error(F.concat(F.lit("wrong length of a record with payload "), F.col("digest")))
    good = (F.col("record_type") == "revisit") | (F.col("length") == F.col("payload_bytes"))
    size = F.when(F.col("payload_bytes").isNull(), missing).when(good, F.col("payload_bytes")).otherwise(short)
    return read.select("page_id", "url", "headers", "record_type", "refers_to", "payload", size.cast("long").alias("payload_bytes"), F.when(F.col("payload_digest").isNull(), missing).otherwise(F.col("payload_digest")).alias("payload_digest"))


def record_bytes(read: DataFrame) -> DataFrame:
    """page_id, record: headers, block and the two line ends that close a record, as bytes; a revisit has an empty block."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return read.select("page_id", F.concat("headers", block, F.lit(b"\r\n\r\n")).alias("record"))
