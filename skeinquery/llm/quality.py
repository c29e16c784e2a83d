"""Quality rules by cross-document line frequency, within each host.

Lines are normalised (lower case, digits as 0, white space collapsed) and hashed; a line's frequency is the number of
documents of its host that have it. Lines above the limits are removed; a document that loses more than a share of its
words is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinquery.llm.common import decoded, emitted, pairs, shared_path, texts

SYMBOLS = "[#*$%&|<>]"
DIGIT_RUN = re.compile(rb"[0-9]+")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FACTS = pa.schema([("key", pa.binary()), ("host", pa.string()), *((k, pa.int64()) for k in STATS), ("hashes", pa.list_(pa.int64()))])
PACKED = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("packed", pa.binary())])
CLEAN = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), *((k, pa.int64()) for k in (*STATS, "removed_words"))])


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    two = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(two[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def line_hash(parts: list[bytes]) -> int:
    """The hash of a normalised line, from its words."""
    return xxhash.xxh64_intdigest(DIGIT_RUN.sub(b"0", b" ".join(parts).lower())) - (1 << 63)


def without(text: bytes, gone: set[int]) -> bytes:
    """A text without the lines whose hashes are in `gone`; the others stay as they are, in order."""
    if not gone:
        return text
    return b"\n".join(line for line in text.split(b"\n") if not (parts := line.split()) or line_hash(parts) not in gone)


def measure(text: bytes) -> tuple:
    """The base figures of a text, then the hash of each distinct normalised line with a word."""
    words = text.split()
    characters = decoded(text)
    seen: set[bytes] = set()
    duplicates, hashes = 0, {}
    for line in text.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        duplicates += line in seen
        seen.add(line)
        hashes[line_hash(parts)] = None
    chars = len(characters) - sum(map(characters.count, " \t\n\x0b\x0c\r"))
    return len(words), chars, sum(map(characters.count, SYMBOLS[1:-1])), duplicates, repeat_words(words), list(hashes)


def key_of(doc: int | None, host: str, text: bytes | None) -> bytes:
    """128 bits that rows with the same id, host and text share."""
    h = xxhash.xxh3_128(f"{doc} {text is None} {len(host.encode())} {host} ")
    h.update(text or b"")
    return h.digest()


def clean(docs: DataFrame, host: str = "source", least_docs: int = 10, most_removed: float = 0.5) -> DataFrame:
    """doc_id, text, the base figures, base_failed, removed_words, kept of each row of docs(doc_id, text, host).

    `text` is without the lines that are removed; removed_words is what it has lost. A line is removed if more than
    `least_docs` documents of its host have it, however many the host has. Each row is a document, repeated rows
    and ids included; a null host is a host of its own; a null text has no words, fails the base rule and stays null.
    Lines' hashes have 64 bits. Figures and hashes go to the shared folder; lines are combined before the shuffle by host
    and hash, so a line that all documents share is a row for each task; the join back is of lines with frequent lines,
    which the engine broadcasts if they turn out small and otherwise deals by host and hash, with hot partitions split.
    Texts are then read again and pass one shuffle, compressed one by one, to meet their figures and removed lines by a
    key of id, host and text.
    """
    where = F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")
    source = texts(docs, where)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((key_of(doc, of, text), of, *measure(text or b"")) for batch in batches for doc, of, text in pairs(batch, "doc_id", "host", "text"))
        return emitted(FACTS, rows, 1024)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        rows = ((key_of(doc, of, text), doc, None if text is None else squeeze(text)) for batch in batches for doc, of, text in pairs(batch, "doc_id", "host", "text"))
        return emitted(PACKED, rows, 1024)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress

        def cleaned() -> Iterator[tuple]:
            for batch in batches:
                for doc, squeezed, hashes, *stats in pairs(batch, "doc_id", "packed", "gone", *STATS):
                    left = None if squeezed is None else without(expand(squeezed), set(hashes or ()))
                    yield doc, left, *stats, stats[0] - len((left or b"").split()) if hashes else 0

        return emitted(CLEAN, cleaned(), 1024)

    longs = ", ".join(f"{k} long" for k in STATS)
    path = shared_path(docs.sparkSession, "lines")
    source.mapInArrow(facts, f"key binary, host string, {longs}, hashes array<long>").write.option("compression", "zstd").parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    lines = rows.select("key", "host", F.explode("hashes").alias("hash"))
    frequent = lines.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > least_docs).select("host", "hash")
    gone = lines.join(frequent, ["host", "hash"], "left_semi").groupBy("key").agg(F.collect_set("hash").alias("gone"))
    own = rows.groupBy("key").agg(*(F.max(k).alias(k) for k in STATS)).join(gone, "key", "left")
    joined = source.mapInArrow(packed, "key binary, doc_id long, packed binary").join(own, "key").select("doc_id", "packed", "gone", *STATS)
    out = joined.mapInArrow(remove, f"doc_id long, text binary, {longs}, removed_words long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= most_removed * F.col("n_words")))
    return out.select("doc_id", F.col("text").cast("string").alias("text"), *STATS, "base_failed", "removed_words", "kept")


def apply_rules(docs: DataFrame, host: str = "source", least_docs: int = 10, most_removed: float = 0.5) -> DataFrame:
    """The figures and the verdict of clean(), without the texts."""
    return clean(docs, host, least_docs, most_removed).drop("text")
