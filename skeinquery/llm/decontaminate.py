"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ten consecutive words of an item (all words of a shorter item), taken as the set of its shingles of five
words (one of all its words, if it has fewer). Shingles are ordered by rarity, that is by how often all documents have
them. A document holds a window only if it holds all its shingles, so containment is total and the prefix that the join
needs is one token: the rarest shingle. Documents and windows are joined on that token by shuffle; a joined pair has one
possible place (positional bound), must lie within the document (length bound), and is then compared word by word.

Documents send only shingles that pass a filter of fixed size over the wanted ones; the filter is the only thing of the
benchmark that the driver or a broadcast holds. A filter that fills up lets more through, which the join leaves out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinquery.llm.common import WORD_BYTES, cut, emitted, free_name, kept, pairs, texts, word_list

SHINGLE = 5
SLOTS = 1 << 21  # of 64 bits each: 16 MB
BLOCK = 1 << 20  # bytes of texts that a task hashes together; a longer text is a block of its own
SEGMENT = 1 << 20  # bytes of a running sum
WINDOWS = pa.schema([("item", pa.string()), ("window", pa.binary()), ("size", pa.int32()), ("hashes", pa.list_(pa.int64()))])
COUNTS = pa.schema([("hash", pa.int64()), ("n", pa.int64())])
HIT = pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("context", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("digest", pa.binary()), ("hits", pa.list_(HIT))])
READ_DDL = "doc_id long, n_words long, digest binary, hits array<struct<hash:long,at:int,lead:int,context:binary>>"
FOUND = pa.schema([("row", pa.int64()), ("digest", pa.binary()), ("start", pa.int64()), ("end", pa.int64()), ("window", pa.binary())])


MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number, and of its inverse modulo 2 ** 64."""
    base = 0x00000100000001B3
    out = np.full((2, SEGMENT + 1), 1, np.uint64)
    out[0, 1:], out[1, 1:] = base, pow(base, -1, 1 << 64)
    return tuple(np.cumprod(out, axis=1, dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(folded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a text in which all else is spaces, without an object a word.

    A word's hash is a polynomial in its bytes, from running sums over a segment of the text that ends with a word.
    """
    text = np.frombuffer(folded, np.uint8)
    space = np.r_[True, text == 32, True]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers()
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        begin = int(starts[at])
        stop = int(np.searchsorted(ends, begin + SEGMENT, "right"))
        if stop == at:  # a word longer than a segment
            out[at] = xxhash.xxh64_intdigest(folded[begin : int(ends[at])])
            at += 1
            continue
        part = text[begin : int(ends[stop - 1])].astype(np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum(part * up[: len(part)], dtype=np.uint64)]
        s, e = starts[at:stop] - begin, ends[at:stop] - begin
        out[at:stop] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * MIX)
        at = stop
    return starts, ends, out


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, from the hashes of the words."""
    out = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for k in range(size):
        out = mixed(out ^ h[k : k + len(out)])
    return out


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item, window (its words, spaced), size, hashes of its shingles: a row for each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for item, text in pairs(batch, "item", "text"):
                    words = word_list(text)
                    size = min(width, len(words))
                    k = min(SHINGLE, size)
                    h = shingle_hashes(word_hashes((text or b"").translate(WORD_BYTES))[2], k).view(np.int64).tolist() if size else []
                    for i in range(len(words) - size + 1 if size else 0):
                        yield item, b" ".join(words[i : i + size]), size, h[i : i + size - k + 1]

        return emitted(WINDOWS, rows(), 1 << 14)

    source = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "item string, window binary, size int, hashes array<long>")


def filter_of(hashes: DataFrame) -> Broadcast:
    """A bit for each of hashes(hash); slots are combined before the driver gets them, SLOTS rows at most."""
    slot = F.shiftrightunsigned("hash", 6).bitwiseAND(SLOTS - 1).alias("slot")
    found = hashes.groupBy(slot).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(SLOTS, np.uint64)
    bits[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bits)


@dataclass
class Block:
    """Texts whose words lie one after the other, and the shingles among them that pass a filter, by place."""

    docs: list[tuple]  # doc_id, text
    folded: bytes
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # the first word of each text, and the end
    places: np.ndarray
    hashes: np.ndarray


def block_of(docs: list[tuple], sizes: list[int], bits: np.ndarray) -> Block:
    parts = [(text or b"").translate(WORD_BYTES) for _, text in docs]
    folded = b" ".join(parts)
    starts, ends, h = word_hashes(folded)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in parts)]))
    last = np.repeat(bounds[1:], np.diff(bounds))
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in sizes:
        s = shingle_hashes(h, k)
        hit = np.flatnonzero(bits[((s >> np.uint64(6)) & np.uint64(SLOTS - 1)).view(np.int64)] >> (s & np.uint64(63)) & np.uint64(1))
        hit = hit[last[hit] - hit >= k]
        places.append(hit)
        hashes.append(s[hit])
    at, found = np.concatenate(places), np.concatenate(hashes)
    order = np.argsort(at, kind="stable")
    return Block(docs, folded, starts, ends, bounds, at[order], found[order].view(np.int64))


def blocks(batches: Iterator[pa.RecordBatch], sizes: list[int], bits: np.ndarray) -> Iterator[Block]:
    held, size = [], 0
    for batch in batches:
        for doc, text in pairs(batch, "doc_id", "text"):
            held.append((doc, text))
            size += len(text or b"") + 1
            if size >= BLOCK:
                yield block_of(held, sizes, bits)
                held, size = [], 0
    if held:
        yield block_of(held, sizes, bits)


def shingle_counts(docs: DataFrame, sizes: list[int], wanted: Broadcast, held: int = 200_000) -> DataFrame:
    """hash, n: how often all documents have each shingle that passes the filter; tasks combine up to `held` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}

        def rows() -> Iterator[tuple]:
            for block in blocks(batches, sizes, wanted.value):
                found, n = np.unique(block.hashes, return_counts=True)
                for h, k in zip(found.tolist(), n.tolist(), strict=True):
                    counts[h] = counts.get(h, 0) + k
                if len(counts) > held:
                    yield from counts.items()
                    counts.clear()
            yield from counts.items()

        return emitted(COUNTS, rows(), 1 << 14)

    return texts(docs).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def prefixes(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """window, size, hash, place: each distinct window's rarest shingle (ties by hash) and where in the window it is first."""
    distinct = windows.groupBy("window").agg(F.first("size").alias("size"), F.first("hashes").alias("hashes"))
    each = distinct.select("window", "size", F.posexplode("hashes").alias("place", "hash"))
    counts = shingle_counts(docs, sizes, filter_of(each.select("hash")))
    led = each.join(counts, "hash", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "place")).alias("f"))
    return led.select("window", "size", "f.hash", "f.place")


def read_documents(docs: DataFrame, sizes: list[int], wanted: Broadcast, width: int) -> DataFrame:
    """doc_id, n_words, digest (MD5 of a text with hits), hits of each row of docs: prefix tokens, each with the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for x in blocks(batches, sizes, wanted.value):
                of = np.searchsorted(x.places, x.bounds)
                for i, (doc, text) in enumerate(x.docs):
                    first, end, hits = int(x.bounds[i]), int(x.bounds[i + 1]), []
                    for p, h in zip(x.places[of[i] : of[i + 1]].tolist(), x.hashes[of[i] : of[i + 1]].tolist(), strict=True):
                        left, right = max(first, p - width + 1), min(end, p + width)
                        hits.append({"hash": h, "at": p - first, "lead": p - left, "context": x.folded[x.starts[left] : x.ends[right - 1]]})
                    yield doc, end - first, hashlib.md5(text, usedforsecurity=False).digest() if hits else None, hits

        return emitted(READ, rows(), 1024)

    return texts(docs).mapInArrow(run, READ_DDL)


def verified(read: DataFrame, prefix: DataFrame) -> DataFrame:
    """row, digest, start, end, window: the occurrences of windows among read(row, digest, n_words, hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row, digest, start, skip, size, context, window in pairs(batch, "row", "digest", "start", "skip", "size", "context", "window"):
                    if context.split()[skip : skip + size] == window.split(b" "):
                        yield row, digest, start, start + size, window

        return emitted(FOUND, rows())

    hits = read.select("row", "digest", "n_words", F.explode("hits").alias("h")).select("row", "digest", "n_words", "h.hash", "h.at", "h.lead", "h.context")
    start = F.col("at") - F.col("place")
    joined = hits.join(prefix, "hash").where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    joined = joined.select("row", "digest", start.cast("long").alias("start"), (F.col("lead") - F.col("place")).alias("skip"), "size", "context", "window")
    return joined.mapInArrow(run, "row long, digest binary, start long, end long, window binary")


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What was read of each document with its row number, the occurrences, and the windows of the items."""
    windows = kept(item_windows(benchmark, width), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect())  # SHINGLE rows at most
    prefix = kept(prefixes(docs, windows, sizes), "prefixes")
    read = cut(read_documents(docs, sizes, filter_of(prefix), width).withColumn("row", F.monotonically_increasing_id()))
    return read, kept(verified(read.where(F.size("hits") > 0), prefix), "occurrences"), windows


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs(doc_id, text).

    Documents are read once for the counts of shingles and once for prefix tokens; texts are never shuffled. Tokens are
    counted in tasks before they are shuffled; a token that many documents hold is split by the engine, as its windows
    are few rows. Null texts have no words. Items with equal ids count as one; an item with a null id marks words but is
    not counted or listed. Repeated rows keep a row each.
    """
    read, found, windows = occurrences(docs, benchmark, width)
    spans = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at"))
    add = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["at"]))).alias("n"), F.greatest(a["at"], s["end"]).alias("at"))
    spans = spans.select("row", F.aggregate("spans", start, add)["n"].alias("n_hit"))
    items = windows.where("item is not null").select("window", "item").distinct()
    named = found.select("row", "window").distinct().join(items, "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    with_hits = read.where(F.size("hits") > 0).select("row", "doc_id", "n_words").join(spans, "row", "left").join(named, "row", "left")
    out = read.where(F.size("hits") == 0).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    out = out.unionByName(with_hits.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of docs without an occurrence of a window, all columns, by the same join.

    Contaminated texts leave by their MD5; the engine broadcasts these if their measured size allows, else it deals texts
    by them, with hot ones split. Null texts stay.
    """
    _, found, _ = occurrences(docs, benchmark, width)
    name = free_name(docs, "text_md5")
    bad = kept(found.select(F.col("digest").alias(name)).distinct(), "contaminated")
    return docs.withColumn(name, F.unhex(F.md5(F.col("text").cast("binary")))).join(bad, name, "left_anti").select(*docs.columns)
