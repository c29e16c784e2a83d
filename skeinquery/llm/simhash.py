"""Near-duplicates by SimHash: all pairs of fingerprints that differ in at most three bits, and their components.

The index is a hierarchy. Its upper nodes are bit patterns that fingerprints share under a mask: four masks of 16 bits,
since with at most three differences one of them is equal (a mask more than differences allowed, in general); a node
that many fingerprints share is split into four finer ones by a further quarter of the free bits, for the same reason,
and these again. Below, fingerprints are sorted by
Gray rank: a tree node keeps the bits that all below it share, less those its parent keeps, so a search adds up
differences from the root and leaves a whole group as soon as they exceed the limit.

`keep_one` takes near copies by their five-word shingles: two fingerprints of a text's distinct words find candidates,
and 256 bits over its distinct shingles, compared in the tree's leaves, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinquery.llm.common import cut, emitted, pairs, texts

SEED = 42
FANOUT = 8
LEVELS = 4  # of shared patterns; at the last 44 bits or so are equal, so a node holds at most some 2 ** 21 fingerprints
CHUNK = 1 << 18  # fingerprints that a task searches together, whole nodes
MOST = 1 << 22  # tree nodes that a search visits at a time
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
WORD_PRINTS, SHINGLE_PRINTS = ("w0", "w1"), ("s0", "s1", "s2", "s3")
PRINTS = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in (*WORD_PRINTS, *SHINGLE_PRINTS))])
SALTS = np.array([0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF for k in range(1, 7)], np.uint64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, n = [0, *ends], len(words) - width + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        spans = range(at, min(n, at + (1 << 15)))
        h = np.fromiter((digest(joined[starts[i] : ends[i + width - 1] - 1], SEED) for i in spans), "<u8", len(spans))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each bit depends on all bits of x."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def majorities(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A SimHash for each salt over hashes."""
    ones = np.zeros(64 * len(salts), np.int64)
    for at in range(0, len(hashes), 255):  # a byte holds the sum of so many bits
        h = np.ascontiguousarray(mixed(hashes[at : at + 255, None] ^ salts))
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def prints(text: bytes | None, width: int = 5) -> list[int]:
    """Signed: two 64-bit SimHashes of a text's distinct words, four of its distinct word shingles; zeros without words."""
    words = (text or b"").lower().split()
    if not words:
        return [0] * 6
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    shingles = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        shingles = mixed(shingles ^ hashes[k : k + len(shingles)]) + np.uint64(k)
    return np.concatenate([majorities(np.unique(hashes), SALTS[:2]), majorities(np.unique(shingles), SALTS[2:])]).view(np.int64).tolist()


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order: neighbours there differ in few bits."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


class GrayIndex:
    """A tree over fingerprints by key, then in Gray order. levels[0] is the top: pattern, mask, first and last key of each node."""

    def __init__(self, codes: np.ndarray, keys: np.ndarray | None = None):
        keys = np.zeros(len(codes), np.int64) if keys is None else keys
        self.order = np.lexsort((gray_rank(codes), keys))
        self.codes, self.keys = codes[self.order], keys[self.order]
        ands, ors, first, last = [self.codes], [self.codes], [self.keys], [self.keys]
        while len(ands[-1]) > FANOUT:
            at = np.arange(0, len(ands[-1]), FANOUT)
            ands.append(np.bitwise_and.reduceat(ands[-1], at))
            ors.append(np.bitwise_or.reduceat(ors[-1], at))
            first.append(first[-1][at])
            last.append(last[-1][np.minimum(at + FANOUT, len(last[-1])) - 1])
        masks = [~(a ^ o) for a, o in zip(ands, ors, strict=True)]
        self.levels = []
        for k in range(len(masks) - 1, -1, -1):
            above = np.zeros(len(masks[k]), np.uint64) if k == len(masks) - 1 else np.repeat(masks[k + 1], FANOUT)[: len(masks[k])]
            self.levels.append((ands[k], masks[k] & ~above, first[k], last[k]))

    def search(self, queries: np.ndarray, most: int, keys: np.ndarray | None = None, skip=None, limit: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """(query number, place in the index) of all codes of the query's key within `most` bits.

        skip(level, q, node) may leave out groups. None if more than `limit` nodes would be held at a time.
        """
        keys = np.zeros(len(queries), np.int64) if keys is None else keys
        top = len(self.levels[0][0])
        q, node = np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries))
        gone = np.zeros(len(q), np.uint8)
        for k, (pattern, mask, first, last) in enumerate(self.levels):
            if k:
                if limit and len(q) * FANOUT > limit:
                    return None
                size = len(pattern)
                q, gone = np.repeat(q, FANOUT), np.repeat(gone, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                there = node < size
                q, node, gone = q[there], node[there], gone[there]
            own = keys[q]
            keep = np.flatnonzero((first[node] <= own) & (own <= last[node]))
            q, node, gone = q[keep], node[keep], gone[keep]
            gone = gone + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            keep = gone <= most
            if skip is not None:
                keep &= ~skip(k, q, node)
            q, node, gone = q[keep], node[keep], gone[keep]
        return q, node


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]; a label is the smallest place of its component."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low, root = np.minimum(x, y), np.arange(len(label))
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def spanning_links(codes: np.ndarray, most: int, keys: np.ndarray | None = None, wide: np.ndarray | None = None, far: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in codes) that connect just what all pairs of equal key within `most` bits connect.

    With `wide`, a row of further 64-bit words for each code, a pair must be within `far` bits there, too.

    Queries go through the index in its order; a group that already lies in the query's component is skipped, so a
    dense cluster costs about its size, not its square. A step takes as many queries as its search has room for.
    """
    index = GrayIndex(codes, keys)
    wide = None if wide is None else wide[index.order]
    n, depth = len(codes), len(index.levels) - 1
    label, at, step = np.arange(n), 0, 1 << 12
    while at < n:
        lows, highs, lasts = [label], [label], [np.arange(n)]
        for _ in range(depth):
            cuts = np.arange(0, len(lows[-1]), FANOUT)
            lows.append(np.minimum.reduceat(lows[-1], cuts))
            highs.append(np.maximum.reduceat(highs[-1], cuts))
            lasts.append(np.maximum.reduceat(lasts[-1], cuts))
        while True:
            own = label[at : at + step]

            def skip(k: int, q: np.ndarray, node: np.ndarray, at=at, own=own, lows=lows, highs=highs, lasts=lasts) -> np.ndarray:
                low, high, last = lows[depth - k][node], highs[depth - k][node], lasts[depth - k][node]
                return (low == high) & (low == own[q]) | (last <= at + q)

            found = index.search(index.codes[at : at + step], most, index.keys[at : at + step], skip, MOST if step > 1 else None)
            if found is not None:
                break
            step = max(1, step // 8)
        a, b = at + found[0], found[1]
        if wide is not None:
            near = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int16) for w in wide.T) <= far
            a, b = a[near], b[near]
        label = merged(label, a, b)
        at, step = at + step, min(2 * step, 1 << 15)
    far = np.flatnonzero(label != np.arange(n))
    return index.order[far], index.order[label[far]]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def finer(mask: int, parts: int = 4) -> list[int]:
    """So many masks: `mask` and an equal part of the bits outside it each."""
    free = [k for k in range(64) if not mask >> k & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def nodes(codes: DataFrame, hot: int, parts: int = 4, levels: int = LEVELS) -> DataFrame:
    """mask, pattern and the columns of codes(fp, rep, ...): the upper nodes that each code lies in.

    A node of more than `hot` codes is split, level by level; counts are combined before they are shuffled.
    """
    level = finer(0, parts)
    held = codes.select("*", F.explode(F.array(*(F.lit(signed(m)) for m in level))).alias("mask"))
    for _ in range(levels - 1):
        held = held.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        crowded = cut(held.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("mask", "pattern", F.lit(True).alias("hot")))
        if crowded.isEmpty():
            return held
        below = {m: finer(m, parts) for m in level}
        table = F.create_map(*(x for m, ms in below.items() for x in (F.lit(signed(m)), F.array(*(F.lit(signed(y)) for y in ms)))))
        split = F.when(F.col("hot"), table[F.col("mask")]).otherwise(F.array("mask"))
        held = held.join(crowded, ["mask", "pattern"], "left").select(*codes.columns, F.explode(split).alias("mask"))
        level = [x for ms in below.values() for x in ms]
    return held.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))


def links(codes: DataFrame, most: int = 3, hot: int = 4096, wide: tuple[str, ...] = (), far: int = 0) -> DataFrame:
    """u, v over codes(fp, rep): pairs of reps whose links connect what all pairs within `most` bits connect.

    With columns `wide` a pair must be within `far` bits over these, too. `hot` only says when an upper node is split
    into finer ones; the links are the same. fp (with `wide`) should be distinct. Over three bits take eight masks (seven
    at most) and a level of splits less, as each split multiplies rows by the masks.
    """
    if most > 7:
        raise ValueError("eight masks find pairs with seven differences at most")
    parts, levels = (4, LEVELS) if most <= 3 else (8, LEVELS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            a, b = spanning_links(np.ascontiguousarray(rows[:, 2]).view(np.uint64), most, np.cumsum(np.r_[0, new]), np.ascontiguousarray(rows[:, 4:]).view(np.uint64) if wide else None, far)
            for at in range(0, len(a), 1 << 16):
                yield pa.record_batch([pa.array(rows[x[at : at + (1 << 16)], 3]) for x in (a, b)], schema=LINKS)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            size += batch.num_rows
            if size >= CHUNK and (held[0][0, :2] != held[-1][-1, :2]).any():  # all but the last node have ended
                rows = np.concatenate(held)
                at = int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))[-1]) + 1
                yield from found(rows[:at])
                held, size = [rows[at:]], len(rows) - at
        if held:
            yield from found(np.concatenate(held))

    dealt = nodes(codes.select("fp", "rep", *wide), hot, parts, levels).select("mask", "pattern", "fp", "rep", *wide).repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    return dealt.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root over edges(u, v): the smallest node of each component of two or more, without the root's own row.

    Large-star and small-star steps in turn, each a group by node and a join, until nothing changes; every round is
    written to the shared folder, so neither lineage nor a task or the driver grows with a component.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = mark(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        pairs_ = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        e = cut(pairs_.select("p.u", "p.v").where("u <> v").distinct())
        now = mark(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, most: int = 3, hot: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of docs(doc_id, text).

    component_id is the smallest doc_id that links of at most `most` bits reach. Null and blank texts have fingerprint 0
    and link like others. Exact repeats meet in a combined group by fingerprint and are joined back on it; repeated rows
    keep a row each. A row with a null doc_id takes the component of rows with its fingerprint, if they have ids, and
    makes no link itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in pairs(batch, "doc_id", "text"):
                    fp = fingerprint(text)
                    yield doc, fp - (1 << 64) if fp >> 63 else fp

        return emitted(FINGERPRINTS, rows())

    fps = cut(texts(docs).mapInArrow(run, "doc_id long, fp long"))
    codes = cut(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(codes, most, hot))
    codes = codes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(codes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, most: int = 7, far: int = 48, hot: int = 1 << 14) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their group of near copies, a row for each group.

    Two texts are near copies if one of their two fingerprints of distinct words differs in `most` bits at most, and the
    256 bits over their distinct five-word shingles (fewer words: all of them) in `far` at most. Texts of Jaccard
    similarity 0.8 differ in 39 of these on average, with a deviation of 6, so that `far` leaves room for chance.
    Groups are what such pairs connect. Words are runs without white space, with A-Z lower-cased; null and blank texts
    are copies of each other. Where rows share the doc_id that stays, each different text of theirs does, once. Rows
    with a null doc_id stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emitted(PRINTS, ((doc, *prints(text)) for batch in batches for doc, text in pairs(batch, "doc_id", "text")))

    named, columns = docs.where("doc_id is not null"), [*WORD_PRINTS, *SHINGLE_PRINTS]
    found = texts(named).mapInArrow(run, ", ".join(f"{n} long" for n in PRINTS.names))
    codes = cut(found.groupBy(*columns).agg(F.min("doc_id").alias("rep")))
    edges = [links(codes.withColumnRenamed(w, "fp"), most, hot, SHINGLE_PRINTS, far) for w in WORD_PRINTS]
    roots = components(edges[0].unionByName(edges[1]))
    firsts = codes.select("rep").distinct().join(roots, F.col("rep") == F.col("node"), "left_anti").select(F.col("rep").alias("doc_id"))
    kept = named.join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
