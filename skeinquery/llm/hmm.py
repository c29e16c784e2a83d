"""Scores of whole texts by a hidden Markov language model.

The model's alphabet is the end of a text, every training word, and words without training, of which each has an add-one
share. Baum-Welch runs over all training texts: tasks add up expected counts over whole sequences, a shuffle by word
sums them. The driver re-estimates the moves and the emissions of a bounded head of frequent words; those of all other
words, however many, stay in the shared folder. Scaled forward recursion gives the exact likelihood of each text.
"""

from __future__ import annotations

import gc
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinquery.llm.common import emitted, fold, pairs, record_batch, shared_path, texts

END = b" "  # no word holds a space
BLOCK = 1 << 21  # tokens that a task holds at a time
PART = 1 << 17  # tokens of a block that lie in a row
SLICE = 256  # symbols of the head whose sums go together
#: Rows that blocks of texts and buckets of words send each other, by kind; `dest` is a block, a bucket, or below 0 for sums.
TEXTS, ASKED, WORDS, COUNTS, WEIGHTS, SUMS = range(6)
ROW = pa.schema([("dest", pa.int64()), ("kind", pa.int32()), ("learned", pa.bool_()), ("source", pa.int64()), ("data", pa.binary()), ("docs", pa.list_(pa.int64()))])
ROW_DDL = "dest long, kind int, learned boolean, source long, data binary, docs array<long>"


@dataclass
class Model:
    start: np.ndarray  # S
    move: np.ndarray  # S x S
    emit: np.ndarray  # symbols x S; symbol 0: end, then words


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def symbol_ids(words: list[bytes], symbols: dict[bytes, int], other: int) -> np.ndarray:
    """Symbols of a text's words, then of its end."""
    return np.fromiter(chain(map(symbols.get, words, repeat(other)), (0,)), np.int32, len(words) + 1)


def count_words(docs: DataFrame, held: int = 200_000) -> DataFrame:
    """word (bytes, the end as a space), n over docs(text). Tasks combine up to `held` words before they send them."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            counts: Counter = Counter()
            for batch in batches:
                for (text,) in pairs(batch, "text"):
                    counts.update(tokens(text))
                    counts[END] += 1
                    if len(counts) > held:
                        yield from counts.items()
                        counts.clear()
            yield from counts.items()

        return emitted(schema, rows(), 1 << 14)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words of counts(word, n), at most `most`, most frequent first, ties by word.

    Counts fall into steps of a sixteenth of a doubling; whole steps are taken from the top while they fit, so the
    driver gets a row for each step and then the words themselves, at any size of the corpus.
    """
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    left, lowest = most, None
    for s, size in sorted(counts.groupBy(step).agg(F.count("*")).collect(), reverse=True):
        if size > left:
            break
        left, lowest = left - size, s
    if lowest is None:
        return []
    return sorted(map(tuple, counts.where(step >= lowest).select("word", "n").collect()), key=lambda x: (-x[1], x[0]))


def blocks(seqs: Iterator[np.ndarray], padded: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Sequences of about the same length together: ids (T x rows, longest row first), rows alive at each step, row numbers."""
    held: list[np.ndarray] = []

    def cut_up() -> Iterator[tuple]:
        order = sorted(range(len(held)), key=lambda i: -len(held[i]))
        at = 0
        while at < len(order):
            t = len(held[order[at]])
            rows = order[at : at + max(1, padded // t)]
            ids = np.zeros((t, len(rows)), np.int32)
            for k, i in enumerate(rows):
                ids[: len(held[i]), k] = held[i]
            lengths = np.array([len(held[i]) for i in rows])
            alive = np.searchsorted(-lengths, -np.arange(t), side="left")
            yield ids, alive, rows
            at += len(rows)

    total = 0
    for s in seqs:
        held.append(s)
        total += len(s)
        if total >= BLOCK:
            yield from cut_up()
            held.clear()
            total = 0
    yield from cut_up()


def forward(m: Model, ids: np.ndarray, alive: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list, list, list]:
    """Log likelihood (natural) of each row, by the scaled forward recursion; with `keep` each step's scaled states (S x rows), scales and emissions."""
    likelihood, emit, move = np.zeros(ids.shape[1]), np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
    states, scales, emitted_, a = [], [], [], None
    for t, n in enumerate(alive.tolist()):
        e = np.take(emit, ids[t, :n], axis=1)
        a = m.start[:, None] * e if t == 0 else (move @ a[:, :n]) * e
        c = a.sum(0)
        a /= c
        likelihood[:n] += np.log(c, dtype=np.float64)
        if keep:
            states.append(a)
            scales.append(c)
            emitted_.append(e)
    return likelihood, states, scales, emitted_


def expected_counts(m: Model, ids: np.ndarray, alive: np.ndarray, emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> float:
    """Adds a block's expected counts to emit, move and start; the block's log likelihood."""
    likelihood, states, scales, es = forward(m, ids, alive, keep=True)
    total = int(alive.sum())
    gamma, seen = np.empty((len(m.start), total), m.emit.dtype), np.empty(total, np.int32)
    pairs_, at, b = np.zeros_like(m.move), total, np.ones_like(states[-1])
    for t in range(len(alive) - 1, -1, -1):
        n = int(alive[t])
        if t < len(alive) - 1:
            k = int(alive[t + 1])
            nxt = es[t + 1]
            nxt *= b[:, :k]
            nxt /= scales[t + 1]
            pairs_ += states[t][:, :k] @ nxt.T
            b = np.ones_like(states[t])
            b[:, :k] = m.move @ nxt
            es[t + 1] = None
        np.multiply(states[t], b, out=gamma[:, at - n : at])
        seen[at - n : at] = ids[t, :n]
        at -= n
    move += m.move * pairs_
    start += gamma[:, : int(alive[0])].sum(1)
    for s in range(emit.shape[1]):
        emit[:, s] += np.bincount(seen, weights=gamma[s], minlength=len(emit))
    return float(likelihood.sum())


def re_estimated(emit: np.ndarray, move: np.ndarray, start: np.ndarray, prior: np.ndarray) -> Model:
    """A model from expected counts; `prior` is added to each symbol's, so that nothing gets 0."""
    one = lambda x: (x + 1 / x.shape[-1]) / (x + 1 / x.shape[-1]).sum(-1, keepdims=True)
    e = emit + prior[:, None]
    return Model(one(start), one(move), e / e.sum(0))


def squeezed(x: np.ndarray) -> bytes:
    """An array's bytes, those of the same place together, compressed without loss."""
    planes = np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T)
    return planes.size.to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def rounded(x: np.ndarray) -> np.ndarray:
    """Non-negative float32 numbers to 17 significant bits: what rounds hand on of rare words, a quarter smaller."""
    return ((np.ascontiguousarray(x, np.float32).view(np.uint32) + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32)


def expanded(data: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def key_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def random_share(keys: np.ndarray, states: int) -> np.ndarray:
    """Numbers from 0.5 to 1.5 for each key and state, the same wherever they are made."""
    x = keys[:, None] ^ (np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return 0.5 + (x >> np.uint64(40)) / float(1 << 24)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a finished round; that round's shuffle files go as the driver collects its garbage."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def vocabulary(counts: DataFrame, symbols: Broadcast, bits: int) -> DataFrame:
    """WORDS rows: hashes and counts of the words outside the head, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = symbols.value
        for batch in batches:
            own = [(key_of(w), n) for w, n in pairs(batch, "word", "n") if w not in head and w != END]
            if own:
                keys, n = np.array([k for k, _ in own], np.uint64), np.array([n for _, n in own], np.uint64)
                order = np.argsort(keys)
                keys, n = keys[order], n[order]
                for bucket, a, b in spans(keys, bits):
                    yield record_batch(ROW, [(bucket, WORDS, True, 0, np.stack([keys[a:b], n[a:b]]).tobytes(), None)])

    return counts.mapInArrow(run, ROW_DDL)


def spans(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Bucket, start and end of the runs of sorted hashes with the same first bits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else bucket
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=False)]


def encoded(source: DataFrame, symbols: Broadcast, bits: int) -> DataFrame:
    """TEXTS rows, the parts of blocks of texts, and ASKED rows: the hashes of a block's words outside the head, by bucket.

    In a block, symbol 0 is the end, the head's words follow, then the block's other words by hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, block = symbols.value, TaskContext.get().partitionId() << 32

        def packed(docs: list, seqs: list[np.ndarray], others: dict[bytes, int], learned: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block
            keys, rank = np.unique(np.fromiter(map(key_of, others), np.uint64, len(others)), return_inverse=True)
            ids = np.concatenate(seqs)
            at = np.flatnonzero(ids < 0)
            ids[at] = len(head) + 1 + rank[-1 - ids[at]]
            for i in range(0, len(ids), PART):
                yield record_batch(ROW, [(block, TEXTS, learned, i, squeezed(ids[i : i + PART]), None if i else docs)])
            yield from emitted(ROW, ((bucket, ASKED, learned, block, squeezed(keys[a:b]), None) for bucket, a, b in spans(keys, bits)), 32)
            block += 1

        held: dict[bool, list] = {y: [[], [], {}, 0] for y in (False, True)}
        for batch in batches:
            for doc, text, learned in pairs(batch, "doc_id", "text", "learned"):
                docs, seqs, others, _ = own = held[learned]
                words = tokens(text)
                ids = symbol_ids(words, head, -1)
                at = np.flatnonzero(ids < 0)
                ids[at] = [-1 - others.setdefault(words[i], len(others)) for i in at.tolist()]
                docs.append(doc)
                seqs.append(ids)
                own[3] += len(ids)
                if own[3] >= BLOCK:
                    yield from packed(docs, seqs, others, learned)
                    held[learned] = [[], [], {}, 0]
        for learned, (docs, seqs, others, _) in held.items():
            if docs:
                yield from packed(docs, seqs, others, learned)

    return source.mapInArrow(run, ROW_DDL)


def opened(table: pa.Table, states: int, told: bool) -> tuple[list, list[np.ndarray], list[int], np.ndarray, np.ndarray]:
    """A block's doc_ids and texts; the buckets of its other words and how many each has; their weights, and with `told` counts."""
    rows = table.to_pylist()
    parts = sorted((r for r in rows if r["kind"] == TEXTS), key=lambda r: r["source"])
    ids = np.concatenate([expanded(r["data"], np.int32) for r in parts])
    seqs = np.split(ids, np.flatnonzero(ids == 0)[:-1] + 1)
    weights, counts, sizes = [np.zeros((0, states), np.float32)], [np.zeros(0, np.int64)], []
    for r in sorted((r for r in rows if r["kind"] == WEIGHTS), key=lambda r: r["source"]):
        cut_at = int.from_bytes(r["data"][:8], "little")
        weights.append(expanded(r["data"][8 : 8 + cut_at], np.float32).reshape(-1, states))
        if told:
            counts.append(expanded(r["data"][8 + cut_at :], np.int64))
        n = len(weights[-1])
        sizes.append((r["source"], n))
    return parts[0]["docs"], seqs, sizes, np.concatenate(weights), np.concatenate(counts)


def learn(rows: DataFrame, model: Broadcast, states: int) -> DataFrame:
    """COUNTS rows, the expected counts of each block's other words by bucket, and SUMS rows for the head and the moves."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, seqs, sizes, weights, _ = opened(table, states, False)
        start, move, head, total = model.value
        m = Model(start.astype(np.float32), move.astype(np.float32), np.concatenate([head, weights / total]).astype(np.float32))
        emit, moves, starts = np.zeros(m.emit.shape), np.zeros((states, states)), np.zeros(states)
        for ids, alive, _ in blocks(iter(seqs)):
            expected_counts(m, ids, alive, emit, moves, starts)
        block, at, out = key[0].as_py(), len(head), []
        out.append((-1, SUMS, True, block, np.concatenate([moves.ravel(), starts, emit[at:].sum(0)]).tobytes(), None))
        out += [(-2 - i, SUMS, True, block, emit[i : min(at, i + SLICE)].tobytes(), None) for i in range(0, at, SLICE)]
        for bucket, n in sizes:
            out.append((bucket, COUNTS, True, block, squeezed(rounded(emit[at : at + n])), None))
            at += n
        return pa.Table.from_batches([record_batch(ROW, out)])

    return rows.groupBy("dest").applyInArrow(run, ROW_DDL)


def exchange(rows: DataFrame, states: int, first: bool, told: bool) -> DataFrame:
    """WEIGHTS rows for each block that asks, and the totals of SUMS rows, at first each bucket's.

    A word's weights are its expected counts plus an equal part of one for each state; at first, its count spread at
    random. A word without training has the part of one alone. With `told` counts go along.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dest, rows = key[0].as_py(), table.to_pylist()
        if dest < 0:
            total = np.sum([np.frombuffer(r["data"]) for r in rows], 0)
            return pa.Table.from_batches([record_batch(ROW, [(dest, SUMS, True, 0, total.tobytes(), None)])])
        words = np.concatenate([np.zeros((2, 0), np.uint64), *(np.frombuffer(r["data"], np.uint64).reshape(2, -1) for r in rows if r["kind"] == WORDS)], 1)
        keys, rank = np.unique(words[0], return_inverse=True)
        n = np.zeros(len(keys) + 1, np.int64)  # the last is for words without training
        np.add.at(n, rank, words[1].astype(np.int64))
        sums, place = np.zeros((len(keys) + 1, states)), {}
        for r in rows:
            if r["kind"] == ASKED:
                asked = expanded(r["data"], np.uint64)
                at = np.searchsorted(keys, asked)
                there = np.append(keys, np.uint64(0))[at] == asked
                place[r["source"]] = r["learned"], np.where(there & (at < len(keys)), at, len(keys))
        for r in rows:
            if r["kind"] == COUNTS:
                sums[place[r["source"]][1]] += expanded(r["data"], np.float32).reshape(-1, states)
        weights = sums + 1 / states
        if first:
            weights[:-1] = (n[:-1, None] + 1) / states * random_share(keys, states)
        weights = rounded(weights)
        out = []
        for block, (wanted, at) in place.items():
            w = squeezed(weights[at])
            out.append((block, WEIGHTS, wanted, dest, len(w).to_bytes(8, "little") + w + (squeezed(n[at]) if told else b""), None))
        if first:
            out.append((-1, SUMS, True, dest, weights[:-1].sum(0, dtype=np.float64).tobytes(), None))
        return pa.Table.from_batches([record_batch(ROW, out)])

    return rows.groupBy("dest").applyInArrow(run, ROW_DDL)


def score_texts(docs: DataFrame, training: Column, head: int = 20_000, states: int = 6, rounds: int = 3) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs(doc_id, text).

    `training`: a condition on doc_id; rows where it is not true are scored only. Null texts are empty (the end alone);
    repeated rows count and are scored one by one. Without training rows the base share is 1 for every token and the
    model is its starting point. Every training word has its own emissions. Those of the `head` most frequent words, at
    most, are broadcast; those of all others lie in buckets by 64-bit hash, as many as the vocabulary and its tokens ask
    for. Texts are held in blocks of a bounded number of tokens; in each round a block gets the emissions of its words
    from their buckets and sends back expected counts, once for each distinct word.
    """
    spark = docs.sparkSession
    source = texts(docs)
    learned = source.where(F.coalesce(training, F.lit(False)))
    path = shared_path(spark, "hmm")
    count_words(learned).write.parquet(f"{path}/counts")
    counts = spark.read.schema("word binary, n long").parquet(f"{path}/counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("word") == F.lit(END)).select("n").first()
    top = frequent_words(counts.where(F.col("word") != F.lit(END)), head)
    symbols = spark.sparkContext.broadcast({bytes(w): i + 1 for i, (w, _) in enumerate(top)})
    known = np.array([ends[0] if ends else 0, *(c for _, c in top)], np.int64)
    rest_n, rest_v = n - int(known.sum()), v - int((known > 0).sum())
    bits = max(4, math.ceil(math.log2(max(rest_n / (1 << 19), rest_v / (1 << 15), 1))))
    k = len(known)

    stored = lambda name: spark.read.schema(ROW_DDL).parquet(f"{path}/{name}")
    rows = source.withColumn("learned", F.coalesce(training, F.lit(False)))
    encoded(rows, symbols, bits).write.partitionBy("kind", "learned").parquet(f"{path}/texts")
    vocabulary(counts, symbols, bits).write.partitionBy("kind", "learned").parquet(f"{path}/words")
    remove(spark, f"{path}/counts")
    of = lambda kind: stored("texts").where(F.col("kind") == kind)

    prior = np.append(np.full(k, 1 / states), (rest_v + 1) / states)  # add-one, the one in equal parts for the states
    sticky = (0.9 * np.eye(states) + 0.1 / states) * (k + rest_v)  # states that last tell languages and topics apart in few rounds
    asked, words = of(ASKED).where("learned"), stored("words")
    totals = lambda i: [(r.dest, np.frombuffer(r.data)) for r in stored(f"round-{i}").where(F.col("kind") == SUMS).select("dest", "data").collect()]  # noqa: E731  a row for each slice of the head, at first for each bucket
    exchange(asked.unionByName(words), states, True, rounds == 0).write.partitionBy("kind", "learned").parquet(f"{path}/round-0")
    keys = np.array([key_of(END), *(key_of(w) for w, _ in top)], np.uint64)
    total = np.sum([np.full(states, 1 / states), *(x for _, x in totals(0))], 0)
    emit = np.vstack([(known[:, None] + 1) / states * random_share(keys, states), total])
    model, total = re_estimated(emit - prior[:, None], sticky, np.ones(states), prior), emit.sum(0)
    for i in range(rounds):
        shared = spark.sparkContext.broadcast((model.start, model.move, model.emit[:-1], total))  # plain data: workers may lack the package
        last = i == rounds - 1
        sent = learn(of(TEXTS).where("learned").unionByName(stored(f"round-{i}").where(F.col("kind") == WEIGHTS)), shared, states)
        exchange(sent.unionByName(of(ASKED) if last else asked).unionByName(words), states, False, last).write.partitionBy("kind", "learned").parquet(f"{path}/round-{i + 1}")
        emit, moves = np.zeros((k + 1, states)), np.zeros(states * states + 2 * states)
        for dest, x in totals(i + 1):
            if dest == -1:
                moves = x
            else:
                emit[-2 - dest : -2 - dest + len(x) // states] = x.reshape(-1, states)
        emit[-1] = moves[-states:]
        model, total = re_estimated(emit, moves[: states * states].reshape(states, states), moves[states * states : -states], prior), (emit + prior[:, None]).sum(0)
        remove(spark, f"{path}/round-{i}")
    shared = spark.sparkContext.broadcast((model.start, model.move, model.emit[:-1], total, known))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    own = float(np.log10(n + v + 1))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids_of, seqs, _, weights, rest = opened(table, states, True)
        start, move, first, total, known = shared.value
        m, counts = Model(start, move, np.concatenate([first, weights / total])), np.concatenate([known, rest])
        base, seen = np.log10(counts + 1) - own, counts > 0
        out = []
        for ids, alive, order in blocks(iter(seqs)):
            for i, log in zip(order, forward(m, ids, alive)[0] / np.log(10), strict=True):
                out.append((ids_of[i], len(seqs[i]), int(seen[seqs[i]].sum()), float(base[seqs[i]].sum()), float(log)))
        return pa.Table.from_batches([record_batch(schema, out)])

    scored = of(TEXTS).unionByName(stored(f"round-{rounds}").where(F.col("kind") == WEIGHTS)).groupBy("dest").applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc_id: Column) -> Column:
    """True for the fold that the contract keeps from training; a null id is not held out."""
    return F.coalesce(fold(doc_id, 7) == 2, F.lit(False))
