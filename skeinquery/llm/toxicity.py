"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own vector, if the sample has it often enough, plus the mean of the vectors of its character
3- and 4-grams. Windows of words overlap by half and cover the whole text; two gated recurrences read a window from both
sides, attention pools their states, and a text's score is that of its highest window, calibrated on training texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinquery.llm.common import emitted, fold, pairs, text_bytes, texts, word_list

WIDTH, STRIDE = 48, 24
MOST_WORD = 64  # bytes; longer words, as of scripts without spaces, are read in pieces
GRAMS, DIM, HIDDEN, ATTEND = 1 << 13, 12, 8, 8
#: Texts of label 0 and 1 in the sample that is learnt from, at most, and bytes of each.
MOST_EACH, MOST_BYTES = (1600, 900), 8000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def window_starts(n: int) -> list[int]:
    """Starts of the windows of a text of n words: every STRIDE words, the last flush with the end."""
    return [*range(0, max(1, n - WIDTH), STRIDE), *([n - WIDTH] if n > WIDTH else [])] if n else []


def spoken(text: bytes | None) -> list[bytes]:
    """The words of a text; one of over MOST_WORD bytes as pieces that overlap by 3, so that each 3- and 4-gram is whole in one."""
    words = word_list(text)
    if len(max(words, key=len, default=b"")) <= MOST_WORD:
        return words
    step = MOST_WORD - 3
    return [w[i : i + MOST_WORD] for w in words for i in range(0, max(1, len(w) - 3), step)]


def gram_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the character 3- and 4-grams of words (bytes, between two marks), whose they are, and how many each has."""
    marked = [b"\x02" + w + b"\x03" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    text = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))  # characters from here to the word's end
    h, flat, whose = text, [], []
    for k in (2, 3, 4):
        h = h[:-1] * np.uint32(0x01000193) ^ text[k - 1 :]
        if k > 2:
            at = np.flatnonzero(left[: len(h)] >= k)
            flat.append(((h[at] ^ np.uint32(k)) * np.uint32(0x9E3779B1) >> np.uint32(19)).astype(np.int64))
            whose.append(owner[at])
    return np.concatenate(flat), np.concatenate(whose), np.maximum(1, sizes - 2) + np.maximum(0, sizes - 3)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    vocabulary: dict[bytes, int]  # word -> row of `word`; row 0 is for all others
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """Input vectors of words, and what the gradient needs."""
        rows = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        flat, whose, sizes = gram_ids(words)
        vectors, n3 = self.p["gram"][flat], len(words)
        sums = np.zeros((n3, DIM), np.float32)
        cuts = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])  # runs: all words' 3-grams, then their 4-grams
        np.add.at(sums, whose[cuts], np.add.reduceat(vectors, cuts))
        return self.p["word"][rows] + sums / sizes[:, None].astype(np.float32), (rows, flat, whose, sizes)

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p[f"in_{d}"] + self.p[f"bias_{d}"] for d in "fb"]

    def run(self, gates: list[np.ndarray], ids: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Logits of windows: ids (T x B) into the rows of gates; lengths in words."""
        t, b = ids.shape
        states, tape, full = np.zeros((2, t, b, HIDDEN), np.float32), [[], []], (lengths >= t).all()
        for d, table in enumerate(gates):
            h, back = np.zeros((b, HIDDEN), np.float32), self.p["back_" + "fb"[d]]
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                gx, gh = np.take(table, ids[i], axis=0), h @ back
                zr = sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(gx[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
                new = n + z * (h - n)
                if not full:
                    new *= (lengths > i)[:, None]
                if keep:
                    tape[d].append((i, h, z, r, n, gh[:, 2 * HIDDEN :]))
                h = new
                states[d, i] = h
        both = np.concatenate([states[0], states[1]], axis=2)
        u = np.tanh(both @ self.p["attend"])
        s = u @ self.p["ask"]
        if not full:
            s = np.where(np.arange(t)[:, None] < lengths, s, -1e9)
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * both).sum(0)
        return pooled @ self.p["out"] + self.p["bias"][0], [tape, both, u, a, pooled]

    def gradients(self, x: np.ndarray, ids: np.ndarray, lengths: np.ndarray, kept: list, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights, and of the input vectors x, for the gradient of the logits."""
        tape, both, u, a, pooled = kept
        g = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_both = a[:, :, None] * d_pooled
        d_a = (both * d_pooled).sum(2)
        d_s = a * (d_a - (a * d_a).sum(0))
        d_u = d_s[:, :, None] * self.p["ask"] * (1 - u * u)
        g["ask"] = (u * d_s[:, :, None]).sum((0, 1))
        g["attend"] = np.tensordot(both, d_u, ((0, 1), (0, 1)))
        d_both += d_u @ self.p["attend"].T
        d_x = np.zeros_like(x)
        for d, name in enumerate("fb"):
            d_h, back = np.zeros((ids.shape[1], HIDDEN), np.float32), self.p[f"back_{name}"]
            g[f"back_{name}"], d_gates = np.zeros_like(back), np.zeros((*ids.shape, 3 * HIDDEN), np.float32)
            for i, h, z, r, n, hn in reversed(tape[d]):
                d_h = (d_h + d_both[i, :, d * HIDDEN : (d + 1) * HIDDEN]) * (lengths > i)[:, None]
                d_n = d_h * (1 - z) * (1 - n * n)
                d_z = d_h * (h - n) * z * (1 - z)
                d_r = d_n * hn * r * (1 - r)
                d_gh = np.concatenate([d_z, d_r, d_n * r], 1)
                d_gates[i] = np.concatenate([d_z, d_r, d_n], 1)
                g[f"back_{name}"] += h.T @ d_gh
                d_h = d_h * z + d_gh @ back.T
            flat, where = d_gates.reshape(-1, 3 * HIDDEN), ids.ravel()
            table = np.stack([np.bincount(where, flat[:, k], len(x)) for k in range(3 * HIDDEN)], 1).astype(np.float32)
            g[f"in_{name}"], g[f"bias_{name}"] = x.T @ table, table.sum(0)
            d_x += table @ self.p[f"in_{name}"].T
        return g, d_x


def plain(net: Network) -> tuple:
    """A network as plain data, to be broadcast to workers that may lack the package."""
    return net.vocabulary, net.p, net.slope, net.shift


def fresh(vocabulary: dict[bytes, int], seed: int) -> Network:
    rng = np.random.default_rng(seed)
    r = lambda *s, scale=0.3: rng.normal(0, scale, s).astype(np.float32)
    p = {"word": r(len(vocabulary) + 1, DIM, scale=0.1), "gram": r(GRAMS, DIM)}
    for d in "fb":
        p |= {f"in_{d}": r(DIM, 3 * HIDDEN), f"back_{d}": r(HIDDEN, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32)}
    p["word"][0] = 0
    return Network(vocabulary, p | {"attend": r(2 * HIDDEN, ATTEND), "ask": r(ATTEND), "out": r(2 * HIDDEN), "bias": np.zeros(1, np.float32)})


def windows_of(index: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (WIDTH x windows), lengths and text numbers of the windows of texts given as word numbers."""
    sizes = np.array([len(x) for x in index], np.int64)
    starts = [window_starts(n) for n in sizes.tolist()]
    owner = np.repeat(np.arange(len(index)), [len(x) for x in starts])
    flat = np.concatenate([np.zeros(0, np.int64), *index])
    if not len(flat):
        return np.zeros((WIDTH, 0), np.int64), np.zeros(0, np.int64), owner
    begin = (np.cumsum(sizes) - sizes)[owner] + np.array([s for x in starts for s in x], np.int64)
    last = (np.cumsum(sizes) - 1)[owner]
    at = np.minimum(begin + np.arange(WIDTH)[:, None], last)
    return flat[at], np.minimum(WIDTH, last - begin + 1), owner


def numbered(word_lists: list[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    ids: dict[bytes, int] = {}
    index = [np.array([ids.setdefault(w, len(ids)) for w in words], np.int64) for words in word_lists]
    return list(ids), index


def highest(net: Network, words: list[bytes], windows: tuple, texts_: int) -> tuple[np.ndarray, np.ndarray]:
    """The logit of each window and the highest of each text; the bias where a text has none."""
    ids, lengths, owner = windows
    gates = [np.concatenate(g) for g in zip(*(net.gates(net.inputs(words[i : i + 20_000])[0]) for i in range(0, len(words), 20_000)), strict=True)] if words else []
    logit = np.concatenate([np.zeros(0), *(net.run(gates, ids[:, at : at + 2048], lengths[at : at + 2048])[0] for at in range(0, len(owner), 2048))])
    tops = np.full(texts_, -np.inf)
    np.maximum.at(tops, owner, logit)
    tops[np.isinf(tops)] = float(net.p["bias"][0])
    return logit, tops


def train(sample: list[tuple[bytes, int]], epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 11, least: int = 8, margin: float = 2.0) -> Network:
    """Fits the network to windows of labelled texts by Adam; a slope and a shift then map a text's highest window to its label.

    A text's label holds for the text, not for each of its windows: after the first epoch only those windows of a
    label-1 text count whose logits come within `margin` of its highest. Words and grams that fewer than `least` texts
    have get no vector, and a third of the inputs is left out of each step, so that rare words are not learnt by heart.
    A fifth of the texts is set aside: it picks the epoch and fits slope and shift. Without texts of both labels the
    network stays as it starts, with a shift that says 0.
    """
    lists = [spoken(t) for t, _ in sample]
    label = np.array([y for _, y in sample], np.float32)
    often, often_grams = Counter(w for ws in lists for w in set(ws)), np.zeros(GRAMS, np.int64)
    for ws in lists:
        if ws:
            often_grams[np.unique(gram_ids(list(set(ws)))[0])] += 1
    vocabulary = {w: i + 1 for i, (w, n) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0]))[:4096]) if n >= least}
    net = fresh(vocabulary, seed)
    net.p["gram"][often_grams < least] = 0
    if len(set(label.tolist())) < 2:
        net.shift = -5.0
        return net
    aside = np.arange(len(lists)) % 5 == 4
    words, index = numbered(lists)
    ids, lengths, owner = windows = windows_of(index)
    rng, step, best = np.random.default_rng(seed), 0, (np.inf, None)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    counts = ~aside[owner]
    for epoch in range(epochs):
        order = rng.permutation(np.flatnonzero(counts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            used, local = np.unique(ids[:, pick], return_inverse=True)
            local = local.reshape(WIDTH, -1)
            x, (rows, flat, whose, sizes) = net.inputs([words[i] for i in used])
            there = (rng.random((len(used), 1)) < 2 / 3).astype(np.float32)
            logit, kept = net.run(net.gates(x * there), local, lengths[pick], keep=True)
            error = ((sigmoid(logit) - label[owner[pick]]) / len(pick)).astype(np.float32)
            g, d_x = net.gradients(x * there, local, lengths[pick], kept, error)
            d_x *= there
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], rows, d_x)
            g["word"][0] = 0
            spread = (d_x / sizes[:, None].astype(np.float32))[whose]
            g["gram"] = np.stack([np.bincount(flat, spread[:, k], GRAMS) for k in range(DIM)], 1).astype(np.float32)
            g["gram"][often_grams < least] = 0
            step += 1
            lr = rate * (1 - epoch / (epochs + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                net.p[k] -= lr * first[k] / (np.sqrt(second[k]) + 1e-8)
        logit, tops = highest(net, words, windows, len(lists))
        counts = ~aside[owner] & ((label[owner] == 0) | (logit >= tops[owner] - margin))
        a, b = calibrated(tops[aside], label[aside])
        p = np.clip(sigmoid(a * tops[aside] + b), 1e-6, 1 - 1e-6)
        loss = -float(np.mean(np.where(label[aside] == 1, np.log(p), np.log(1 - p))))
        if loss < best[0]:
            best = loss, Network(vocabulary, {k: v.copy() for k, v in net.p.items()}, a, b)
    return best[1] or net


def calibrated(tops: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression on one input, by Newton steps with a small pull to 1 and 0."""
    w, x = np.array([1.0, 0.0]), np.stack([tops, np.ones_like(tops)], 1)
    for _ in range(30):
        p = sigmoid(x @ w)
        pull = 0.01 * (w - [1.0, 0.0])
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), x.T @ (p - label) + pull)
        w = np.clip(w, -50, 50)
    return float(max(w[0], 0.05)), float(w[1])


class Scorer:
    """Scores texts with a network; gate inputs of up to `most` words are kept between blocks."""

    def __init__(self, net: Network, most: int = 120_000):
        self.net, self.most = net, most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.tables = [np.zeros((0, 3 * HIDDEN), np.float32) for _ in "fb"]

    def learn(self, lists: list[list[bytes]]) -> None:
        known = self.ids
        new = list({w for ws in lists for w in ws if w not in known})
        if len(known) + len(new) > self.most:
            self.clear()
            new = list({w for ws in lists for w in ws})
        for at in range(0, len(new), 1 << 14):
            part = new[at : at + (1 << 14)]
            gates = self.net.gates(self.net.inputs(part)[0])
            base = len(self.tables[0])
            self.tables = [np.concatenate([t, g]) for t, g in zip(self.tables, gates, strict=True)]
            self.ids.update((w, base + i) for i, w in enumerate(part))

    def scores(self, lists: list[list[bytes]]) -> np.ndarray:
        self.learn(lists)
        get = self.ids.__getitem__
        ids, lengths, owner = windows_of([np.fromiter(map(get, ws), np.int64, len(ws)) for ws in lists])
        tops = np.full(len(lists), -np.inf)
        for at in range(0, len(owner), 2048):
            logit = self.net.run(self.tables, ids[:, at : at + 2048], lengths[at : at + 2048])[0]
            np.maximum.at(tops, owner[at : at + 2048], logit)
        tops[np.isinf(tops)] = float(self.net.p["bias"][0])
        return sigmoid(self.net.slope * tops + self.net.shift)


def labelled_sample(docs: DataFrame, labels: DataFrame, training: Column, most_each: tuple[int, int], most_bytes: int) -> list[tuple[bytes, int]]:
    """Training texts and labels, bounded: of the labelled texts of up to most_bytes, at most most_each[y] of label y, those whose ids hash lowest.

    Of an id that labels repeat the highest label counts; each text of an id that docs repeat is taken.
    """
    given = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    given = given.where(F.coalesce(training, F.lit(False)))
    short = texts(docs).where(F.octet_length("text") <= most_bytes)
    given = given.join(short.select("doc_id"), "doc_id", "left_semi")
    chosen = [given.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in enumerate(most_each)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # sum(most_each) rows at most
    rows = short.join(ids, "doc_id").select("doc_id", "text", "toxic")
    return [(bytes(t), y) for _, t, y in sorted(map(tuple, rows.collect()))]


def score_toxicity(docs: DataFrame, labels: DataFrame, training: Column, most_each: tuple[int, int] = MOST_EACH, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, score of each row of docs(doc_id, text), 0 to 1, higher where label 1 is likelier.

    The network learns from a bounded sample (see labelled_sample) of rows for which `training`, a condition on doc_id,
    is true. Every window of every text is scored, in blocks of a bounded number of words; no shuffle. Null and blank
    texts have the score of the network's bias; repeated rows and null ids keep a row each.
    """
    net = docs.sparkSession.sparkContext.broadcast(plain(train(labelled_sample(docs, labels, training, most_each, most_bytes))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(*net.value))

        def rows() -> Iterator[tuple]:
            held, size = [], 0
            for batch in batches:
                for doc, text in pairs(batch, "doc_id", "text"):
                    held.append((doc, spoken(text)))
                    size += len(held[-1][1])
                    if size >= 100_000 or len(held) >= 2000:
                        yield from flush(held)
                        held, size = [], 0
            yield from flush(held)

        def flush(held: list[tuple]) -> Iterator[tuple]:
            if held:
                for (doc, _), s in zip(held, scorer.scores([w for _, w in held]), strict=True):
                    yield doc, float(s)

        return emitted(SCHEMA, rows())

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """True for the fold that the contract keeps from training; a null id is not held out."""
    return F.coalesce(fold(doc_id, 5) == 0, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, training: Column, limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose texts score under `limit`; the same network and windows."""
    net = docs.sparkSession.sparkContext.broadcast(plain(train(labelled_sample(docs, labels, training, MOST_EACH, MOST_BYTES))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(*net.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [spoken(t) for t in text_bytes(part)]
                yield part.filter(pa.array(scorer.scores(lists) < limit))

    return docs.mapInArrow(run, docs.schema)
