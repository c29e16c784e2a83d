"""Each stage of the pipeline against a plain version on its own input, then the whole."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from skeinquery.llm import packing, secrets, simhash, toxicity
from skeinquery.llm.common import fold, word_list
from skeinquery.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns, by name, after `documents`."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(kept):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert kept[name].columns == kept["documents"].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


def test_toxicity(spark, kept):
    from pyspark.sql import functions as F

    docs, labels = kept["documents"], spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels, fold(F.col("doc_id"), 5) != 0).collect()
    assert set(texts(kept["toxicity"])) == {r.doc_id for r in scored if r.score < 0.5}


def plain_mix(x):
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * c % 2**64
    return x ^ x >> 33


def plain_print(hashes, salt):
    hashes = {plain_mix(h ^ salt) for h in hashes}
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_prints(text):
    """Two SimHashes of the distinct words and four of the distinct five-word shingles, bit by bit."""
    words = [xxhash.xxh64_intdigest(w) for w in text.encode().lower().split()]
    if not words:
        return [0] * 6
    width, shingles = min(5, len(words)), set()
    for i in range(len(words) - width + 1):
        h = 0
        for k in range(width):
            h = (plain_mix(h ^ words[i + k]) + k) % 2**64
        shingles.add(h)
    salts = [0x9E3779B97F4A7C15 * k % 2**64 for k in range(1, 7)]
    return [plain_print(words, x) for x in salts[:2]] + [plain_print(shingles, x) for x in salts[2:]]


def smallest_reachable(ids, linked):
    """The smallest id of each component of the pairs for which linked(a, b)."""
    seen, want = set(), set()
    for i in sorted(ids):
        if i not in seen:
            want.add(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [y for y in ids if y not in seen and linked(x, y)]
    return want


def near_copy(a, b):
    bits = [(x ^ y).bit_count() for x, y in zip(a, b, strict=True)]
    return min(bits[:2]) <= 7 and sum(bits[2:]) <= 48


def test_near_duplicates(kept):
    before, after = texts(kept["toxicity"]), texts(kept["near_duplicates"])
    codes = {i: plain_prints(t) for i, t in before.items()}
    want = smallest_reachable(codes, lambda a, b: near_copy(codes[a], codes[b]))
    assert set(after) == want and all(after[i] == before[i] for i in after)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_of_similarity_08_are_found(spark):
    """Copies with more and more words changed, as a dense group, as pairs and among texts of common words."""
    rng, rows = np.random.default_rng(5), []
    for group in range(60):
        base = [f"w{x}" for x in rng.zipf(1.3, 300) % 5000]
        for copy in range(40 if group == 0 else 3):
            words = list(base)
            for at in rng.choice(300, copy % 8, replace=False):
                words[at] = f"new{rng.integers(10**6)}"
            rows.append((1000 * group + copy, " ".join(words)))
    kept_ids = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), hot=16).collect()}
    sets, codes = {i: shingles(t) for i, t in rows}, {i: plain_prints(t) for i, t in rows}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(alike) > 300 and sum(near_copy(codes[a], codes[b]) for a, b in alike) >= 0.95 * len(alike)
    assert kept_ids == smallest_reachable(codes, lambda a, b: near_copy(codes[a], codes[b])) >= {1000 * g for g in range(60)}


def test_decontamination(spark, kept):
    items = [word_list(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def holds(text):
        w = word_list(text.encode())
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    before = texts(kept["near_duplicates"])
    assert set(texts(kept["decontamination"])) == {i for i, t in before.items() if not holds(t)}


def test_secrets(kept):
    before, after = kept["decontamination"].collect(), {r.doc_id: r for r in kept["secrets"].collect()}
    auto = secrets.automaton()
    assert len(after) == len(before)
    for r in before:
        found = secrets.find_secrets(r.text, auto)
        a = after[r.doc_id]
        assert (a.text == r.text and a.n_chars == r.n_chars) if not found else ("[SECRET]" in a.text and a.n_chars == len(a.text))
        assert not re.search("AKIA[A-Z0-9]{12}", a.text)


def test_packing(kept):
    encode, total = packing.encoder(vocabulary_path("byte_bpe_50k.json")), 0
    pieces = kept["packing"].collect()
    for i, t in texts(kept["secrets"]).items():
        ids = np.append(encode(t), 0)
        mine = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        assert sum(n for _, n in mine) == len(ids) and [s for s, _ in mine] == np.cumsum([0, *(n for _, n in mine[:-1])]).tolist()
        total += len(ids)
    assert total == sum(p.length for p in pieces)


def test_run(spark, kept):
    assert sum(r.length for r in corpus_pipeline.run(spark, SF).collect()) == sum(r.length for r in kept["packing"].collect())


def test_packing_keeps_the_ids(kept):
    encode, found = packing.encoder(vocabulary_path("byte_bpe_50k.json")), defaultdict(list)
    for p in sorted(kept["packing"].collect(), key=lambda p: p.start):
        found[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    assert found == {i: [*encode(t).tolist(), 0] for i, t in texts(kept["secrets"]).items()}
