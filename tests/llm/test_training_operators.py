"""Each operator against a plain version, a round trip or held-out accuracy, and on odd tables."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from skeinquery.llm import chat, decontaminate, hmm, packing, quality, queries, secrets, simhash, token_counts, toxicity, warc
from skeinquery.llm.common import fold, shared_path, word_list

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = "doc_id long, text string, source string, row long, word string, host string, fp long, key long, n long"
LONG = "long tail of words that go on " * 20_000


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows and ids, and columns named as the operators' own."""
    data = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "a b c\na b c\n# x"), (5, "a b c\na b c\n# x"), (5, "other text"), (None, "a b c\na b c\n# x"), (None, None), (6, "one")]
    return spark.createDataFrame([(i, t, None if i == 6 else "s", 0, "w", "h", 1, 2, 3) for i, t in data], ODD)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def scores():
    return {"▁a": -2.0, "▁": -3.0, "a": -3.5, "b": -3.6, "ab": -4.0, "▁ab": -4.5, "c": -5.0, "abc": -9.0}


# Token counts


def best_split(word, scores):
    low = min(scores.values()) - 10
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        size = len(word[e - 1].encode())
        options = [(best[e - 1][0] + low * size, best[e - 1][1] + size)]
        options += [(best[s][0] + scores[word[s:e]], best[s][1] + 1) for s in range(e) if word[s:e] in scores]
        best.append(max(options, key=lambda x: (x[0], -x[1])))
    return best[-1][1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=9), max_size=20))
def test_trie_counts(words):
    scores = {"▁a": -2.0, "▁": -3.0, "a": -3.5, "b": -3.6, "ab": -4.0, "▁ab": -4.5, "c": -5.0, "abc": -9.0}
    marked = ["▁" + w for w in words]
    assert token_counts.trie_counts(marked, scores) == {w: best_split(w, scores) for w in marked}


def test_token_counts(docs, texts):
    scores = token_counts.piece_scores(queries.vocabulary_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in rows(token_counts.count_tokens(docs, scores, block_words=500))}
    whole = {w: token_counts.trie_counts(["▁" + w], scores)["▁" + w] for t in texts.values() for w in set(WORD.findall(t))}
    for i, t in texts.items():
        words = WORD.findall(t)
        assert (got[i]["n_pretokens"], got[i]["n_tokens"], got[i]["n_bytes"]) == (len(words), sum(whole[w] for w in words), len(t.encode()))


# Secrets


def plain_spans(text):
    found = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


PARTS = ["password", "PassWord", "ſecret", "token", "apikey", "api_key", "=", ": ", " ", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "x9_", "é", "İ", "tokentoken="]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_spans_are_those_of_the_plain_patterns(text):
    got = [s for s in secrets.find_secrets(text, secrets.automaton()) if s[2] in secrets.BASE]
    assert got == plain_spans(text)


def test_secret_checksums(spark, texts, docs):
    body = "abcdefghijABCDEFGHIJ0123456789"
    good = "ghp_" + body + secrets.base62_crc(body)
    auto = secrets.automaton()
    assert [s[2] for s in secrets.find_secrets(f"x {good} npm_{body}{secrets.base62_crc(body)}", auto)] == ["github", "npm"]
    assert not secrets.find_secrets("ghp_" + body + "000000", auto)
    assert secrets.redact(f"a password=b7db7aa4a5fcc78305 {good}.", auto) == "a [SECRET] [SECRET]."
    for r in rows(secrets.scan_secrets(docs)):
        spans = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(secrets.joined(spans).encode()).hexdigest() and r["n_hex"] == sum(s[2] == "hex" for s in spans)


# SimHash


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(codes, ids, most=3):
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= most and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(codes)):
        groups[find(i)].append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


def test_simhash_whole_table(docs, texts):
    got = {r["doc_id"]: r for r in rows(simhash.near_duplicates(docs))}
    ids = sorted(texts)
    codes = [plain_fingerprint(texts[i]) for i in ids]
    assert [got[i]["fingerprint"] for i in ids] == [f"{c:016x}" for c in codes]
    assert {i: got[i]["component_id"] for i in ids} == plain_components(codes, ids)


@pytest.mark.parametrize("hot", [4, 60, 4096])
def test_links_of_dense_groups(spark, hot):
    rng = np.random.default_rng(3)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    codes = {c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for c in centres for _ in range(80)}
    codes = sorted(codes)
    signed = [(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(codes)]
    got = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long, rep long"), hot=hot)).collect()
    labels = dict.fromkeys(range(len(codes))) | {r.node: r.root for r in got}
    assert {i: i if r is None else r for i, r in labels.items()} == plain_components(codes, list(range(len(codes))))


def test_index_finds_all(spark):
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 1 << 14, 3000).astype(np.uint64) << np.uint64(20))
    index = simhash.GrayIndex(codes)
    q, place = index.search(codes[:50], 3)
    want = {(i, int(c)) for i in range(50) for c in codes if int(codes[i] ^ c).bit_count() <= 3}
    assert {(int(a), int(index.codes[b])) for a, b in zip(q, place, strict=True)} == want


def test_one_tree_for_many_keys():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 1 << 9, 4000).astype(np.uint64)
    keys = np.sort(rng.choice(np.r_[np.arange(300), np.zeros(300, int)], 4000))
    a, b = simhash.spanning_links(codes, 1, keys)
    assert (keys[a] == keys[b]).all()
    label = simhash.merged(np.arange(4000), a, b)
    for k in (0, 7, 123):
        own = np.flatnonzero(keys == k)
        want = plain_components([int(c) for c in codes[own]], list(range(len(own))), 1)
        assert [int(label[i]) for i in own] == [int(min(label[own[j]] for j in range(len(own)) if want[j] == want[i])) for i in range(len(own))]
        assert len(set(label[own])) == len(set(want.values()))


def test_masks_part_the_bits():
    level = [0]
    for _ in range(simhash.LEVELS):
        for m in level:
            below = [x & ~m for x in simhash.finer(m)]
            assert sum(below) == (1 << 64) - 1 - m and max(x.bit_count() for x in below) - min(x.bit_count() for x in below) <= 1
        level = [x for m in level for x in simhash.finer(m)]
    assert min(m.bit_count() for m in level) >= 43


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


# Packing


def test_encoder_agrees_with_the_library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path("byte_bpe_50k.json"))
    encode = packing.encoder(queries.vocabulary_path("byte_bpe_50k.json"))
    more = ["<|endoftext|>", "a  b\n\n c\t", "漢字と かな 🙂🙂", "x" * 3000, "\x1c\x85  y", "١٢٣ ½ Ⅷ"]
    more += ["a <|endoftext|> b<|endoftext|><|endoftext", " " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "x" + " 　" * 1000 + "<|endoftext|>" + "\t" * 1500 + " y", "\x1c" * 2000 + " a"]
    for text in [*texts.values(), *more]:
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def check_pieces(pieces, ids_of, size=1024):
    windows, whole = defaultdict(list), defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
        whole[p["doc_id"]].append(p)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at and length > 0
            at += length
        assert at <= size
    for doc, ps in whole.items():
        ids, at = ids_of[doc], 0
        for p in sorted(ps, key=lambda p: p["start"]):
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(part.tobytes())
            at += p["length"]
        assert at == len(ids)
    return windows


def test_packing(spark, docs, texts):
    path = queries.vocabulary_path("byte_bpe_50k.json")
    encode = packing.encoder(path)
    ids = {i: [*encode(t).tolist(), 0] for i, t in texts.items()}
    windows = check_pieces(rows(packing.pack(docs.repartition(6), path, windows=4, merge_tasks=3)), ids)
    lengths = [sum(x for _, x in w) for w in windows.values()]
    assert sum(lengths) == sum(map(len, ids.values()))
    assert sum(1024 - x for x in lengths) < 0.1 * sum(lengths)


def test_packed_sequences_hold_the_ids(spark, docs, texts):
    path = queries.vocabulary_path("byte_bpe_50k.json")
    encode = packing.encoder(path)
    pieces = packing.pack(docs.repartition(3), path, windows=4, merge_tasks=2).persist()
    whole = {r.sequence_id: r.ids for r in packing.sequences(pieces).collect()}
    found = defaultdict(list)
    for p in sorted(rows(pieces), key=lambda p: p["start"]):
        found[p["doc_id"]] += whole[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]]
    pieces.unpersist()
    assert found == {i: [*encode(t).tolist(), 0] for i, t in texts.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=60), st.integers(1, 5))
def test_windows_keep_every_item(sizes, most):
    w, out = packing.Windows(32, most), []
    for i, s in enumerate(sizes):
        out += packing.split(w.put(s, (i, s)))
        assert len(w.open) <= most
    out += [items for _, _, items in w.open]
    assert sorted(i for x in out for i, _ in x) == list(range(len(sizes))) and all(sum(s for _, s in x) <= 32 for x in out)


# Decontamination


def test_contamination_small(spark):
    long = "the quick brown fox jumps over the lazy dog and then some more words here"
    items = spark.createDataFrame([(1, long), (2, "Short one"), (3, None), (4, "..."), (2, "another two"), (None, "lonely item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "X " + long.upper() + ", y"), (2, "a short-one; another two"), (3, "quick brown fox jumps over the lazy dog and"), (4, None), (5, "a lonely item"), (5, "é short é one")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["n_items"], r["contaminated"]) for r in rows(decontaminate.find_contamination(docs, items))}
    assert got == {(1, 17): (15, 1, True), (2, 5): (4, 1, True), (3, 9): (0, 0, False), (4, 0): (0, 0, False), (5, 3): (2, 0, True), (5, 4): (0, 0, False)}
    assert [r["doc_id"] for r in rows(decontaminate.drop_contaminated(docs, items))] == [3, 4, 5]


def test_contamination_on_planted_passages(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    passages = [(10_000 + r.item_id, "some words before, " + re.sub("[a-z]", lambda m: m[0].upper(), r.text) + " and after") for r in items.collect()]
    planted = docs.select("doc_id", "text").unionByName(spark.createDataFrame(passages, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in rows(decontaminate.find_contamination(planted, items))}
    for r in items.collect():
        assert got[10_000 + r.item_id]["n_hit"] >= len(word_list(r.text.encode()))


def test_contamination_with_hot_passages(spark):
    """Items that share passages, a passage that most documents hold, words in repeats, and short items, against all windows one by one."""
    rng = np.random.default_rng(9)
    word = lambda: "w%d" % rng.integers(0, 12)
    shared = [word() for _ in range(30)]
    items = [(i, " ".join([word() for _ in range(rng.integers(0, 25))] + (shared[i % 5 :][: rng.integers(1, 30)] if i % 2 else []))) for i in range(60)] + [(60, "w1 w2"), (61, "w3"), (61, "w4 w4 w4"), (None, "w5 w5")]
    docs = [(i, " ".join([word() for _ in range(rng.integers(0, 60))] + shared * (i % 3 > 0) + [word() for _ in range(5)])) for i in range(90)] + [(90, "w1 " * 4000), (90, "w1 " * 4000)]
    got = Counter(tuple(r.values()) for r in rows(decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))))
    windows = {(i, tuple(w[k : k + 10])) for i, t in items if (w := t.split()) for k in range(max(1, len(w) - 9))}
    want = Counter()
    for d, t in docs:
        w, hit, named = t.split(), set(), set()
        places = {n: defaultdict(list) for n in {len(x) for _, x in windows}}
        for n, at in places.items():
            for k in range(len(w) - n + 1):
                at[tuple(w[k : k + n])].append(k)
        for i, x in windows:
            for k in places[len(x)].get(x, ()):
                hit.update(range(k, k + len(x)))
                named.add(i)
        listed = sorted(str(i) for i in named if i is not None)
        want[d, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)] += 1
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"ab", b"  ", b" ", b"ba", b"abcabcabcabc", b"\xc3\xa9"]), max_size=40).map(b"".join))
def test_word_hashes(text):
    decontaminate.SEGMENT, keep = 8, decontaminate.SEGMENT
    decontaminate.powers.cache_clear()
    starts, ends, h = decontaminate.word_hashes(text)
    decontaminate.SEGMENT = keep
    decontaminate.powers.cache_clear()
    words = text.split()
    assert [text[s:e] for s, e in zip(starts, ends, strict=True)] == words
    assert all((a == b) == (x == y) for a, x in zip(words, h, strict=True) for b, y in zip(words, h, strict=True))


def test_a_full_filter_changes_nothing(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = Counter(tuple(r.values()) for r in rows(decontaminate.find_contamination(docs, items)))
    monkeypatch.setattr(decontaminate, "SLOTS", 4)
    assert Counter(tuple(r.values()) for r in rows(decontaminate.find_contamination(docs, items))) == want


# Quality rules


def test_frequent_lines(spark):
    body = " ".join(f"w{i}" for i in range(60))
    name = lambda i: str(i).translate(str.maketrans("0123456789", "abcdefghij"))
    data = [(i, f"Read  more on page {i}\n{body} {name(i)}", "a") for i in range(30)] + [(100 + i, f"Read more on page {i}\n{body} q{name(i)}", "b") for i in range(4)]
    data += [(200, "\n".join(["read MORE on page 9"] * 14), "a")]
    got = {r["doc_id"]: r for r in rows(quality.apply_rules(spark.createDataFrame(data, "doc_id long, text string, source string")))}
    assert all(got[i]["removed_words"] == 5 and got[i]["kept"] for i in range(30))
    assert all(got[100 + i]["removed_words"] == 0 and got[100 + i]["kept"] for i in range(4))
    assert got[200]["removed_words"] == 70 and not got[200]["kept"] and got[200]["n_dup_lines"] == 13
    ruled = spark.createDataFrame([(1, "\n".join([" ".join(f"z{i}" for i in range(60)), "shared line of eight words in all here"] * 1), "h")] * 12, "doc_id long, text string, source string")
    assert [r["kept"] for r in rows(quality.apply_rules(ruled))] == [False] * 12


def test_cleaned_texts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    data = [(i, f"Menu  {i}\n\n{words}\n {chr(97 + i)} own line\nmenu 7", "a") for i in range(12)] + [(50, f"menu 1\n{words} x", "b"), (51, None, "a")]
    got = {r["doc_id"]: r for r in rows(quality.clean(spark.createDataFrame(data, "doc_id long, text string, source string")))}
    assert all(got[i]["text"] == f"\n {chr(97 + i)} own line" and got[i]["removed_words"] == 64 and not got[i]["kept"] for i in range(12))
    assert got[50]["text"] == f"menu 1\n{words} x" and got[50]["kept"] and got[51]["text"] is None


# Language model


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seq = [1, 4, 2, 0]
    want = 0.0
    for path in np.ndindex(3, 3, 3, 3):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for t in range(1, 4):
            p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
        want += p
    other = np.array([3, 0], np.int32)
    for ids, alive, order in hmm.blocks(iter([other, np.array(seq, np.int32)])):
        logs = hmm.forward(m, ids, alive)[0]
        assert np.isclose(logs[order.index(1)], np.log(want))


def test_baum_welch_never_falls():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 6, rng.integers(1, 30)).astype(np.int32) for _ in range(40)]
    prior = np.full(6, 1 / 6)
    m = hmm.re_estimated(rng.uniform(1, 2, (6, 3)) * 1e6, rng.uniform(1, 2, (3, 3)) * 1e6, np.ones(3) * 1e6, prior)
    last = -np.inf
    for _ in range(6):
        emit, move, start = np.zeros((6, 3)), np.zeros((3, 3)), np.zeros(3)
        total = sum(hmm.expected_counts(m, ids, alive, emit, move, start) for ids, alive, _ in hmm.blocks(iter(seqs)))
        assert total >= last - 1e-6 and np.isclose(emit.sum(), sum(map(len, seqs))) and np.isclose(start.sum(), len(seqs))
        last = total
        m = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def test_scores(docs, texts):
    got = {r["doc_id"]: r for r in rows(hmm.score_texts(docs, fold(F.col("doc_id"), 7) != 2, head=500, states=3, rounds=2))}
    tok = {i: [*hmm.tokens(t.encode()), b" "] for i, t in texts.items()}
    counts = Counter(w for i, ws in tok.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tok.items():
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert got[i]["n_tokens"] == len(ws) and got[i]["n_known"] == sum(w in counts for w in ws) and got[i]["train_tokens"] == n
        assert np.isclose(got[i]["base_score"], base, rtol=1e-9)
    held = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_words_outside_the_head_have_emissions(docs):
    """The head is what is broadcast, not what is learnt: scores are those of a model that holds all words at once."""
    few, all_ = ({r["doc_id"]: r["score"] for r in rows(hmm.score_texts(docs, fold(F.col("doc_id"), 7) != 2, head=n, states=3, rounds=2))} for n in (40, 1_000_000))
    assert few.keys() == all_.keys() and all(np.isclose(few[i], all_[i], rtol=1e-4) for i in few)


# Toxicity


def test_gradients():
    net = toxicity.fresh({b"ab": 1}, 3)
    words = [b"ab", b"cde", b"x"]
    x, _ = net.inputs(words)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = x.astype(np.float64)
    ids, lengths = np.array([[0, 1], [1, 2], [2, 0], [0, 0]]), np.array([4, 2])

    def total():
        return float(net.run(net.gates(x), ids, lengths)[0] @ np.array([1.0, -0.5]))

    logit, kept = net.run(net.gates(x), ids, lengths, keep=True)
    g, d_x = net.gradients(x, ids, lengths, kept, np.array([1.0, -0.5]))
    for k in ("in_f", "in_b", "back_f", "back_b", "bias_f", "attend", "ask", "out", "bias"):
        flat = net.p[k].reshape(-1)
        for at in (0, len(flat) // 2, len(flat) - 1):
            keep, e = flat[at], 1e-3
            flat[at] = keep + e
            up = total()
            flat[at] = keep - e
            down = total()
            flat[at] = keep
            assert abs((up - down) / (2 * e) - np.asarray(g[k]).reshape(-1)[at]) < 2e-3, k
    keep = x[1, 0]
    x[1, 0] = keep + 1e-3
    up = total()
    x[1, 0] = keep - 1e-3
    down = total()
    assert abs((up - down) / 2e-3 - d_x[1, 0]) < 2e-3


def test_windows_cover_texts():
    for n in (0, 1, 47, 48, 49, 72, 73, 500):
        starts = toxicity.window_starts(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WIDTH))} == set(range(n))
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_held_out_accuracy():
    rng = np.random.default_rng(8)
    plain, bad = [f"word{i}" for i in range(300)], ["vexgo", "vexan", "vexul", "grumpt"]

    def text(y):
        ws = list(rng.choice(plain, rng.integers(5, 300)))
        for _ in range(max(1, len(ws) // 40) if y else 0):
            ws[rng.integers(len(ws))] = str(rng.choice(bad)) + str(rng.choice(["", "s", "ing"]))
        return " ".join(ws).encode(), y

    data = [text(i % 3 == 0) for i in range(900)]
    net = toxicity.train(data[:700])
    p = toxicity.Scorer(net).scores([word_list(t) for t, _ in data[700:]])
    assert np.mean((p >= 0.5) == np.array([y for _, y in data[700:]])) > 0.95


def test_scores_are_those_of_a_plain_pass():
    """Words, grams, gates, attention, windows and the highest window, one by one."""
    rng = np.random.default_rng(12)
    net = toxicity.fresh({b"ab": 1, b"cd": 2}, 5)
    net.slope, net.shift = 1.5, -0.25
    p = {k: v.astype(float) for k, v in net.p.items()}
    s = lambda x: 1 / (1 + np.exp(-x))

    def vector(w):
        m, grams = b"\x02" + w + b"\x03", []
        for k in (3, 4):
            for i in range(len(m) - k + 1):
                h = m[i]
                for c in m[i + 1 : i + k]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                grams.append((((h ^ k) * 0x9E3779B1) & 0xFFFFFFFF) >> 19)
        return p["word"][net.vocabulary.get(w, 0)] + p["gram"][grams].sum(0) / max(1, len(grams))

    def logit(words):
        states = []
        for d, seq in (("f", words), ("b", words[::-1])):
            h, out, n = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
            for w in seq:
                gx, gh = vector(w) @ p[f"in_{d}"] + p[f"bias_{d}"], h @ p[f"back_{d}"]
                z, r = s(gx[:n] + gh[:n]), s(gx[n : 2 * n] + gh[n : 2 * n])
                new = np.tanh(gx[2 * n :] + r * gh[2 * n :])
                h = (1 - z) * new + z * h
                out.append(h)
            states.append(out if d == "f" else out[::-1])
        both = np.concatenate([np.array(x) for x in states], 1)
        a = np.exp(np.tanh(both @ p["attend"]) @ p["ask"])
        return (a / a.sum()) @ both @ p["out"] + p["bias"][0]

    texts_ = [[b"w%d" % i for i in rng.integers(0, 40, n)] + [b"ab"] * (n % 2) for n in (1, 3, 47, 49, 130)] + [[]]
    want = []
    for words in texts_:
        tops = [logit(words[i : i + toxicity.WIDTH]) for i in toxicity.window_starts(len(words))]
        want.append(s(net.slope * max(tops, default=p["bias"][0]) + net.shift))
    assert np.allclose(toxicity.Scorer(net).scores(texts_), want, atol=1e-4)


def test_accuracy_on_held_out_labels(spark):
    """Labelled documents of the fold that is never learnt from; most are of label 0, so both kinds of error are bounded."""
    at = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.score_toxicity(docs, labels, fold(F.col("doc_id"), 5) != 0).where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").select("score", "toxic").collect()
    said_, true = np.array([r.score >= 0.5 for r in got]), np.array([r.toxic == 1 for r in got])
    assert len(got) > 500 and true.sum() > 20
    assert np.mean(said_ == true) > 0.93 and said_[true].mean() > 0.7 and said_[~true].mean() < 0.05


def test_long_texts_do_not_use_up_the_sample(spark):
    docs = spark.createDataFrame([(i, "w " * (9000 if i % 4 else 5)) for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    got = toxicity.labelled_sample(docs, labels.withColumn("toxic", F.lit(0)), F.lit(True), (10, 10), 8000)
    assert len(got) == 10 and all(len(t) == 10 for t, _ in got)


# WARC


def test_archive_round_trip(spark):
    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(1, "http://a/", big), (2, "http://b/", big), (3, None, "tiny"), (4, "http://c/", "tiny"), (5, "http://d/", None), (6, "http://é/", "é" * 60), (6, "http://e/", "é" * 60), (None, "http://f/", big)], "page_id long, url string, html string")
    path = shared_path(spark, "warc")
    warc.write_archive(pages, path)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == stored.select("digest").distinct().count() == 4
    read = warc.read_archive(spark, path)
    got = {(r["page_id"], r["url"]): r for r in rows(read)}
    assert len(got) == 8
    for r in pages.collect():
        g, payload = got[r.page_id, r.url], (r.html or "").encode()
        assert bytes(g["payload"]) == payload and g["payload_bytes"] == len(payload) and g["payload_digest"] == hashlib.sha256(payload).hexdigest()
    kinds = {k: (r["record_type"], r["refers_to"]) for k, r in got.items()}
    assert kinds[2, "http://b/"] == ("revisit", 1) and kinds[None, "http://f/"] == ("revisit", 1) and kinds[4, "http://c/"] == ("response", None)
    for r in rows(warc.record_bytes(read)):
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"\r\nWARC-Date: " in head and (b"WARC-Profile" in head) == (b"WARC-Type: revisit" in head) and len(block) == int(re.search(rb"Content-Length: (\d+)", head)[1]) + 4


def test_archive_refuses_a_changed_payload(spark):
    path = shared_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([(1, "http://a/", "abc")], "page_id long, url string, html string"), path)
    spark.createDataFrame([("0" * 64, b"abc")], "digest string, payload binary").write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match its address"):
        warc.payloads(spark, path).collect()


def test_archive_says_what_the_header_bytes_say(spark):
    path = shared_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([(1, "http://a/\r\nWARC-Type: revisit", "abc")], "page_id long, url string, html string"), path)
    header = spark.read.parquet(f"{path}/headers").first().headers
    assert spark.read.parquet(f"{path}/headers").columns == ["headers"] and rows(warc.read_archive(spark, path))[0]["url"] == "http://a/%0D%0AWARC-Type: revisit"
    more = bytes(header).replace(b"page:1>", b"page:-7>").replace(b"http://a/", b"http://b/")
    spark.createDataFrame([(more,)], "headers binary").write.mode("append").parquet(f"{path}/headers")
    assert {r["page_id"] for r in rows(warc.read_archive(spark, path))} == {1, -7}
    for bad, message in ((bytes(header).replace(b"sha256:", b"sha256:" + b"0" * 8), "not the headers"), (re.sub(b"sha256:.{8}", b"sha256:00000000", bytes(header)), "missing payload"), (bytes(header).replace(b"Length: 3", b"Length: 4"), "wrong length"), (b"x", "not the headers")):
        other = shared_path(spark, "warc")
        spark.read.parquet(f"{path}/payloads").write.parquet(f"{other}/payloads")
        spark.createDataFrame([(bad,)], "headers binary").write.parquet(f"{other}/headers")
        with pytest.raises(Exception, match=message):
            warc.read_archive(spark, other).select("page_id", "record_type", "payload_bytes", "payload_digest").collect()


def test_archive_of_odd_pages(spark):
    data = [(1, None, None, "x"), (1, None, None, "x"), (2, "", "", "y"), (None, "http://a/", "z" * 300_000, "y"), (None, None, "z" * 300_000, "y"), (3, "http://b/", "z" * 300_000, None)]
    odd = spark.createDataFrame(data, "page_id long, url string, html string, digest string").withColumns({"payload": F.lit(1), "own_id": F.lit(2), "ties": F.lit(3), "first_id": F.lit(4), "headers": F.lit(5)})
    path, empty = shared_path(spark, "warc"), shared_path(spark, "warc")
    warc.write_archive(odd, path)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows(warc.read_archive(spark, path)))
    assert got == {(1, "response", None, 0): 2, (2, "response", None, 0): 1, (None, "revisit", 3, 300_000): 2, (3, "response", None, 300_000): 1}
    warc.write_archive(odd.where("false"), empty)
    assert rows(warc.read_archive(spark, empty)) == []


# Chat


def said(spark, *messages):
    return spark.createDataFrame([(*m, "own", "own") for m in messages], "conv_id long, turn long, role string, text string, j string, target string")


def calling(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


SCHEMAS = """SELECT 'add' AS name, array('a', 'b') AS required, map('a', 'integer', 'b', 'string') AS types UNION ALL SELECT 'say', array(), map('t', 'string')
  UNION ALL SELECT 'any', array(), map('n', 'number', 'i', 'integer', 'b', 'boolean', 'o', 'object', 'l', 'array', 's', 'string')"""


def test_tool_calls(spark):
    df = said(
        spark,
        (1, 0, "user", "plain"),
        (1, 1, "assistant", calling(("x", "add", {"b": "2", "a": 1}), ("y", "add", {"a": "$x", "b": "z"}))),
        (1, 2, "tool", json.dumps({"tool_call_id": "x", "content": 'say "3"\n'})),
        (1, 3, "tool", json.dumps({"tool_call_id": "x", "content": "again"})),
        (1, 4, "assistant", calling(("p", "say", {"t": "$q"}), ("q", "say", {"t": "$p"}), ("r", "say", {"t": "$y"}), ("x", "add", {}))),
        (2, 0, "assistant", calling(("x", "none", {}), ("n", "add", {"a": None, "b": "1"}), ("e", "add", {"a": 1, "b": "1", "c": "1"}))),
        (3, 0, "assistant", None),
        (3, 1, "assistant", "{not json"),
    )
    schemas = spark.sql(SCHEMAS)
    got = {(r["conv_id"], r["call_id"]): r for r in rows(chat.link_tool_calls(*chat.parse(df), schemas))}
    brief = {k: (r["level"], r["n_results"], r["problem"]) for k, r in got.items()}
    assert brief == {
        (1, "x"): (0, 2, None), (1, "y"): (1, 0, "wrong type"), (1, "p"): (None, 0, None), (1, "q"): (None, 0, None), (1, "r"): (2, 0, None),
        (2, "x"): (0, 0, "unknown tool"), (2, "n"): (0, 0, "missing argument"), (2, "e"): (0, 0, "unexpected argument"),
    }
    assert got[1, "x"]["json"] == '{"arguments":{"a":1,"b":"2"},"id":"x","name":"add","result":"say \\"3\\"\\n"}'
    assert json.loads(got[1, "x"]["json"])["result"] == 'say "3"\n'
    empty = df.where("false")
    assert chat.link_tool_calls(*chat.parse(empty), schemas).count() == 0


def test_arguments_keep_their_types(spark):
    """A value's JSON type decides, keys are in order at every depth, repeated keys are refused, and text of an object is read."""
    values = {"n": [1, 2.5, 1e300, -3], "i": [0, 7, 10**25, 2.0], "b": [True, False], "o": [{}, {"z": [1, {"b": 1, "a": None}], "a": "é"}], "l": [[], [1, "x"]], "s": ["", "7", "true", "{}"]}
    kind = {"n": (int, float), "i": (int,), "b": (bool,), "o": (dict,), "l": (list,), "s": (str,)}
    calls = [(f"{k}-{other}-{i}", k, v) for k in values for other, vs in values.items() for i, v in enumerate(vs)]

    def good(k, v):
        return (isinstance(v, bool) == (k == "b")) and (isinstance(v, kind[k]) or k == "i" and isinstance(v, float) and v == int(v) and v < 1e300)

    def plain(v):
        return int(v) if isinstance(v, float) and v == int(v) and v < 1e300 else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v

    raw = '{"tool_calls":[{"id":"twice","name":"any","arguments":{"n":1,"n":2}},{"id":"deep","name":"any","arguments":{"o":{"k":1,"k":1}}},{"id":"text","name":"any","arguments":"{\\"s\\": \\"$n-n-0\\"}"},{"id":"list","name":"any","arguments":[1]},{"id":"bad","name":"any","arguments":"{"},{"id":"none","name":"any"},{"id":"own","function":{"name":"any","arguments":"{\\"l\\":[{\\"x\\":\\"$text\\"}]}"}}]}'
    df = said(spark, (1, 0, "assistant", calling(*((i, "any", {k: v}) for i, k, v in calls))), (1, 1, "assistant", raw))
    got = {r["call_id"]: r for r in rows(chat.link_tool_calls(*chat.parse(df), spark.sql(SCHEMAS)))}
    for i, k, v in calls:
        assert got[i]["problem"] == (None if good(k, v) else "wrong type"), i
        shown = json.loads(got[i]["json"])["arguments"]
        assert shown == {k: v}
        if v != 1e300:
            assert got[i]["json"].startswith('{"arguments":' + json.dumps({k: plain(v)}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + ",")
    assert [got[i]["problem"] for i in ("twice", "deep", "list", "bad")] == ["arguments are no object"] * 4
    assert [(got[i]["problem"], got[i]["level"]) for i in ("text", "none", "own")] == [(None, 1), (None, 0), (None, 2)]
    assert json.loads(got["twice"]["json"])["arguments"] == '{"n":1,"n":2}'


def plain_levels(needs):
    """call -> level, None in or above a circle, by peeling."""
    level, left = {}, {c: {x for x in n if x in needs} for c, n in needs.items()}
    while True:
        new = {c: max((level[x] + 1 for x in n), default=0) for c, n in left.items() if c not in level and all(x in level for x in n)}
        if not new:
            return {c: level.get(c) for c in needs}
        level |= new


def test_levels(spark):
    """A chain of 1,000 that ends in a circle's reach or not, ladders of calls with two needs, circles, and random needs."""
    rng = np.random.default_rng(4)
    graphs = {
        1: {f"c{i}": [f"c{i - 1}"] if i else ["gone"] for i in range(1000)},
        2: {"a": ["b"], "b": ["c"], "c": ["a"], "d": ["c"], "e": ["d", "z"], "z": [], "y": ["z", "z"], "s": ["s"]},
        3: {f"l{i}": [f"l{i - 1}", f"l{max(0, i - 2)}"] if i else [] for i in range(6)} | {f"m{i}": [f"m{i - 1}"] if i else ["l5"] for i in range(9)} | {"top": ["m8", "l2"]},
        4: {f"r{i}": [f"r{j}" for j in rng.integers(0, max(1, i), rng.integers(0, 3)) if j < i] for i in range(40)},
    }
    messages = [(g, 0, "assistant", calling(*((c, "any", {"l": [f"${x}" for x in n]}) for c, n in needs.items()))) for g, needs in graphs.items()]
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in rows(chat.link_tool_calls(*chat.parse(said(spark, *messages)), spark.sql(SCHEMAS)))}
    assert got == {(g, c): v for g, needs in graphs.items() for c, v in plain_levels(needs).items()}


def test_calls_of_odd_tables(spark):
    calls = [(1, "a", 0, 0, "say", None), (1, "a", 0, 0, "say", None), (None, "a", 0, 0, "say", "{}"), (1, None, None, None, None, ""), (2, "", 0, 0, "", '{"t":"' + "x" * 300_000 + '"}'), (2, "a", 1, 0, "say", "{}"), (2, "a", 0, 1, "say", '{"t":"z"}')]
    results = [(1, "a", 3, None), (1, "a", 3, None), (None, "a", 1, "x"), (1, None, 1, "x"), (2, "", 1, "")]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, idx int, name string, arguments string").withColumns({"canonical": F.lit(1), "level": F.lit(2), "found": F.lit(3)})
    answers = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string").withColumn("r", F.lit(1))
    got = Counter((r["conv_id"], r["call_id"], r["turn"], r["n_results"], r["problem"]) for r in rows(chat.link_tool_calls(df, answers, spark.sql(SCHEMAS))))
    assert got == {(1, "a", 0, 2, None): 1, (None, "a", 0, 0, None): 1, (1, None, None, 0, "unknown tool"): 1, (2, "", 0, 1, "unknown tool"): 1, (2, "a", 0, 0, None): 1}


# Long words


def test_all_of_a_long_word_is_read(spark):
    run = "".join(chr(0x4E00 + i) for i in range(500))
    pieces = toxicity.spoken(f"ab {run} cd".encode())
    whole = run.encode()
    grams = {p[i : i + 4] for p in pieces for i in range(len(p) - 3)}
    assert pieces[0] == b"ab" and pieces[-1] == b"cd" and all(whole[i : i + 4] in grams for i in range(len(whole) - 3))
    assert max(map(len, pieces)) <= 64 and [len(toxicity.spoken(b"x" * n)) for n in (1, 4, 64, 65)] == [1, 1, 1, 2]
    net = toxicity.fresh({}, 3)
    changed = run[:300] + "\u9fa5" * 20 + run[320:]
    a, b = (toxicity.Scorer(net).scores([toxicity.spoken(t.encode())])[0] for t in (run, changed))
    assert a != b


# Odd tables


OPERATORS = {
    "quality": quality.apply_rules,
    "hmm": lambda d: hmm.score_texts(d, fold(F.col("doc_id"), 7) != 2, head=20, states=2, rounds=1),
    "packing": lambda d: packing.pack(d, queries.vocabulary_path("byte_bpe_50k.json")),
    "token_counts": lambda d: token_counts.count_tokens(d, {"▁a": -1.0}),
    "secrets": secrets.scan_secrets,
    "simhash": simhash.near_duplicates,
    "toxicity": lambda d: toxicity.score_toxicity(d, d.sparkSession.sql("SELECT 5L AS doc_id, 1 AS toxic"), F.lit(True)),
    "decontamination": lambda d: decontaminate.find_contamination(d, d.sparkSession.sql("SELECT 1L AS item_id, 'a b c' AS text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    got = rows(OPERATORS[name](odd))
    count = Counter(r["doc_id"] for r in got)
    if name == "packing":
        assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 6, None} and sum(r["length"] for r in got if r["doc_id"] in (1, 2)) == 2
    else:
        assert count == {1: 1, 2: 1, 3: 1, 4: 1, 5: 3, 6: 1, None: 2}
    if name == "simhash":
        parts = {(r["doc_id"], r["component_id"]) for r in got}
        assert {(1, 1), (2, 1), (3, 1), (None, 5), (None, 1)} <= parts
    if name == "decontamination":
        assert sum(r["contaminated"] for r in got) == 3
    if name == "hmm":
        assert all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in got)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, name):
    assert rows(OPERATORS[name](none)) == []


def test_bytes_that_are_not_utf8(spark):
    """They count as U+FFFD where characters count, stop no operator or stage, and stay in texts that nothing is done to."""
    raw = spark.sql("SELECT 1L AS doc_id, cast(X'61FF20ED A080' AS string) AS text, 's' AS source, 3L AS n_chars UNION ALL SELECT 2L, cast(concat(X'FFC3', binary(' password=b7db7aa4a5fcc78305 ')) AS string), 's', 0L".replace("ED A0", "EDA0"))
    for name, run in OPERATORS.items():
        assert {r["doc_id"] for r in rows(run(raw))} == {1, 2}, name
    got = {r["doc_id"]: r["word_chars"] for r in rows(quality.apply_rules(raw))}
    assert got[1] == len(bytes.fromhex("61FFEDA080").decode("utf-8", "replace"))
    for name, (stage, _) in STAGES.items():
        kept = {r.doc_id: bytes(r.b) for r in stage(raw).select("doc_id", F.col("text").cast("binary").alias("b")).collect()}
        assert kept[1] == bytes.fromhex("61FF20EDA080") if 1 in kept else name in ("toxicity", "decontamination"), name
    assert kept[2] == "\ufffd\ufffd [SECRET] ".encode()


STAGES = {
    "toxicity": (lambda d: toxicity.drop_toxic(d, d.sparkSession.sql("SELECT 5L AS doc_id, 1 AS toxic"), F.lit(True)), 10),
    "simhash": (simhash.keep_one, 7),
    "decontamination": (lambda d: decontaminate.drop_contaminated(d, d.sparkSession.sql("SELECT 1L AS item_id, 'a b c' AS text")), 7),
    "secrets": (secrets.redact_secrets, 10),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_odd_rows(odd, none, name):
    stage, count = STAGES[name]
    got = stage(odd)
    assert got.columns == odd.columns and got.count() == count
    assert stage(none).collect() == []
