"""Token counts by a unigram segmentation, computed over a trie of the distinct pre-tokens.

A pre-token is a word `[^\\x20\\x09-\\x0D]+` with the word mark before it. The best segmentation of a pre-token is
the one with the highest sum of piece scores (fewest pieces, where sums tie). Walking the sorted distinct pre-tokens
is a depth-first walk of their trie: the forward scores of the path to a node stay on a stack, so a prefix that many
pre-tokens share is scored once; at a node where a pre-token ends, its number of pieces is stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from skeinquery.llm.common import decoded, emitted, pairs, texts

MARK = "▁"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def piece_scores(model_path: str) -> dict[str, float]:
    """Piece -> log score, from the vocabulary of a sentencepiece file.

    The file holds ranks, no counts; a rank r gets the log of the Zipf share 1 / (r + 2). Control and byte pieces are left out.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    keep = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): -math.log(r + 2) for r, i in enumerate(keep)}


def trie_counts(words: Iterable[str], scores: dict[str, float]) -> dict[str, int]:
    """Pieces in the best segmentation of each distinct word; a character that no piece covers costs its UTF-8 bytes."""
    longest = max(map(len, scores), default=1)
    lowest = min(scores.values(), default=0.0) - 10.0
    get, out, last = scores.get, {}, ""
    best, count = [0.0], [0]
    for word in sorted(set(words)):
        shared, most = 0, min(len(last), len(word))
        while shared < most and last[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, n = best[end - 1] + lowest * size, count[end - 1] + size
            for start in range(max(0, end - longest), end):
                s = get(word[start:end])
                if s is not None:
                    v = best[start] + s
                    if v > top or v == top and count[start] + 1 < n:
                        top, n = v, count[start] + 1
            best.append(top)
            count.append(n)
        out[word] = count[len(word)]
        last = word
    return out


def count_tokens(docs: DataFrame, scores: dict[str, float], block_words: int = 150_000) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, n_bytes of each row of docs(doc_id, text); null and blank texts count 0.

    Narrow: no shuffle. `block_words` bounds the distinct words that a task holds at a time (memory, not results);
    counts of earlier words are kept until as many are held. Repeated rows and null ids keep a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        known: dict[bytes, int] = {}

        def rows() -> Iterator[tuple]:
            held: list[tuple] = []
            new: set[bytes] = set()
            for batch in batches:
                for doc, text in pairs(batch, "doc_id", "text"):
                    words = (text or b"").split()
                    held.append((doc, words, len(text or b"")))
                    new.update(words)
                    if len(new) > block_words or len(held) >= 2000:
                        yield from flush(held, new)
            yield from flush(held, new)

        def flush(held: list[tuple], new: set[bytes]) -> Iterator[tuple]:
            fresh = {w: MARK + decoded(w) for w in new if w not in known}
            if len(known) + len(fresh) > 2 * block_words:
                known.clear()
                fresh = {w: MARK + decoded(w) for w in new}
            found = trie_counts(fresh.values(), table)
            known.update((w, found[s]) for w, s in fresh.items())
            for doc, words, size in held:
                yield doc, len(words), sum(map(known.__getitem__, words)), size
            held.clear()
            new.clear()

        return emitted(SCHEMA, rows())

    return texts(docs).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, n_bytes long")
