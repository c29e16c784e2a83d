"""Bounded-space online packing of token ids into windows of a fixed length.

Each task keeps a fixed number of windows open. A document's ids are cut into whole windows and a rest; a rest goes to
the open window where it leaves the least room; if it fits none and all are open, the fullest is emitted. The windows
left open at the end of a task are merged with those of a bounded number of other tasks, largest first.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinquery.llm.common import cut, decoded, emitted, pairs, texts

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()), ("task", pa.int64())])
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean, task long"
PER_TASK = 1 << 36  # sequence ids of a task or a group of tasks
MERGED = 1 << 62  # from here on: windows merged from several tasks
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space that the pattern would have to backtrack through.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte, as byte-level vocabularies write bytes: visible Latin-1 stays, the rest counts up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text -> uint32 ids of the byte-level BPE in a tokenizers file, as its encode(text, add_special_tokens=False) gives them.

    The strings of added tokens are matched in texts, as the library does. The merge loop is tiktoken's, which is several
    times faster; in such a file ids rise in the order of merges, so an id is its piece's rank. A run of white space is a
    piece but for its last character, which belongs to what follows; long runs are cut out by that rule, as the pattern's
    own search would need a stack of their length.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    byte, special = byte_alphabet(), {x["content"]: x["id"] for x in model["added_tokens"]}
    added = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")
    ranks = {bytes(byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
    enc = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(text: str) -> list[int]:
        ids, at = [], 0
        for m in LONG_SPACE.finditer(text):
            end = m.end() - (m.end() < len(text))
            ids += enc.encode_ordinary(text[at : m.start()])
            ids += enc._encode_single_piece(text[m.start() : end])
            at = end
        return ids + enc.encode_ordinary(text[at:])

    def encode(text: str) -> np.ndarray:
        ids, at = [], 0
        for m in added.finditer(text):
            ids += plain(text[at : m.start()])
            ids.append(special[m[0]])
            at = m.end()
        return np.array(ids + plain(text[at:]), dtype="<u4")

    return encode


class Windows:
    """A fixed number of open windows, each a list of pieces, ordered by the room left."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.made = size, most, 0
        self.open: list[tuple[int, int, list]] = []  # (room, number, items)

    def put(self, length: int, item) -> list | None:
        """Places an item best-fit; the items of the window that had to be emitted, if one had to."""
        i = bisect.bisect_left(self.open, (length, -1, []))
        out = None
        if i < len(self.open):
            room, number, items = self.open.pop(i)
        else:
            if len(self.open) >= self.most:
                out = self.open.pop(0)[2]
            room, number, items = self.size, self.made, []
            self.made += 1
        items.append(item)
        if room == length:
            return self._both(out, items)
        bisect.insort(self.open, (room - length, number, items))
        return out

    def _both(self, out: list | None, full: list) -> list:
        """A full window goes out at once; a window can't be full and displace another unless the item fills it alone."""
        return [*full] if out is None else [*out, None, *full]


def split(emitted_items: list | None) -> list[list]:
    if not emitted_items:
        return []
    if None in emitted_items:
        i = emitted_items.index(None)
        return [emitted_items[:i], emitted_items[i + 1 :]]
    return [emitted_items]


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, windows: int = 64, end_id: int = 0, merge_tasks: int = 64) -> DataFrame:
    """A row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    `ids` are the piece's token ids, little-endian and of 4 bytes each; a sequence is its pieces' ids by offset (see
    sequences). A document is its ids, then `end_id`; null and empty texts are the end id alone, and every row of docs is
    packed, repeated ones too. A window's pieces have gapless offsets from 0. Leftovers: `merge_tasks` tasks with at most
    `windows` windows each meet in a group, a bound that holds at any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        held, sequence = Windows(size, windows), task * PER_TASK

        def placed(pieces: list[tuple], open_: bool) -> Iterator[tuple]:
            nonlocal sequence
            offset = 0
            for p in pieces:
                yield *p, sequence, offset, open_, task
                offset += p[2]
            sequence += 1

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, raw in pairs(batch, "doc_id", "text"):
                    ids = np.append(encode(decoded(raw)), np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), size):
                        part = ids[at : at + size]
                        piece = (doc, at, len(part), part.tobytes(), len(ids))
                        if len(part) == size:
                            yield from placed([piece], False)
                        else:
                            for full in split(held.put(len(part), piece)):
                                yield from placed(full, False)
            for _, _, items in held.open:
                yield from placed(items, True)

        return emitted(PIECE, rows(), 1024)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        whole: dict[int, list[dict]] = {}
        for r in rows:
            whole.setdefault(r["sequence_id"], []).append(r)
        held = Windows(size, len(whole) + 1)
        done: list[list] = []
        for w in sorted(whole.values(), key=lambda w: (-sum(r["length"] for r in w), w[0]["sequence_id"])):
            done += split(held.put(sum(r["length"] for r in w), w))
        done += [items for _, _, items in held.open]
        out, sequence = [], MERGED + key[0].as_py() * PER_TASK
        for window in done:
            offset = 0
            for r in (r for w in window for r in w):
                out.append(r | {"sequence_id": sequence, "offset": offset})
                offset += r["length"]
            sequence += 1
        return pa.Table.from_pylist(out, schema=PIECE)

    pieces = cut(texts(docs).mapInArrow(run, DDL))
    closed = pieces.where("not open")
    left = pieces.where("open").groupBy((F.col("task") / merge_tasks).cast("long").alias("grp")).applyInArrow(merge, DDL)
    return closed.unionByName(left).select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (array of int) of each packed sequence of pack's pieces; one shuffle by sequence, of at most a window each."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        rows = ((i, np.frombuffer(b"".join(p["ids"] for p in ps), "<i4")) for batch in batches for i, ps in pairs(batch, "sequence_id", "pieces"))
        return emitted(schema, rows, 1024)

    own = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return own.mapInArrow(joined, "sequence_id long, ids array<int>")
