"""What the operators share: the shared folder (from the library), held-out folds and batches of rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinquery.sources.shared import cut, kept, shared_dir, shared_path

__all__ = ["cut", "decoded", "emitted", "fold", "free_name", "kept", "pairs", "record_batch", "shared_dir", "shared_path", "text_bytes", "texts", "word_list"]

#: Bytes for word characters: A-Z as a-z; all else that is not a-z, 0-9 or beyond ASCII as a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ROWS = 4096  # rows of a batch that goes back to Spark


def word_list(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return (text or b"").translate(WORD_BYTES).split()


def decoded(text: bytes | None) -> str:
    """A text's characters. In every operator a byte that is not UTF-8 counts as U+FFFD, and a null text is empty."""
    return (text or b"").decode("utf-8", "replace")


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column's values as they are stored, so that bytes that are not UTF-8 stop nothing."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text as UTF-8 bytes (null stays null), and other columns by name; the rest is pruned from the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def pairs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch, decoded a slice at a time, so that the Python objects of few texts live together."""
    for i in range(0, batch.num_rows, 512):
        part = batch.slice(i, 512)
        yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def record_batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols: list[Any] = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def emitted(schema: pa.Schema, rows: Iterator[tuple], size: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most `size`."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield record_batch(schema, held)
            held = []
    if held:
        yield record_batch(schema, held)
