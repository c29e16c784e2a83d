"""Sources: CSV, Parquet, text and document packs, all with explicit schemas."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK, END = "*startid", "*endid*"


def csv_quoted(spark: SparkSession, path: str, schema: str = "id string, contents string") -> DataFrame:
    """CSV with a header, quotes and quotes doubled inside them; values may span lines.

    White space and NUL stay as they are. Nothing between two commas is null, a pair of quotes an empty text: the reader
    marks nulls by a value that is new each time, as its default takes either for null.
    """
    whole = dict(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, charToEscapeQuoteEscaping='"', nullValue=f"null-{uuid.uuid4().hex}")
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=True, **whole).csv(path)


def csv_trimmed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, without the white space before values."""
    return spark.read.schema(schema).options(header=True, ignoreLeadingWhiteSpace=True).csv(path)


def edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """src, dst as strings; the path may be a pattern such as folder/*.csv."""
    return spark.read.schema("src string, dst string").option("header", True).csv(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rank_text(spark: SparkSession, path: str) -> DataFrame:
    """(node, rank) of lines `node,rank`."""
    parts = F.split("value", ",")
    return spark.read.text(path).select(parts[0].alias("node"), parts[1].try_cast("double").alias("rank"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(url): a trimmed, non-empty line each."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def packs(spark: SparkSession, path: str) -> DataFrame:
    """(pack, content): whole files of concatenated documents; a pack is at most as large as its writer makes it."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("pack"), F.col("value").alias("content"))


def unpack(packed: DataFrame, drop_last: bool = False, fuse_lines: bool = False) -> DataFrame:
    """(id, contents) of packs(pack, content): a document from each start mark to the next, without its end mark.

    Line breaks become spaces, or nothing with fuse_lines. drop_last leaves out the last document of each pack.
    """
    pieces = F.split("content", r"\*startid")
    n = F.size(pieces) - (1 if drop_last else 0)
    rows = packed.select(F.explode(F.slice(pieces, F.lit(2), F.greatest(n - 1, F.lit(0)))).alias("piece"))
    body = F.regexp_replace(F.regexp_extract("piece", r"(?s)^[^\n]*\n(.*)$", 1), r"(?s)\n?\*endid\*\n?$", "")
    return rows.select(F.regexp_extract("piece", r"^([^*]*)\*", 1).alias("id"), F.regexp_replace(body, r"\R", "" if fuse_lines else " ").alias("contents"))


def pack_slice(meta: DataFrame, packed: DataFrame) -> DataFrame:
    """(id, record) of meta(id, pack, start_idx, end_idx): the characters from start_idx up to end_idx of its pack.

    The places within a pack meet it in one row, so a pack is moved and decoded once, not once a document.
    """
    kind = meta.schema["id"].dataType
    places = meta.groupBy("pack").agg(F.collect_list(F.struct("id", F.col("start_idx").cast("long").alias("start"), F.col("end_idx").cast("long").alias("end"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, content in zip(batch.column(0), batch.column(1), strict=True):
                ids, text, rows = places.values.field("id"), content.as_py(), places.as_py()
                for at in range(0, len(rows), 1 << 10):
                    cuts = [None if r["start"] is None or r["end"] is None else text[r["start"] : r["end"]] for r in rows[at : at + (1 << 10)]]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(cuts)), pa.array(cuts, pa.string())], names=["id", "record"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("record", T.StringType())])
    return places.join(packed.where("content is not null"), "pack").select("places", "content").mapInArrow(run, schema)
