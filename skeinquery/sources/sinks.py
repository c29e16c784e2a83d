"""Sinks: Parquet, CSV, text, document packs and key-value items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: characters after which a new pack begins.
PACK_CHARS = 100_000_000


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def write_postings(postings: DataFrame, table: str, buckets: int = 64) -> None:
    """Posting chunks as a table bucketed and sorted by word: a lookup reads one bucket, a join by word needs no shuffle."""
    postings.write.mode("overwrite").bucketBy(buckets, "word").sortBy("word", "rank").saveAsTable(table)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV that readers.csv_quoted reads back unchanged; the writer's defaults would trim values."""
    whole = dict(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, charToEscapeQuoteEscaping='"')
    df.write.mode(mode).options(header=True, quote='"', escape='"', **whole).csv(path)


def write_edges(edges: DataFrame, path: str, rows_per_file: int = 1_000_000, mode: str = "append") -> None:
    """src, dst as CSV, a new file after so many rows."""
    edges.select("src", "dst").write.mode(mode).option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)


def write_rank_text(ranks: DataFrame, path: str) -> None:
    """Lines `node,rank`."""
    ranks.select(F.concat_ws(",", F.col("node"), F.col("rank").cast("string")).alias("value")).write.text(path)


def append_words(words: DataFrame, path: str) -> None:
    """Distinct words, a line each, added to what is there."""
    words.select(F.col("word").alias("value")).distinct().write.mode("append").text(path)


def pack_records(docs: DataFrame) -> DataFrame:
    """docs(id, contents) with `record`, the document between its marks."""
    return docs.withColumn("record", F.concat(F.lit("*startid"), F.col("id"), F.lit("*\n"), F.coalesce("contents", F.lit("")), F.lit("\n*endid*\n")))


def placed(docs: DataFrame, parts: int, limit: int) -> DataFrame:
    """id, record, pack, start_idx, end_idx, length of docs(id, contents).

    Documents are dealt into `parts` rows of packs by md5 of their id and follow each other by id; a row begins a new
    pack at the first document that starts at or beyond each `limit` characters. A running sum covers one row of packs,
    never all documents, so take more parts for more documents.
    """
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(parts))
    rows = pack_records(docs).select("id", "record", F.length("record").cast("long").alias("length"), bucket.alias("bucket"))
    up_to_here = lambda *keys: Window.partitionBy(*keys).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.sum("length").over(up_to_here("bucket")) - F.col("length")).withColumn("volume", F.expr(f"`at` div {int(limit)}"))
    start = F.col("at") - F.first("at").over(up_to_here("bucket", "volume"))
    rows = rows.withColumn("start_idx", start).withColumn("pack", F.col("volume") * parts + F.col("bucket"))
    return rows.select("id", "record", "pack", "start_idx", (F.col("start_idx") + F.col("length")).alias("end_idx"), "length")


def pack_offsets(docs: DataFrame, parts: int = 64, limit: int = PACK_CHARS) -> DataFrame:
    """(id, pack, start_idx, end_idx, length): where each document of docs(id, contents) lies, in characters with marks."""
    return placed(docs, parts, limit).select("id", "pack", "start_idx", "end_idx", "length")


def write_packs(docs: DataFrame, path: str, parts: int = 64, limit: int = PACK_CHARS) -> None:
    """Documents as text, a folder pack=n for each pack, in the order that pack_offsets counts.

    The writer's line end is the last character of a record. A new pack begins after `limit` characters.
    """
    rows = placed(docs, parts, limit).sortWithinPartitions("pack", "start_idx")
    rows.select("pack", F.expr("substring(record, 1, length(record) - 1)").alias("value")).write.partitionBy("pack").option("lineSep", "\n").text(path)


def put_new(new: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """The rows of new whose key the store lacks, one for each key; append them to the store."""
    return new.dropDuplicates([key]).join(store.select(key), key, "left_anti")


def kv_items(df: DataFrame) -> DataFrame:
    """(item): each row as JSON with typed attributes: S for text, N for numbers, L for lists, M for structs."""

    def typed(c, kind: str):
        if kind.startswith("array"):
            return F.struct(F.transform(c, lambda x: typed(x, kind[6:-1])).alias("L"))
        if kind.startswith("struct"):
            inner = df.sparkSession.createDataFrame([], f"x {kind}").schema["x"].dataType
            return F.struct(F.struct(*(typed(c[f.name], f.dataType.simpleString()).alias(f.name) for f in inner.fields)).alias("M"))
        return F.struct(c.cast("string").alias("S" if kind == "string" else "N"))

    return df.select(F.to_json(F.struct(*(typed(F.col(n), k).alias(n) for n, k in df.dtypes))).alias("item"))
