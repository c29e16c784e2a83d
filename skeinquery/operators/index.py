"""The inverted index: tokens, term statistics, TF-IDF, posting lists in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinquery.functions import text as T
from skeinquery.sources.shared import kept

CHUNK = 2500


def explode_tokens(docs: DataFrame) -> DataFrame:
    """(docid, word) of docs(docid, contents), a row per occurrence.

    Texts are dealt by docid first: they are smaller than their tokens, and counts and maxima by document then need no
    shuffle of their own.
    """
    return docs.select(F.col("docid").cast("string"), "contents").repartition("docid").select("docid", F.explode(T.tokens(F.col("contents"))).alias("word"))


def term_freq(docs: DataFrame) -> DataFrame:
    """(word, docid, tf)."""
    return explode_tokens(docs).groupBy("docid", "word").agg(F.count("*").alias("tf")).select("word", "docid", "tf")


def corpus_freq(tf: DataFrame) -> DataFrame:
    """(word, corpus_freq): occurrences over all documents."""
    return tf.groupBy("word").agg(F.sum("tf").alias("corpus_freq"))


def max_tf(tf: DataFrame) -> DataFrame:
    """(docid, max_tf)."""
    return tf.groupBy("docid").agg(F.max("tf").alias("max_tf"))


def doc_freq(tf: DataFrame) -> DataFrame:
    """(word, idf_count): documents that have the word."""
    return tf.groupBy("word").agg(F.count("*").alias("idf_count"))


def num_docs(tf: DataFrame) -> DataFrame:
    """(n): documents with a token."""
    return tf.select("docid").distinct().agg(F.count("*").alias("n"))


def term_map(tf: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(word, part, occ map<docid, tf>, corpus_freq); a word's documents are dealt by hash into maps of about `chunk`."""
    words = tf.groupBy("word").agg(F.sum("tf").alias("corpus_freq"), F.ceil(F.count("*") / chunk).alias("parts"))
    rows = tf.join(words, "word").withColumn("part", F.pmod(F.xxhash64("docid"), "parts"))
    return rows.groupBy("word", "part").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("docid", "tf")))).alias("occ"), F.max("corpus_freq").alias("corpus_freq"))


def tf_normalized(tf: DataFrame) -> DataFrame:
    """(word, docid, tf, max_tf, normalized_tf); a window by docid, which tf is already dealt by."""
    out = tf.withColumn("max_tf", F.max("tf").over(Window.partitionBy("docid")))
    return out.withColumn("normalized_tf", T.normalized_tf(F.col("tf"), F.col("max_tf")))


def tfidf(tf: DataFrame) -> DataFrame:
    """(word, docid, normalized_tf, tf, corpus_freq, idf_count, idf, tfidf).

    Counts are kept in the shared folder first, so texts are tokenised once for all that follows. Statistics of a word
    come from one grouping with partial sums and join back on the word; the join is skewed by common words only on the
    side that the engine can split.
    """
    own = kept(tf_normalized(tf), "tf")
    words = own.groupBy("word").agg(F.sum("tf").alias("corpus_freq"), F.count("*").alias("idf_count"))
    out = own.join(words, "word").withColumn("idf", T.idf(num_docs(own).scalar(), F.col("idf_count")))
    return out.withColumn("tfidf", F.col("idf") * F.col("normalized_tf")).select("word", "docid", "normalized_tf", "tf", "corpus_freq", "idf_count", "idf", "tfidf")


def top_tfidf(weights: DataFrame, k: int = 30) -> DataFrame:
    """The k highest (word, docid, tfidf), by tfidf rounded to six places, then word and docid."""
    return weights.select("word", "docid", F.round("tfidf", 6).alias("tfidf")).orderBy(F.desc("tfidf"), "word", "docid").limit(k)


def postings_ranked(weights: DataFrame, chunk: int = CHUNK, hot: int = 100_000) -> DataFrame:
    """(word, docid, tfidf, idf, place from 1, rank: the number of its chunk), highest tfidf first, ties by docid downwards.

    A word of more than `hot` documents is ranked in slices: by its tfidf, in 1024 steps and then exactly, and by the first
    two characters of the docid, an order that agrees with the final one. Counts of the slices give each its offset, over
    the steps of a word and over the slices of a step, so no task sorts all documents of a common word. Weights are kept
    in the shared folder first, as they are read twice.
    """
    weights = kept(weights.select("word", "docid", "normalized_tf", "tfidf", "idf", "idf_count"), "weights")
    step = F.when(F.col("idf") > 0, F.floor((F.col("normalized_tf") - 0.5) * 2048)).otherwise(0).cast("int")  # idf 0: all tie
    is_hot = F.col("idf_count") > hot
    key = {"step": (step, 0), "value": (F.col("tfidf"), 0.0), "head": (F.coalesce(F.substring("docid", 1, 2), F.lit("")), "")}
    sliced = weights.select("word", "docid", "tfidf", "idf", *(F.when(is_hot, c).otherwise(cold).alias(k) for k, (c, cold) in key.items()), is_hot.alias("hot"))
    slices = sliced.where("hot").groupBy("word", *key).agg(F.count("*").alias("n"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    steps = slices.groupBy("word", "step").agg(F.sum("n").alias("n")).select("word", "step", F.coalesce(F.sum("n").over(before("word").orderBy(F.desc("step"))), F.lit(0)).alias("above"))
    within = F.coalesce(F.sum("n").over(before("word", "step").orderBy(F.desc("value"), F.desc("head"))), F.lit(0))
    offsets = slices.withColumn("within", within).join(steps, ["word", "step"]).select("word", *key, (F.col("above") + F.col("within")).alias("offset"))
    own = Window.partitionBy("word", *key).orderBy(F.desc("tfidf"), F.desc("docid"))
    placed = sliced.join(offsets, ["word", *key], "left").withColumn("place", F.row_number().over(own) + F.coalesce("offset", F.lit(0)))
    return placed.select("word", "docid", "tfidf", "idf", "place", ((F.col("place") - 1) / chunk + 1).cast("long").alias("rank"))


def postings_chunked(weights: DataFrame, chunk: int = CHUNK, hot: int = 100_000) -> DataFrame:
    """(word, idf, rank, doc_list array<struct<tfidf, docid>>), `chunk` documents to a row at most."""
    entry: Column = F.collect_list(F.struct("tfidf", "docid"))
    return postings_ranked(weights, chunk, hot).groupBy("word", "rank").agg(F.max("idf").alias("idf"), F.sort_array(entry, False).alias("doc_list")).select("word", "idf", "rank", "doc_list")


def postings(weights: DataFrame) -> DataFrame:
    """(word, idf, doc_list): whole posting lists in one row a word; for small corpora and display."""
    return weights.groupBy("word").agg(F.max("idf").alias("idf"), F.sort_array(F.collect_list(F.struct("tfidf", "docid")), False).alias("doc_list"))


def build_index(docs: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The raw index and its posting chunks for docs(docid, contents); writes nothing."""
    weights = tfidf(term_freq(docs))
    return weights, postings_chunked(weights, chunk)
