"""Conjunctive keyword search over posting chunks, ranked by term weights and page rank."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPEATS = ("reference", "linear")


def query_terms(query: str, lemma: Callable[[str], str] = lambda w: w) -> dict[str, int]:
    """Lower-case terms of a query, with how often each occurs."""
    return dict(Counter(lemma(w) for w in query.lower().split()))


def term_weight(idf: Column, times: Column, repeat_mode: str = "reference") -> Column:
    """What a posting of a term that a query has `times` times counts for: k * idf * 2^(k-1), or k * idf with "linear"."""
    if repeat_mode not in REPEATS:
        raise ValueError(repeat_mode)
    return idf * times * F.pow(F.lit(2.0), times - 1) if repeat_mode == "reference" else idf * times


def search_and(postings: DataFrame, query: str, repeat_mode: str = "reference", chunks: int | None = 1, lemma: Callable[[str], str] = lambda w: w) -> DataFrame:
    """(docid, score): documents in the first `chunks` of every term (all of them for None), with the weighted sum of their tfidf.

    postings(word, idf, rank, doc_list). Words and chunk are filters on stored columns and reach the scan; a term that
    is missing leaves no document.
    """
    terms = query_terms(query, lemma)
    if not terms:
        return postings.select(F.lit("").alias("docid"), F.lit(0.0).alias("score")).limit(0)
    times = F.create_map(*(F.lit(x) for kv in terms.items() for x in kv))
    rows = postings.where(F.col("word").isin(*terms) & (F.lit(True) if chunks is None else F.col("rank") <= chunks))
    rows = rows.select("word", term_weight(F.col("idf"), times[F.col("word")], repeat_mode).alias("weight"), F.explode("doc_list").alias("d"))
    rows = rows.groupBy("d.docid").agg(F.countDistinct("word").alias("n"), F.sum(F.col("d.tfidf") * F.col("weight")).alias("score"))
    return rows.where(F.col("n") == len(terms)).select("docid", "score")


def search_ranked(postings: DataFrame, ranks: DataFrame, query: str, k: int = 10, missing_rank: float | None = None, repeat_mode: str = "reference", places: int = 6, chunks: int | None = 1, lemma: Callable[[str], str] = lambda w: w) -> DataFrame:
    """(docid, score): the k best of search_and plus page rank(node, rank), by the rounded score, then docid.

    A document without a rank is left out, unless missing_rank gives it one.
    """
    found = search_and(postings, query, repeat_mode, chunks, lemma)
    rank = ranks.select(F.col("node").alias("docid"), "rank")
    joined = found.join(rank, "docid", "inner" if missing_rank is None else "left")
    total = F.col("score") + (F.col("rank") if missing_rank is None else F.coalesce("rank", F.lit(float(missing_rank))))
    return joined.select("docid", F.round(total, places).alias("score")).orderBy(F.desc("score"), "docid").limit(k)


def search_results(postings: DataFrame, ranks: DataFrame, documents: DataFrame, query: str, k: int = 10, missing_rank: float | None = None, repeat_mode: str = "reference", chunks: int | None = 1, lemma: Callable[[str], str] = lambda w: w) -> DataFrame:
    """The k best with the columns of documents(id, …), in order; k rows meet the documents, so these are not shuffled."""
    best = search_ranked(postings, ranks, query, k, missing_rank, repeat_mode, chunks=chunks, lemma=lemma)
    return documents.join(F.broadcast(best.withColumnRenamed("docid", "id")), "id").orderBy(F.desc("score"), "id")  # k rows


def as_json(results: DataFrame) -> DataFrame:
    """(answer): each result as a JSON object."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("answer"))


def from_json(answers: DataFrame, schema: str) -> DataFrame:
    """The columns of schema from answers(answer), as_json's inverse; nulls where an answer lacks them or is no JSON."""
    return answers.select(F.from_json("answer", schema).alias("a")).select("a.*")


def rank_of(ranks: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, rank) of ids(id): 0 for one without a rank."""
    return ids.select("id").join(ranks.select(F.col("node").alias("id"), "rank"), "id", "left").select("id", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def kv_get(table: DataFrame, **key) -> DataFrame:
    """Rows with the given key values; equality reaches the scan."""
    for name, value in key.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


def batch_get(table: DataFrame, keys: DataFrame, on: str, *columns: str) -> DataFrame:
    """The columns of the rows whose `on` is among keys(on)."""
    return table.join(keys.select(on).distinct(), on, "left_semi").select(on, *columns)
