"""Batch jobs from the command line: python -m skeinquery.plans.jobs index|pagerank|search …"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinquery.functions import text as T
from skeinquery.operators import graph, index, search
from skeinquery.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skeinquery")
    jobs = top.add_subparsers(dest="job", required=True)
    j = jobs.add_parser("index", help="crawl CSV (id, contents) to the raw index and posting chunks")
    j.add_argument("--input_uri", required=True)
    j.add_argument("--output_path_raw", required=True)
    j.add_argument("--output_path_list", required=True)
    j.add_argument("--scope", choices=("node", "token"), default="node")
    j = jobs.add_parser("pagerank", help="edge CSV (src, dst) to lines id,rank")
    j.add_argument("--input_uri", required=True)
    j.add_argument("--output_uri", required=True)
    j.add_argument("--pr_iterations", type=int, default=20)
    j.add_argument("--alpha", type=float, default=0.85)
    j = jobs.add_parser("search", help="the best documents for a query, as JSON lines on the console")
    j.add_argument("--postings", required=True)
    j.add_argument("--ranks", required=True)
    j.add_argument("--documents", required=True)
    j.add_argument("--q", required=True)
    j.add_argument("--k", type=int, default=10)
    return top


def run_index(spark: SparkSession, args: argparse.Namespace) -> None:
    """The raw index is written first and read back for the posting chunks, so pages are parsed once."""
    pages = readers.csv_quoted(spark, args.input_uri).select(F.col("id").alias("docid"), F.col("contents").alias("html"))
    weights = index.tfidf(index.term_freq(T.clean_html(pages, scope=args.scope)))
    sinks.write_parquet(weights, args.output_path_raw)
    sinks.write_parquet(index.postings_chunked(readers.parquet(spark, args.output_path_raw)), args.output_path_list)


def run_pagerank(spark: SparkSession, args: argparse.Namespace) -> None:
    sinks.write_rank_text(graph.pagerank(readers.edges_csv(spark, args.input_uri), args.pr_iterations, args.alpha), args.output_uri)


def run_search(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    postings, ranks, documents = readers.parquet(spark, args.postings), readers.rank_text(spark, args.ranks), readers.parquet(spark, args.documents)
    return search.as_json(search.search_results(postings, ranks, documents, args.q, args.k))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"skeinquery {args.job}").getOrCreate()
    if args.job == "index":
        run_index(spark, args)
    elif args.job == "pagerank":
        run_pagerank(spark, args)
    else:
        for row in run_search(spark, args).toLocalIterator():
            print(row.answer)


if __name__ == "__main__":
    main()
