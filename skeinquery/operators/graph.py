"""The link graph: repair, degrees, PageRank."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinquery.sources.shared import cut, kept

SPLIT = 1_000_000  # edges of a node that go together; a node with more is dealt in parts


def edges_clean(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without nulls."""
    return edges.select("src", "dst").distinct().na.drop("any")


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def sink_nodes(edges: DataFrame) -> DataFrame:
    """(node): destinations without an outgoing edge. An anti join on non-null keys, which can be shuffled at any size."""
    clean = edges_clean(edges)
    return clean.select(F.col("dst").alias("node")).distinct().join(clean.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def sink_repair(edges: DataFrame) -> DataFrame:
    """Clean edges, and for each edge into a sink its reverse; afterwards every node has an outgoing edge."""
    clean = edges_clean(edges)
    into = clean.join(sink_nodes(clean).withColumnRenamed("node", "dst"), "dst", "left_semi")
    return clean.unionByName(reverse_edges(into)).distinct()


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def out_degree(edges: DataFrame) -> DataFrame:
    """(src, degree)."""
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dsts): sorted destinations; for display, PageRank keeps edges flat."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dsts"))


def deal_edges(graph: DataFrame, split: int = SPLIT) -> tuple[DataFrame, DataFrame, str]:
    """Nodes (src, degree, parts), edges (src, part, dst) and the name of the edges' table, bucketed by src and part.

    There are as many buckets as shuffle partitions, so a join of ranks with the table moves the ranks alone. The edges
    of a node with more than `split` lie in several parts by a hash of their destination.
    """
    spark = graph.sparkSession
    graph = kept(graph, "graph")
    nodes = kept(out_degree(graph).withColumn("parts", F.ceil(F.col("degree") / split).cast("int")), "nodes")
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"edges_{uuid.uuid4().hex}"
    flat = graph.join(nodes, "src").select("src", F.pmod(F.xxhash64("dst"), "parts").cast("int").alias("part"), "dst")
    flat.repartition(n, "src", "part").write.bucketBy(n, "src", "part").saveAsTable(name)
    return nodes, spark.table(name), name


def hand_on(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, alpha: float, epsilon: float) -> DataFrame:
    """(node, rank) after a round: ranks meet their nodes, go to each part of a node's edges, and are summed by destination with partial sums."""
    given = nodes.join(ranks.withColumnRenamed("node", "src"), "src").select("src", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), (F.col("rank") / F.col("degree") + epsilon).alias("share"))
    summed = edges.join(given.hint("shuffle_hash"), ["src", "part"]).groupBy(F.col("dst").alias("node"))
    return summed.agg((F.sum("share") * alpha + (1 - alpha)).alias("rank"))


def pagerank(edges: DataFrame, iterations: int = 20, alpha: float = 0.85, epsilon: float = 1e-9, repair: bool = True, self_loops: bool = False, cut_every: int = 5) -> DataFrame:
    """(node, rank) after `iterations` rounds; not normalised, a node starts at 1.

    A round: each edge hands its source's rank over its degree, plus epsilon; a node's rank is alpha times its sum plus
    1 - alpha. Nodes without incoming edges leave after the first round and then hand on nothing; 0 rounds give each
    source 1. Edges are dealt once, into a bucketed table that is dropped at the end; rounds shuffle ranks and partial
    sums only. Lineage is cut every `cut_every` rounds, and the result is kept in the shared folder.
    """
    graph = sink_repair(edges) if repair else edges_clean(edges)
    graph = graph if self_loops else drop_self_loops(graph)
    if iterations <= 0:
        return graph.select(F.col("src").alias("node")).distinct().withColumn("rank", F.lit(1.0))
    nodes, flat, name = deal_edges(graph)
    try:
        ranks = nodes.select(F.col("src").alias("node"), F.lit(1.0).alias("rank"))
        for i in range(1, iterations + 1):
            ranks = hand_on(nodes, flat, ranks, alpha, epsilon)
            if i % cut_every == 0 and i < iterations:
                ranks = cut(ranks)
        return kept(ranks, "ranks")
    finally:
        edges.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def pagerank_basic(edges: DataFrame, iterations: int = 2) -> DataFrame:
    """Two rounds without epsilon, with self loops."""
    return pagerank(edges, iterations, 0.85, 0.0, self_loops=True)


def top_ranks(ranks: DataFrame, k: int = 5, places: int = 6) -> DataFrame:
    """The k highest ranks, rounded, ties by node."""
    return ranks.select("node", F.round("rank", places).alias("rank")).orderBy(F.desc("rank"), "node").limit(k)
