"""Link analysis: the graph between indexed pages and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import shared_dir

DAMPING, ROUNDS = 0.85, 40


def link_graph(docs: DataFrame) -> DataFrame:
    """src, dst: a row for each link of docs (doc_id, url, links) to another indexed url."""
    ids = docs.select("url", "doc_id")
    found = docs.select(F.col("doc_id").alias("src"), F.explode("links").alias("url"))
    return found.join(ids.select("url", F.col("doc_id").alias("dst")), "url").where("src <> dst").select("src", "dst")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, rank of nodes (doc_id) linked by edges (src, dst); parallel edges count each.

    A fixed number of rounds; the mass of nodes without links is spread evenly. Parallel edges are
    summed once into weights. Each round reads the last one's ranks three times, so each ends with a
    reliable checkpoint: plans stay short, and a lost executor costs one round at most.
    """
    spark = nodes.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    weighted = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("w")).checkpoint()
    n = nodes.count()
    if not n:
        return nodes.select("doc_id", F.lit(0.0).alias("rank"))
    linked = weighted.select(F.col("src").alias("doc_id")).distinct().withColumn("linked", F.lit(True))
    ranks = nodes.select("doc_id").distinct().join(linked, "doc_id", "left").select("doc_id", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(1.0 / n).alias("rank")).checkpoint()
    for _ in range(rounds):
        inflow = ranks.join(weighted, ranks.doc_id == weighted.src).groupBy(F.col("dst").alias("doc_id")).agg(F.sum(F.col("rank") * F.col("w")).alias("inflow"))
        dangling = ranks.agg(F.coalesce(F.sum(F.when(~F.col("linked"), F.col("rank"))), F.lit(0.0)).alias("dangling"))
        new = (1 - damping) / n + damping * (F.coalesce("inflow", F.lit(0.0)) + F.col("dangling") / n)
        ranks = ranks.select("doc_id", "linked").join(inflow, "doc_id", "left").crossJoin(F.broadcast(dangling)).select("doc_id", "linked", new.alias("rank")).checkpoint()  # dangling is one row
    return ranks.select("doc_id", "rank")
