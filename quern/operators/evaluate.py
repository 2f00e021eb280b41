"""Graded evaluation: DCG, nDCG over pooled ideals, success, first good rank, pools shared by systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def graded(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """results (query_id, rank, url, ...) with grade: the best of the patterns that fit, 0 for none.

    A pattern fits a url that contains it, or ends with it if the pattern ends with $. Judgements meet only their own query's results.
    """
    p = F.col("url_pattern")
    fits = F.when(p.endswith("$"), F.col("url").endswith(F.regexp_replace(p, r"\$$", ""))).otherwise(F.contains(F.col("url"), p))
    keys = list(results.columns)
    pairs = results.join(qrels.select("query_id", "url_pattern", "grade"), "query_id", "left").withColumn("g", F.when(fits, F.col("grade")).otherwise(0))
    return pairs.groupBy(*keys).agg(F.max(F.coalesce("g", F.lit(0))).alias("grade"))


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def dcg(graded_: DataFrame, k: int, key: list[str]) -> DataFrame:
    return graded_.where(F.col("rank") <= k).groupBy(*key).agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))


def ideal(pool: DataFrame, k: int, key: list[str]) -> DataFrame:
    """idcg of the best order of a pool (key, url, grade)."""
    w = Window.partitionBy(*key).orderBy(F.desc("grade"), "url")
    best = pool.withColumn("rank", F.row_number().over(w))
    return dcg(best, k, key).withColumnRenamed("dcg", "idcg")


def scores(graded_: DataFrame, k: int = 10, pool: DataFrame | None = None, key: list[str] = ["query_id"], pool_key: list[str] | None = None) -> DataFrame:  # noqa: B006
    """key, dcg, ndcg, success, first_good: at k; first_good is the first rank of a grade of 2 or more.

    The ideal comes from ``pool``, or from all results of the key; ndcg is 0 where the ideal is.
    """
    pool_key = pool_key or key
    best = ideal(graded_ if pool is None else pool, k, pool_key)
    rows = graded_.groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank")))), F.lit(0.0)).alias("dcg"), F.max(((F.col("rank") <= k) & (F.col("grade") >= 2)).cast("int")).alias("success"), F.min(F.when(F.col("grade") >= 2, F.col("rank"))).alias("first_good"))
    ndcg = F.when(F.coalesce("idcg", F.lit(0.0)) > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)
    return rows.join(best, pool_key, "left").select(*key, "dcg", ndcg.alias("ndcg"), "success", "first_good")


def shared_pool(graded_: DataFrame) -> DataFrame:
    """query_id, url, grade over all systems' results."""
    return graded_.groupBy("query_id", "url").agg(F.max("grade").alias("grade"))


def report(scores_: DataFrame, by: list[str]) -> DataFrame:
    """by, queries, dcg, ndcg, success: means over queries."""
    return scores_.groupBy(*by).agg(F.count("*").alias("queries"), F.avg("dcg").alias("dcg"), F.avg("ndcg").alias("ndcg"), F.avg("success").alias("success"))
