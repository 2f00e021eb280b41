"""Shaping of ranked lists: duplicates, host variety, images, answers, rerankers, prompts."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import html, urls
from quern.functions.text import STOP_WORDS, tokenize

RERANK_POOL = 10


def dedupe(ranked: DataFrame) -> DataFrame:
    """ranked (query_id, rank, url, ...) with the best-ranked row of each canonical url."""
    w = Window.partitionBy("query_id", urls.canonical_url(F.col("url"))).orderBy("rank")
    return ranked.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def diversify(ranked: DataFrame, k: int) -> DataFrame:
    """ranked (query_id, q, rank, url, ...) cut to k, ranks from 1 without gaps.

    If one host holds more than half of the top k, and the query names neither it nor a site, hosts
    give max(k / 3, 2) results each before others; what is put off comes after. Lists no longer than k, k
    under 4 and lists of one host stay as they are.
    """
    host = urls.url_host(F.col("url"))
    q = Window.partitionBy("query_id")
    rows = ranked.withColumn("_host", host).withColumn("_at", F.row_number().over(q.orderBy("rank")))
    rows = rows.withColumn("_n", F.count("*").over(q)).withColumn("_hosts", F.size(F.collect_set("_host").over(q)))
    rows = rows.withColumn("_in_top", F.count(F.when(F.col("_at") <= k, F.col("_host"))).over(Window.partitionBy("query_id", "_host")))
    most = F.max(F.struct(F.when(F.col("_host").isNotNull(), F.col("_in_top")).otherwise(0).alias("n"), "_host")).over(q)
    named = F.contains(F.lower("q"), F.lit("site:")) | F.contains(F.lower("q"), most["_host"])
    spread = F.lit(k >= 4) & (F.col("_n") > k) & (F.col("_hosts") > 1) & (most["n"] > -(-k // 2)) & ~named
    nth = F.row_number().over(Window.partitionBy("query_id", "_host").orderBy("rank"))
    late = spread & F.col("_host").isNotNull() & (nth > max(k // 3, 2))
    rows = rows.withColumn("_late", F.coalesce(late, F.lit(False)))
    placed = rows.withColumn("_new", F.row_number().over(q.orderBy("_late", "rank"))).where(F.col("_new") <= k)
    return placed.withColumn("rank", F.col("_new")).drop("_host", "_at", "_n", "_hosts", "_in_top", "_late", "_new")


def image_terms(query: Column) -> Column:
    """The words of a query that images are held against."""
    parts = F.filter(F.transform(F.split(F.trim(query), r"(?U)\s+"), lambda p: F.regexp_replace(p, r'^"+|"+$', "")), lambda p: (F.lower(p) != "or") & ~p.startswith("-") & ~F.contains(p, F.lit(":")))
    return F.array_distinct(F.filter(F.flatten(F.transform(parts, tokenize)), lambda t: (F.octet_length(t) >= 2) & ~t.isin(STOP_WORDS)))


def ranked_images(images: Column, terms: Column, title: Column, most: int = 4) -> Column:
    """Images by how many terms their alt (8), url (5) and the title (2) hold, 1 for any alt; then in order."""

    def score(x: Column) -> Column:
        alt, url = F.lower(x["alt"]), F.lower(x["url"])
        part = lambda t: F.when((alt != "") & F.contains(alt, t), 8).otherwise(0) + F.when(F.contains(url, t), 5).otherwise(0) + F.when(F.contains(F.lower(title), t), 2).otherwise(0)
        return (alt != "").cast("int") + F.aggregate(terms, F.lit(0), lambda s, t: s + part(t))

    keyed = F.transform(images, lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"), x.alias("x")))
    return F.slice(F.transform(F.array_sort(keyed), lambda y: y["x"]), 1, most)


def answers(hits: DataFrame, pooled: DataFrame, passages: DataFrame, floor: float) -> DataFrame:
    """query_id, answer: the best passage of the top hit where its cosine reaches ``floor``."""
    best = hits.where("rank = 1").select("query_id", "doc_id").join(pooled, ["query_id", "doc_id"]).where(F.col("score") >= floor)
    return best.join(passages.select("doc_id", "passage_idx", "text"), ["doc_id", "passage_idx"]).select("query_id", html.decode_entities(F.col("text"), html.STORED_LIMIT).alias("answer"))


def answer_context(hits: DataFrame, pooled: DataFrame, passages: DataFrame, n: int = 5) -> DataFrame:
    """query_id, rank, title, url, passage of the first n hits."""
    top = hits.where(F.col("rank") <= n).join(pooled.select("query_id", "doc_id", "passage_idx"), ["query_id", "doc_id"])
    return top.join(passages.select("doc_id", "passage_idx", F.col("text").alias("passage")), ["doc_id", "passage_idx"]).select("query_id", "rank", "title", "url", "passage")


def prompts(context: DataFrame, queries: DataFrame, words: int = 180) -> DataFrame:
    """query_id, prompt: the question and its numbered passages of ``words`` words at most."""
    short = F.array_join(F.slice(F.split("passage", r"\s+"), 1, words), " ")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit(" ("), "url", F.lit(")\n"), short)
    body = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    text = F.concat(F.lit("Answer from the numbered sources and cite them.\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n"), F.lit("\n\nQuestion: "), "q", F.lit("\nAnswer:"))
    return body.join(queries, "query_id").select("query_id", text.alias("prompt"))


def generate(prompts_: DataFrame, generator: Callable[[str], str]) -> DataFrame:
    """query_id, answer by a caller's model, one call a prompt, spread over tasks."""

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return p.map(generator)

    return prompts_.select("query_id", run("prompt").alias("answer"))


def parse_order(reply: str, n: int) -> list[int] | None:
    """The order that a reply's numbers (1 to n) give, the rest after in place; null without a number in it."""
    digits = re.findall(r"\d+", reply)
    if not digits:
        return None
    named = list(dict.fromkeys(int(d) - 1 for d in digits if 1 <= int(d) <= n))
    return named + [i for i in range(n) if i not in named]


def rerank(hits: DataFrame, reranker: Callable[[str, list[tuple[str, str]]], str], pool: int = RERANK_POOL) -> DataFrame:
    """hits (query_id, q, rank, title, snippet, ...) with the first ``pool`` put in a caller's order.

    At most ``pool`` rows of a query meet in one call; a reply without numbers leaves the order.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        order = parse_order(reranker(pdf["q"].iloc[0], list(zip(pdf["title"], pdf["snippet"]))), len(pdf)) or list(range(len(pdf)))
        pdf = pdf.iloc[order].reset_index(drop=True)
        pdf["rank"] = range(1, len(pdf) + 1)
        return pdf.astype({"rank": "int32"})

    head = hits.where(F.col("rank") <= pool).withColumn("rank", F.col("rank").cast("int"))
    head = head.groupBy("query_id").applyInPandas(run, head.schema)
    return head.unionByName(hits.where(F.col("rank") > pool).withColumn("rank", F.col("rank").cast("int")))
