"""Scores: fielded BM25, phrases, proximity, authority, freshness, fusion; all over (query_id, doc_id).

Queries are rows, so one job ranks a batch. Term look-ups are equi-joins that Spark broadcasts when
the query side is small; nothing here assumes that it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.index import Index, shipped

# The ranking constants.
K1, B = 1.2, 0.75
W_TITLE, W_BODY = 3.0, 1.0
PROXIMITY, AUTHORITY = 2.0, 0.5
RRF_K = 60
SEMANTIC_WEIGHT = 2.0
FRESHNESS = {"background": (0.10, 365.0), "fresh": (0.65, 90.0), "vertical": (1.50, 45.0)}
FRESH_TOKENS = "latest recent current today news changelog release releases released update updates updated version versions security cve vulnerability vulnerabilities patch patched breaking roadmap".split()


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def field_part(weight: float, tf: Column, length: Column, average: Column) -> Column:
    return F.when(tf > 0, weight * tf / (1 - B + B * length / average)).otherwise(0.0)


def bm25f(idf_: Column, tf_title: Column, tf_body: Column, len_title: Column, len_body: Column, avg_title: Column, avg_body: Column) -> Column:
    """Fields are summed before saturation."""
    w = field_part(W_TITLE, tf_title, len_title, avg_title) + field_part(W_BODY, tf_body, len_body, avg_body)
    return idf_ * (w / (K1 + w))


def matches(index: Index, query_terms: DataFrame, positions: bool = True) -> DataFrame:
    """query_id, term, doc_id, tf_title, tf_body, positions, idf of query_terms (query_id, term); lengths as in ``Index.of_terms``."""
    found, asked = index.of_terms(query_terms, positions), shipped(query_terms.select("query_id", "term").distinct())
    hit = found.join(asked, "term")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    n = index.documents.agg(F.count("*").alias("n"))
    weights = df.crossJoin(F.broadcast(n)).select("term", idf(F.col("df"), F.col("n")).alias("idf"))  # n is one row
    return hit.join(weights, "term")


def lexical(index: Index, matched: DataFrame) -> DataFrame:
    """query_id, doc_id, score."""
    rows = index.with_lengths(matched).crossJoin(F.broadcast(index.stats().select("avg_title", "avg_body")))  # one row
    score = bm25f(*(F.col(c) for c in ("idf", "tf_title", "tf_body", "len_title", "len_body", "avg_title", "avg_body")))
    return rows.groupBy("query_id", "doc_id").agg(F.sum(score).alias("score"))


def top(scores: DataFrame, k: int | str, by: list[Column] | None = None, alias: str = "rank") -> DataFrame:
    """The first ``k`` of each query by score, least doc_id on ties, with ``rank`` from 1.

    The window's limit is pushed below its exchange, so each task sends k rows a query at most.
    """
    w = Window.partitionBy("query_id").orderBy(*(by or [F.desc("score"), F.asc("doc_id")]))
    return scores.withColumn(alias, F.row_number().over(w)).where(F.col(alias) <= (F.col(k) if isinstance(k, str) else F.lit(k)))


def pruned_top(impacts: DataFrame, query_terms: DataFrame, k: int, by: list[Column] | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the ``k`` best by summed impacts, as ``top`` of all of them gives.

    A term's k-th greatest impact bounds the k-th score from below. Terms in ascending order of their
    greatest impact are idle as long as these add up to less than the bound: a document with idle
    terms alone can't be among the k best. So documents come from the other terms, and the postings of
    idle ones, the frequent words, are read for these documents only. ``impacts``: term, doc_id, impact.
    """
    hit = impacts.join(shipped(query_terms.select("query_id", "term").distinct()), "term")
    nth = hit.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "term").orderBy(F.desc("impact")))).where(F.col("n") <= k)
    terms = nth.groupBy("query_id", "term").agg(F.max("impact").alias("most"), F.min(F.when(F.col("n") == k, F.col("impact"))).alias("kth"))
    one = Window.partitionBy("query_id")
    terms = terms.withColumn("bound", F.coalesce(F.max("kth").over(one), F.lit(0.0))).withColumn("upto", F.sum("most").over(one.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)))
    busy = terms.select("query_id", "term", (F.col("upto") * (1 + 1e-9) >= F.col("bound")).alias("busy"))
    told = hit.join(busy, ["query_id", "term"])
    found = told.where("busy").select("query_id", "doc_id").distinct()
    idle = told.where("not busy").join(found, ["query_id", "doc_id"], "left_semi")
    scores = told.where("busy").unionByName(idle).groupBy("query_id", "doc_id").agg(F.sum("impact").alias("score"))
    return top(scores, k, by)


def cover_spans(positions: DataFrame) -> DataFrame:
    """query_id, doc_id, present, span from rows (query_id, doc_id, term, pos).

    span: least distance between the ends of a window that holds each present term once. A document's
    places are folded once in order; the state is the last place of each present term.
    """
    key = ["query_id", "doc_id"]
    rows = positions.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("places"), F.array_sort(F.collect_set("term")).alias("present"))
    start = F.struct(F.transform("present", lambda t: F.lit(None).cast("int")).alias("last"), F.lit(None).cast("int").alias("span"))

    def step(acc: Column, x: Column) -> Column:
        last = F.zip_with(acc["last"], "present", lambda p, t: F.when(t == x["term"], x["pos"]).otherwise(p))
        full = ~F.exists(last, lambda p: p.isNull())
        return F.struct(last.alias("last"), F.when(full, F.least(acc["span"], x["pos"] - F.array_min(last))).otherwise(acc["span"]).alias("span"))

    return rows.select(*key, "present", F.aggregate("places", start, step, lambda acc: acc["span"]).alias("span"))


def proximity(spans: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, doc_id, bonus: 2 * sum of idf / (1 + span) where two terms or more are present."""
    rows = spans.where(F.size("present") >= 2).select("query_id", "doc_id", "span", F.explode("present").alias("term"))
    return rows.join(weights.select("term", "idf").distinct(), "term").groupBy("query_id", "doc_id", "span").agg(F.sum("idf").alias("total")).select("query_id", "doc_id", (PROXIMITY * F.col("total") / (1 + F.col("span"))).alias("bonus"))


def phrase_docs(index: Index, phrases: DataFrame) -> DataFrame:
    """query_id, phrase, doc_id where all terms of phrases (query_id, phrase, term, at) stand in place."""
    need = phrases.groupBy("query_id", "phrase").agg(F.count("*").alias("need"))
    places = index.of_terms(phrases).join(shipped(phrases), "term").select("query_id", "phrase", "doc_id", "at", F.explode("positions").alias("pos"))
    whole = places.groupBy("query_id", "phrase", "doc_id", (F.col("pos") - F.col("at")).alias("base")).agg(F.count_distinct("at").alias("n"))
    return whole.join(need, ["query_id", "phrase"]).where("n = need").select("query_id", "phrase", "doc_id").distinct()


def authority(score: Column, rank: Column, most: Column) -> Column:
    return F.when(most > 0, score * (1 + AUTHORITY * rank / most)).otherwise(score)


def freshness(score: Column, published: Column, as_of: Column, kind: str | None = None, weight: Column | None = None, days: Column | None = None) -> Column:
    """Dated documents gain ``w * exp(-age / tau)``; the clock is the caller's."""
    w, tau = (weight, days) if kind is None else (F.lit(x) for x in FRESHNESS[kind])
    age = F.greatest((as_of - published) / 86400.0, F.lit(0.0))
    return F.when(published > 0, score * (1 + w * F.exp(-age / tau))).otherwise(score)


def wants_fresh(query: Column) -> Column:
    """A token of the fixed list, or a year 2020 to 2099."""
    from quern.functions.text import tokenize

    return F.exists(tokenize(query), lambda t: t.isin(FRESH_TOKENS) | t.rlike("^20[2-9][0-9]$"))


def rrf(rankings: list[tuple[DataFrame, float]], key: list[str] = ["query_id"]) -> DataFrame:  # noqa: B006
    """key, doc_id, score = sum of weight / (60 + rank) over rankings (key, doc_id, rank)."""
    rows = None
    for df, weight in rankings:
        part = df.select(*key, "doc_id", (F.lit(weight) / (RRF_K + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*key, "doc_id").agg(F.sum("part").alias("score"))
