"""Spelling, completion and related searches from the words of titles and urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import is_stop_word, suggest_form, tokenize

MOST_TOKENS, LEAST_BYTES, MOST_EDITS = 8, 4, 2
SUGGESTIONS, SESSION_QUERIES = 8, 512


def spell_words(docs: DataFrame) -> DataFrame:
    """term, weight: title tokens count 3, url tokens 1; three bytes or more, no stop words."""
    part = lambda c, w: docs.select(F.explode_outer(tokenize(F.col(c))).alias("term"), F.lit(w).alias("w"))
    rows = part("title", 3).unionByName(part("url", 1)).where((F.octet_length("term") >= 3) & ~is_stop_word(F.col("term")))
    return rows.groupBy("term").agg(F.sum("w").alias("weight"))


def _cuts(term: Column) -> Column:
    """The term and all forms with one or two characters left out: terms within two edits share one."""
    drop = lambda t: F.when(F.length(t) > 1, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))).otherwise(F.array().cast("array<string>"))
    one = F.array_distinct(drop(term))
    return F.array_distinct(F.concat(F.array(term), one, F.flatten(F.transform(one, drop))))


def spell_candidates(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """token, term, distance, weight: words within two edits of unknown tokens.

    Deletion neighbourhoods turn the edit-distance join into an equi-join: two strings within two
    edits share a form that leaves out at most two characters of each. Lengths differ by two bytes at most.
    """
    unknown = tokens.select("token").distinct().join(words.select(F.col("term").alias("token")), "token", "left_anti")
    left = unknown.select("token", F.explode(_cuts(F.col("token"))).alias("cut"))
    right = words.select("term", "weight", F.explode(_cuts(F.col("term"))).alias("cut"))
    pairs = left.join(right, "cut").where(F.abs(F.octet_length("token") - F.octet_length("term")) <= MOST_EDITS).select("token", "term", "weight").distinct()
    return pairs.withColumn("distance", F.levenshtein("token", "term", MOST_EDITS)).where("distance between 1 and 2").select("token", "term", "distance", "weight")


def spell_best(candidates: DataFrame) -> DataFrame:
    """token, term: nearest, then heaviest, then first."""
    best = candidates.groupBy("token").agg(F.min(F.struct("distance", (-F.col("weight")).alias("w"), "term")).alias("x"))
    return best.select("token", F.col("x.term").alias("term"))


def correct(queries: DataFrame, words: DataFrame) -> DataFrame:
    """query_id, corrected of the queries (query_id, q) that a correction changes; first 8 tokens."""
    placed = queries.select("query_id", F.posexplode(F.slice(tokenize(F.col("q")), 1, MOST_TOKENS)).alias("i", "token"))
    doubtful = placed.where((F.octet_length("token") >= LEAST_BYTES) & ~is_stop_word(F.col("token")))
    best = spell_best(spell_candidates(doubtful, words))
    fixed = placed.join(best, "token", "left")
    out = fixed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("term", "token").alias("t")))).alias("ts"), F.count("term").alias("n"))
    return out.where("n > 0").select("query_id", F.array_join(F.transform("ts", lambda x: x["t"]), " ").alias("corrected"))


def title_words(docs: DataFrame) -> DataFrame:
    """word: title tokens of two bytes or more, no stop words."""
    return docs.select(F.explode_outer(tokenize(F.col("title"))).alias("word")).where((F.octet_length("word") >= 2) & ~is_stop_word(F.col("word"))).distinct()


def title_phrases(docs: DataFrame) -> DataFrame:
    """phrase, freq: titles in suggestion form."""
    return docs.select(suggest_form(F.col("title")).alias("phrase")).where("phrase is not null").groupBy("phrase").agg(F.count("*").alias("freq"))


def session_queries(log: DataFrame, most: int = SESSION_QUERIES) -> DataFrame:
    """query, count, last_seen of a log (seq, q) without shortcuts; the ``most`` frequent, then recent."""
    rows = log.where(~F.ltrim("q").startswith("!")).select(suggest_form(F.col("q")).alias("query"), "seq").where("query is not null")
    counted = rows.groupBy("query").agg(F.count("*").alias("count"), F.max("seq").alias("last_seen"))
    return counted.orderBy(F.desc("count"), F.desc("last_seen"), "query").limit(most)


def complete(prefixes: DataFrame, words: DataFrame, phrases: DataFrame, session: DataFrame | None = None, most: int = SUGGESTIONS) -> DataFrame:
    """query_id, rank, suggestion for prefixes (query_id, q): session queries, title phrases, words.

    A prefix match is an equi-join on the first two characters and a filter, so no side is scanned
    once for each of the other's rows; a prefix of one character is matched on that.
    """
    p = prefixes.select("query_id", "q", suggest_form(F.col("q")).alias("form"))

    def by_prefix(left: DataFrame, key: Column, right: DataFrame, text: str) -> DataFrame:
        n = F.least(F.length(key), F.lit(2))
        keyed = left.withColumn("_key", key).withColumn("_k", F.concat(n.cast("string"), F.lit(":"), F.substr(key, F.lit(1), n)))
        heads = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.length(text), F.lit(2))), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substr(F.col(text), F.lit(1), i)))))
        return keyed.join(right.select("*", heads.alias("_k")), "_k").where(F.col(text).startswith(F.col("_key")) & (F.col(text) != F.col("_key"))).drop("_k", "_key")

    scored = by_prefix(p.where("form is not null"), F.col("form"), phrases, "phrase").select("query_id", F.col("phrase").alias("suggestion"), (F.lit(100_000) + F.col("freq")).alias("score"))
    last = F.regexp_extract("q", r"(?U)(\S+)$", 1)
    tails = p.where("form is not null").withColumn("tail", F.lower(last)).where("tail <> ''").withColumn("head", F.substr(F.col("q"), F.lit(1), F.length("q") - F.length(last)))
    scored = scored.unionByName(by_prefix(tails, F.col("tail"), words, "word").select("query_id", F.concat("head", "word").alias("suggestion"), F.lit(10_000).cast("long").alias("score")))
    if session is not None:
        scored = scored.unionByName(by_prefix(p.where("form is not null"), F.col("form"), session, "query").select("query_id", F.col("query").alias("suggestion"), (F.lit(1_000_000) + F.col("count") * 1000 + F.col("last_seen")).alias("score")))
    unique = scored.groupBy("query_id", "suggestion").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "suggestion")
    return unique.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "rank", "suggestion")


def related_tokens(hits: DataFrame, queries: DataFrame, top: int = 8) -> DataFrame:
    """query_id, token, n: tokens of the first hits' titles that the query lacks; three bytes or more."""
    asked = queries.select("query_id", tokenize(F.col("q")).alias("have"))
    rows = hits.where(F.col("rank") <= top).select("query_id", F.explode_outer(tokenize(F.col("title"))).alias("token")).join(asked, "query_id")
    kept = rows.where((F.octet_length("token") >= 3) & ~is_stop_word(F.col("token")) & ~F.array_contains("have", F.col("token")))
    return kept.groupBy("query_id", "token").agg(F.count("*").alias("n"))


def related_searches(tokens: DataFrame, queries: DataFrame, answered: DataFrame, most: int = 6) -> DataFrame:
    """query_id, rank, q: the query and one related token, of those that ``answered`` (query_id, token) holds."""
    ranked = tokens.join(answered.select("query_id", "token"), ["query_id", "token"], "left_semi").join(queries.select("query_id", "q"), "query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "token")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "rank", F.concat_ws(" ", "q", "token").alias("q"))
