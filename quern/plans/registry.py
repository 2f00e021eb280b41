"""Where queries are registered with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, and the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as the engine's docs: doc_id, url, title (first 8 words), text, published."""
    d = table(spark, sf_dir, "documents")
    words = F.filter(F.split("text", r"\s+", 10), lambda w: w != "")  # the tenth part, after a blank and 8 words at least, is the rest
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    published = ((F.lit(18262) + F.col("doc_id") * 37 % 2000) * 86400).cast("long")
    return d.select("doc_id", url.alias("url"), F.array_join(F.slice(words, 1, 8), " ").alias("title"), "text", published.alias("published"))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def tok(x: str) -> str:
    """SQL for the tokens of a text."""
    return rf"[t for t in regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+') if t <> '']"


def words_sql(x: str) -> str:
    return rf"[w for w in regexp_split_to_array({x}, '\s+') if w <> '']"


def values(rows: list[tuple]) -> str:
    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


DOCS = f"docs AS (SELECT doc_id, concat('https://', source, '.example.com/', lang, '/', doc_id) AS url, array_to_string(({words_sql('text')})[1:8], ' ') AS title, text, ((18262 + doc_id * 37 % 2000) * 86400)::BIGINT AS published FROM documents)"
