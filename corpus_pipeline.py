"""A training corpus from raw documents: each stage calls one operator of ``quern.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet in the shared
folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import catalog, decontaminate, jaccard_join, language_id, mixing, token_files
from quern.llm.common import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a recognised language go."""
    return language_id.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity, directly or through others, the first stays."""
    return jaccard_join.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of ``benchmark`` go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rare sources are repeated towards the temperature mixture; no document is left out."""
    return mixing.realise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, as read back from them: doc_id, start, n_tokens, ids_crc32."""
    return token_files.round_trip(docs, catalog.vocabulary())


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("mixing", mixed_sources),
    ("token_files", tokens),
]
ORACLE_SQL = None  # MinHash bands, back-off scores and subword ids are beyond SQL; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each on what its predecessor wrote."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
