"""Streams: drop-folder ingestion into an index, session memory and telemetry over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import suggest_form
from quern.operators.index import MERGE_CEILING, MERGE_FACTOR, Index, build, merge_pick
from quern.sources.records import parse_records
from quern.sources.sinks import _files

RECORD_FILES = "value string"


def ingest_batch(spark: SparkSession, root: str, records: DataFrame, batch_id: int, stemmed: bool = False) -> dict:
    """Append the records whose url is new to the tables under ``root``; counts of received, added, skipped.

    A batch writes folders named by its id in overwrite mode, so a batch that is run again after a
    failure replaces itself: readers see it once.
    """
    records = records.persist()
    try:
        received = records.count()
        known = _table(spark, root, "documents")
        fresh = first_by_url(records)
        if known is not None:
            fresh = fresh.join(known.where(F.col("batch") != batch_id).select("url"), "url", "left_anti")
        fresh = fresh.withColumn("doc_id", F.monotonically_increasing_id() + F.lit(batch_id * (1 << 40)))
        index = build(fresh, stemmed, unique=True)
        index.documents.write.mode("overwrite").parquet(f"{root}/documents/batch={batch_id}")
        index.postings.write.mode("overwrite").parquet(f"{root}/postings/batch={batch_id}")
        added = spark.read.parquet(f"{root}/documents/batch={batch_id}").count()
        return {"received": received, "added": added, "skipped": received - added}
    finally:
        records.unpersist()


def first_by_url(records: DataFrame) -> DataFrame:
    """The first record of each url, in the order of the batch."""
    placed = records.select(F.col("url"), F.struct(*records.columns).alias("record"), F.monotonically_increasing_id().alias("seen"))
    return placed.groupBy("url").agg(F.min_by("record", "seen").alias("record")).select("record.*")


def load_ingested(spark: SparkSession, root: str, stemmed: bool = False) -> Index:
    """The index of all batches. Should two writers have added a url at once, the lower batch has it."""
    documents, postings = _table(spark, root, "documents"), _table(spark, root, "postings")
    owner = documents.groupBy("url").agg(F.min("batch").alias("batch"))
    kept = documents.join(owner, ["url", "batch"], "left_semi")
    return Index(kept.drop("batch"), postings.join(kept.select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").drop("batch"), stemmed)


def segments(spark: SparkSession, root: str) -> DataFrame:
    """segment_id (the batch), size, title_tokens, body_tokens of each batch under ``root``."""
    documents = _table(spark, root, "documents")
    totals = documents.groupBy(F.col("batch").cast("long").alias("segment_id"))
    return totals.agg(F.count("*").alias("size"), F.sum("len_title").cast("long").alias("title_tokens"), F.sum("len_body").cast("long").alias("body_tokens"))


def health(spark: SparkSession, root: str) -> dict:
    """Whether there is an index to search under ``root``, and its documents and segments."""
    if _table(spark, root, "documents") is None:
        return {"ready": False, "documents": 0, "segments": 0}
    row = segments(spark, root).agg(F.sum("size").alias("documents"), F.count("*").alias("segments")).first()
    return {"ready": bool(row["documents"]), "documents": row["documents"] or 0, "segments": row["segments"]}


def merge_due(spark: SparkSession, root: str, factor: int = MERGE_FACTOR, ceiling: int = MERGE_CEILING) -> list[int]:
    """Merge the batches that the tiered policy picks into the highest of them; their ids, none if all is balanced.

    The merged batch is written under the highest id, which every picked batch is at most, before the
    others go. Rows that are there twice meanwhile belong to the lower batch (see ``load_ingested``), and a
    merge that is cut off is done again.
    """
    picked = sorted(r["segment_id"] for r in merge_pick(segments(spark, root).select("segment_id", "size"), factor, ceiling).collect())
    if not picked:
        return []
    fs, _ = _files(spark, root)
    for name in ("documents", "postings"):
        rows = _table(spark, root, name).where(F.col("batch").isin(picked)).drop("batch")
        rows.write.mode("overwrite").parquet(f"{root}/_merge/{name}")
    for name in ("documents", "postings"):
        into = _files(spark, f"{root}/{name}/batch={picked[-1]}")[1]
        fs.delete(into, True)
        fs.rename(_files(spark, f"{root}/_merge/{name}")[1], into)
        for batch in picked[:-1]:
            fs.delete(_files(spark, f"{root}/{name}/batch={batch}")[1], True)
    return picked


def dry_run(spark: SparkSession, root: str, records: DataFrame) -> dict:
    """The counts that ``ingest_batch`` would give, without writing."""
    known = _table(spark, root, "documents")
    fresh = records.select("url").distinct()
    if known is not None:
        fresh = fresh.join(known.select("url"), "url", "left_anti")
    received, added = records.count(), fresh.count()
    return {"received": received, "added": added, "skipped": received - added}


def _table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(f"{root}/{name}")


def ingest_stream(spark: SparkSession, folder: str, root: str, checkpoint: str, stemmed: bool = False, once: bool = True, merge_factor: int | None = None):
    """Watch ``folder`` for record files and ingest them; with ``once``, what is there now, then stop.

    With ``merge_factor`` batches are merged between micro-batches, as the tiered policy says.
    """

    def each(records: DataFrame, batch_id: int) -> None:
        ingest_batch(records.sparkSession, root, records, batch_id, stemmed)
        if merge_factor:
            merge_due(records.sparkSession, root, merge_factor)

    files = spark.readStream.schema(RECORD_FILES).text(folder, wholetext=True)
    writer = parse_records(files).writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def session_memory(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """query, count, last_seen of a stream of searches (ts, q); update mode."""
    rows = log.withWatermark("ts", delay).where(~F.ltrim("q").startswith("!")).select("ts", suggest_form(F.col("q")).alias("query")).where("query is not null")
    return rows.groupBy("query").agg(F.count("*").alias("count"), F.max("ts").alias("last_seen"))


def search_totals(log: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """window, searches, zero, avg_ms of a stream of searches (ts, results, elapsed_ms)."""
    return log.withWatermark("ts", delay).groupBy(F.window("ts", window)).agg(F.count("*").alias("searches"), F.count_if(F.col("results") == 0).alias("zero"), F.avg("elapsed_ms").alias("avg_ms"))


def bursts(log: DataFrame, gap: str = "30 seconds", delay: str = "10 minutes") -> DataFrame:
    """session_window, n: bursts of ingestion that a quiet period ends; when one closes, vectors are due.

    A streaming session window needs a key beside it; all events share this one.
    """
    rows = log.withWatermark("ts", delay).withColumn("_any", F.col("ts").isNull())
    return rows.groupBy(F.session_window("ts", gap), "_any").agg(F.count("*").alias("n")).drop("_any")
