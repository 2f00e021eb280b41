"""Command line: ``python -m quern build|update|compact|search|ingest|stats --index DIR ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _store(spark: SparkSession, folder: str):
    from quern.operators.index import with_ids
    from quern.sources import records

    return with_ids(records.read_store(spark, folder).drop("doc_id"), 0)


def build(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Index all record files of a folder."""
    from quern.operators.index import build as build_index

    build_index(_store(spark, a.store), a.stemmed).save(a.index, impacts=a.impacts)
    return {"documents": _load(spark, a).documents.count()}


def update(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Bring an index up to date with a folder: what is unchanged stays as it is."""
    from quern.operators.index import apply_update

    index = _load(spark, a)
    first = (index.documents.agg(F.max("doc_id")).first()[0] or 0) + 1
    new, status = apply_update(index, _store(spark, a.store).drop("doc_id"), first)
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    if set(counts) - {"unchanged"}:
        new.save(a.index)
    return counts


def compact(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Rewrite the current version in one piece and delete those before it."""
    from quern.sources.sinks import drop_orphans

    _load(spark, a).save(a.index)
    return {"dropped": drop_orphans(spark, a.index)}


def search(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Hits of a query as JSON."""
    from quern.plans.search import Engine, Options
    from quern.sources.sinks import json_hits

    asked = spark.createDataFrame([(0, a.query)], "query_id long, q string")
    found = json_hits(Engine(_load(spark, a)).search(asked, Options(k=a.k, vertical=a.vertical))).first()
    return {"query": a.query, "hits": json.loads(found["json"]) if found else []}


def ingest(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Add the record files that are in a drop folder now; batches are merged as the tiered policy says."""
    from quern.streaming import ingest as stream

    stream.ingest_stream(spark, a.store, a.index, a.checkpoint or f"{a.index}/_checkpoint", a.stemmed, merge_factor=a.merge_factor).awaitTermination()
    return stream.health(spark, a.index)


def stats(spark: SparkSession, a: argparse.Namespace) -> dict:
    row = _load(spark, a).stats().first()
    return {"documents": row["n"], "avg_title": row["avg_title"], "avg_body": row["avg_body"]}


def _load(spark: SparkSession, a: argparse.Namespace):
    from quern.operators.index import Index

    return Index.load(spark, a.index, a.stemmed)


COMMANDS = {f.__name__: f for f in (build, update, compact, search, ingest, stats)}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = argparse.ArgumentParser(prog="quern", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--index", required=True, help="folder of the index")
    p.add_argument("--store", help="folder of record files")
    p.add_argument("--query", default="")
    p.add_argument("--vertical", default="all")
    p.add_argument("-k", type=int, default=20)
    p.add_argument("--stemmed", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--impacts", action="store_true", help="store impacts with the index")
    p.add_argument("--checkpoint", help="folder where a stream keeps its place")
    p.add_argument("--merge-factor", type=int, default=10)
    a = p.parse_args(args)
    out = COMMANDS[a.command](spark or SparkSession.builder.getOrCreate(), a)
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
