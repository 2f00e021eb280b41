"""Runs registered queries and their SQL side by side: ``python tests/oracle.py DIR [NAME...]``."""

from __future__ import annotations

import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return int(v) if hasattr(v, "__int__") else str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, name: str, query, sql: str) -> str:
    """An empty text where both give the same rows, else what differs."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; only one has {[x for x in got if x not in set(want)][:3]} {[x for x in want if x not in set(got)][:3]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:3]}" if bad else ""


if __name__ == "__main__":
    import time

    import __spark_entry__ as entry
    from quern.session import local_session

    spark = local_session(os.environ.get("CORES", "4"), "6g", 6)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            said = compare(spark, sys.argv[1], name, queries[name], oracles[name]) if name in oracles else f"rows {queries[name](spark, sys.argv[1]).count()}"
        except Exception as e:  # noqa: BLE001  the next query shall run
            said = f"{type(e).__name__}: {str(e)[:500]}"
        print(f"{'ok  ' if not said or said.startswith('rows') else 'BAD '} {name} {time.time() - began:.1f}s {said}", flush=True)
