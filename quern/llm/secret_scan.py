"""Secret scans by an incremental blob ledger, with DataFrame functions only.

Every version of a path is content-addressed (SHA-256 of its text). A ledger holds what each rule
version found in each blob; only (blob, rule version) pairs that it lacks are scanned, each blob
once however many paths carry it, and findings are joined back to all paths.

Base rules (fixed values) are applied leftmost and non-overlapping per kind; matches that fail their
length test are dropped and not retried. The ledger's further rules only add spans.

Defined cases: null text counts as empty and has no finding; a null doc_id is kept as it is; repeated
rows share their blob's findings; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch
from quern.llm.spans import SPAN, bare, count_of, found, joined, ordered

RULE_VERSION = 1
# Kinds in listed order, their patterns and least lengths.
KINDS = ["assign", "access", "hex"]
KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = f"({re.sub('[a-z]', lambda c: f'[{c[0].upper()}{c[0]}]', KEYWORDS)})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX = "[0-9a-f]+"
HEX_LEAST = 24
# Further rules of the ledger: key blocks and prefixed service tokens.
MORE_KINDS = ["pem", "bearer"]
PEM = "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
BEARER = "(?:ghp|gho|glpat|xoxb|xoxp|sk_live)[_-][A-Za-z0-9_-]{16,}"


def findings(text: Column) -> Column:
    """All spans of one text, by start then kind."""
    assign = F.filter(found(text, "assign", ASSIGN, text.rlike(ASSIGN), 2), lambda s: F.length(s["inner"]) >= ASSIGN_LEAST)
    access = F.filter(found(text, "access", ACCESS, F.contains(text, F.lit("AKIA"))), lambda s: s["stop"] - s["start"] >= ACCESS_LEAST)
    # A run is taken whole, so asking for the least length in the pattern drops the same matches.
    hexes = found(text, "hex", f"{HEX[:-1]}{{{HEX_LEAST},}}", text.rlike(f"{HEX[:-1]}{{{HEX_LEAST}}}"))
    pem = found(text, "pem", PEM, F.contains(text, F.lit("PRIVATE KEY-----")))
    bearer = found(text, "bearer", BEARER, text.rlike(BEARER))
    return ordered(bare(F.concat(assign, access, hexes, pem, bearer)), KINDS + MORE_KINDS, by_kind=False)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan ``versions`` (doc_id, text) against ``ledger``; returns (findings by path, the new ledger).

    ``ledger`` and the new ledger are (blob, rule_version, spans). Only the new pairs are written, as a
    table of their own in the shared folder; the new ledger reads them beside the old ones. Pass it to
    the next call.
    """
    scratch = Scratch(versions.sparkSession, "secret-ledger")
    text = F.coalesce(F.col("text"), F.lit(""))
    paths = versions.select("doc_id", F.sha2(text, 256).alias("blob"))
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    # Copies fall together within each task before any text is exchanged.
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    new = unseen.select("blob", F.lit(rule_version).alias("rule_version"), findings(F.col("text")).alias("spans"))
    new = scratch.table(new, "ledger")
    if ledger is not None:
        new = ledger.select("blob", "rule_version", "spans").unionByName(new)
    hits = new.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    out = paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    return out, new


def digest(by_path: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS))
    return by_path.select("doc_id", *(count_of(F.col("spans"), k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (
{" UNION ALL ".join(f"""  SELECT r, '{kind}' AS kind, {rank} AS rank, {least} AS least, generate_subscripts(w, 1) AS i, unnest(w) AS w, unnest(n) AS n, unnest(g) AS g FROM (
    SELECT r, regexp_extract_all(t, '{p}') AS w, regexp_extract_all(t, '{p}', {group}) AS n, regexp_split_to_array(t, '{p}')[1:len(regexp_extract_all(t, '{p}'))] AS g FROM d WHERE regexp_matches(t, '{p}'))
""" for kind, rank, p, group, least in (("assign", 1, ASSIGN.replace("'", "''"), 2, ASSIGN_LEAST), ("access", 2, ACCESS, 0, ACCESS_LEAST), ("hex", 3, HEX, 0, HEX_LEAST), ("pem", 4, PEM, 0, 0), ("bearer", 5, BEARER, 0, 0)))}),
s AS (SELECT r, kind, rank, length(n) >= least AS good, sum(length(g) + length(w)) OVER (PARTITION BY r, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop, length(w) AS len FROM m),
x AS (SELECT r, kind, rank, stop - len AS start, concat(kind, ':', stop - len, ':', stop) AS span FROM s WHERE good),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, rank) FILTER (rank <= 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM x GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""
