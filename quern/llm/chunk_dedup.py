"""Substring deduplication by content-defined chunks.

A gear hash rolls over each text's bytes (32 of them count). A chunk ends where the hash is the least
of all within REACH bytes on either side, so a boundary depends on the 2 * REACH + 32 bytes around it
alone and returns after an insertion, whatever was cut before. Chunks have REACH to MOST bytes, about
2 * REACH on average, and never end inside a character; what is left at the end of a text belongs to
its last chunk. Chunks are known by a 128-bit digest. The first occurrence of a chunk (least doc_id,
then least text hash, then the first of equal rows, then least position) stays; all others go.

Texts are chunked once; the chunks are kept in the shared folder. Digests are summed within tasks
before the exchange, and those that repeat are joined back from a table of their own, so that Spark can
split a chunk that every document carries. Asked for the texts, it stores them beside their chunks and
joins each to its removed chunks by the row's number, so that each is cut where it was chunked.

A shared passage is caught if two boundaries fall into it: with REACH 48 that takes about 130 bytes
more than the chunk between them. Shorter repeats are left, which keeps common phrases whole.

Defined cases: null text is empty and has no chunk; a null doc_id comes first, ids that aren't numbers
are ordered by a hash; rows that repeat a doc_id, with equal text or not, are documents of their own; an
empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, id_key, lean

REACH, MOST = 48, 1024
GEAR = np.random.default_rng(7919).integers(0, 2**32, 256, np.uint64).astype(np.uint32)
CHUNK = "array<struct<d1:bigint,d2:bigint,start:bigint,size:int,fresh:boolean>>"
SPAN = "array<struct<start:bigint,size:int>>"


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of GEAR[byte] << age over the last 32 bytes, by doubling."""
    h = GEAR[data]
    for w in (1, 2, 4, 8, 16):
        older = h[:-w] << np.uint32(w)
        h = h.copy()
        h[w:] += older
    return h


def least_around(h: np.ndarray, reach: int) -> np.ndarray:
    """The least value within ``reach`` of each place, by doubling."""
    edge = np.full(reach, 2**32 - 1, np.uint32)
    low, span, width = np.concatenate([edge, h, edge]), 1, 2 * reach + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of a text's bytes, in order."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if not n:
        return []
    starts = np.ones(n + 1, bool)  # where a character starts, or the text ends
    starts[:n] = (raw & 0xC0) != 0x80
    h = gear_hash(raw)
    ends = np.nonzero(h == least_around(h, REACH))[0] + 1
    cuts, last = [], 0
    for e in [*ends[starts[ends] & (ends <= n - REACH)].tolist(), n]:
        while e - last > MOST:
            last += MOST
            while not starts[last]:
                last += 1
            cuts.append(last)
        if e - last >= REACH or (e == n and e > last):
            cuts.append(e)
            last = e
    return cuts


def chunked(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """rid, doc_id, dk, th, n_bytes, chunks of each row; fresh marks a text's first chunk of a kind.

    rid numbers the rows; it holds only for this table, which is to be written before it is used twice.
    """
    struct = pa.struct([("d1", pa.int64()), ("d2", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("fresh", pa.bool_())])
    columns = ["rid", "doc_id", "dk", "th", "n_bytes", *["text"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blake = hashlib.blake2b
        for b in batches:
            digests, ends, starts, sizes, fresh = [], [0], [], [], []
            for text in b.column("text"):
                data, seen, last = text.as_py().encode(), set(), 0
                for e in boundaries(data):
                    d = blake(data[last:e], digest_size=16).digest()
                    digests.append(d)
                    fresh.append(d not in seen)
                    seen.add(d)
                    starts.append(last)
                    sizes.append(e - last)
                    last = e
                ends.append(len(digests))
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            parts = [pa.array(np.ascontiguousarray(d[:, i])) for i in (0, 1)] + [pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fresh, pa.bool_())]
            chunks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(struct)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), chunks], [*columns, "chunks"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", id_key(docs).alias("dk"), F.xxhash64(text).alias("th"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"rid long, doc_id {kind}, dk long, th long, n_bytes long, {'text string, ' * with_text}chunks {CHUNK}")


def removals(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """rid, n_dup_chunks, n_shared, n_removed and removed (array of (start, size), by start).

    n_shared counts the bytes of chunks that occur more than once, first occurrences included.
    Only rows with such a chunk are there.
    """
    pieces = rows.select("rid", "dk", "th", F.explode("chunks").alias("x")).select("rid", "dk", "th", "x.*")
    more = scratch.table(pieces.groupBy("d1", "d2").agg(F.min("dk").alias("first"), F.count("*").alias("times")).where("times > 1").select("d1", "d2", "first"), "repeated")
    dups = pieces.join(more, ["d1", "d2"]).select("rid", "th", "d1", "d2", "start", "size", (F.col("fresh") & (F.col("dk") == F.col("first"))).alias("own"))
    dups = scratch.table(dups, "dups")
    scratch.drop(more)
    # Several rows may share the least doc_id: then one of them owns the chunk.
    tied = dups.where("own").groupBy("d1", "d2").agg(F.min(F.struct("th", "rid")).alias("owner"), F.count("*").alias("n")).where("n > 1")
    tied = scratch.table(tied.select("d1", "d2", F.col("owner.rid").alias("owner")), "tied")
    if tied.limit(1).count():
        dups = dups.join(tied, ["d1", "d2"], "left").withColumn("own", F.col("own") & F.coalesce(F.col("rid") == F.col("owner"), F.lit(True)))
    out = dups.groupBy("rid").agg(F.sum("size").alias("n_shared"), F.sum(F.when(~F.col("own"), F.col("size")).otherwise(0)).alias("n_removed"), F.collect_list(F.when(~F.col("own"), F.struct("start", "size"))).alias("removed"))
    return out.select("rid", F.size("removed").cast("long").alias("n_dup_chunks"), "n_shared", "n_removed", F.array_sort("removed").alias("removed"))


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_dup_chunks, n_shared, n_removed, removed of each row of ``docs``; ``with_text`` adds kept, the text without its removed chunks."""
    scratch = Scratch(docs.sparkSession, "chunks")
    rows = scratch.table(chunked(docs, with_text), "chunks")
    zero = F.lit(0).cast("long")
    counts = (F.coalesce(c, zero).alias(c) for c in ("n_dup_chunks", "n_shared", "n_removed"))
    found = rows.drop("dk", "th", "chunks").join(removals(scratch, rows), "rid", "left")
    found = found.select("doc_id", "n_bytes", *counts, F.coalesce("removed", F.array().cast(SPAN)).alias("removed"), *["text"] * with_text)
    if not with_text:
        return found
    names = found.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for text, spans in zip(b.column("text"), b.column("removed")):
                data, parts, last = text.as_py().encode(), [], 0
                for s in spans.as_py():
                    parts.append(data[last : s["start"]])
                    last = s["start"] + s["size"]
                kept.append(b"".join([*parts, data[last:]]).decode())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(kept, pa.string())], [*names, "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_dup_chunks long, n_shared long, n_removed long, removed {SPAN}, kept string")


def kept_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text: the texts without their removed chunks."""
    return dedup(docs, with_text=True).select("doc_id", F.col("kept").alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_dup_chunks, n_shared, n_removed of ``dedup(docs, with_text=True)``, then kept_sha256 and spans (start:end of each removed chunk, in bytes)."""
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), (s["start"] + s["size"]).cast("string")))
    return found.select("doc_id", "n_bytes", "n_dup_chunks", "n_shared", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.concat_ws(",", spans).alias("spans"))
