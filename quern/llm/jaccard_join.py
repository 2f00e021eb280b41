"""N-gram Jaccard join: MinHash bands propose pairs, full n-gram sets decide them.

Documents are sets of five-word shingles (a shorter text is one shingle). Equal sets form a class,
known by a 128-bit hash of the set and numbered; all work is on classes. Bands and rows are chosen for
the target recall at the threshold. A band hash that several classes share ties each of them to the
least of them, so a bucket of any size gives one row a member; a class is put under the least of its
ties at once, and only distinct ties between different labels are left for the components.

Each component is cut by the length of its sets, as sets whose sizes differ by more than the threshold
can't be linked, and then into blocks bounded in sets and in bytes. Each pair of blocks of the same or
neighbouring lengths is a tile, in which every pair that shares a band is verified on the full sets. A
tile returns one row a class: its number of links and a spanning tie, never the pairs. A group of m
different texts of one length that are all linked takes m * m / 2 comparisons (as matrix products),
since the number of links of each is asked for; they are spread over its tiles.

Defined cases: null text and text without words link with nothing; repeated rows are copies of each
other; rows that repeat a doc_id with other text count as documents of their own; a null doc_id links
like any other and is reported as the least id; ids that aren't whole numbers are refused; an empty
table gives an empty result; further columns, whatever their names, are ignored or kept as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import NO_ID, Scratch, WordIds, components, lean, shingle_hashes, whole_ids, words_of

K = 5
THRESHOLD = 0.8
RECALL = 0.9995
MOST_HASHES = 112
TILE = 256  # classes on a side of a tile, at most about
TILE_KEY = ["root", "lo", "i", "hi", "j"]
TILE_BYTES = 12 << 20  # bytes of shingle hashes on a side of a tile, at most about; a single set may be larger


def bands_for(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands still find a pair at ``threshold`` with ``recall``."""
    best = (most, 1)
    for rows in range(1, most + 1):
        if threshold**rows < 1e-9:
            break
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def minhash_bands(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band hashes of a set as int64; each holds the band's number."""
    rng = np.random.default_rng(20240)
    n = bands * rows
    a, b = rng.integers(1, 2**32, n, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, np.uint64).astype(np.uint32)
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(n, 2**32 - 1, np.uint32)
    for k in range(0, len(x), 256):
        np.minimum(low, (x[k : k + 256, None] * a + b).min(0), out=low)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in low.reshape(bands, rows).T.astype(np.uint64):
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def set_id(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit content hash of a sorted set, as two longs."""
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signatures(docs: DataFrame, threshold: float, k: int) -> DataFrame:
    """dk, th, c1, c2 (the set's id, null where there are no shingles), bands."""
    bands, rows = bands_for(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in batches:
            keys, sigs = [], []
            for text in b.column("text"):
                s = np.unique(shingle_hashes(words_of(text.as_py()), ids, k))
                keys.append(set_id(s) if len(s) else (None, None))
                sigs.append(minhash_bands(s, bands, rows) if len(s) else [])
            yield pa.RecordBatch.from_arrays([b.column("dk"), b.column("th"), *(pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)), pa.array(sigs, pa.list_(pa.int64()))], ["dk", "th", "c1", "c2", "bands"])

    return docs.select(_dk(), _th(), "text").mapInArrow(lean(run), "dk long, th long, c1 long, c2 long, bands array<long>")


def _dk():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("dk")


def _th():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th")


def tiles(scratch: Scratch, members: DataFrame, threshold: float) -> DataFrame:
    """``members`` (root, c, n_grams, ...) once for each of their tiles: columns lo, i, hi, j, length, block.

    A tile is block i of length lo against block j of length hi (lo itself or the next one). Sets of
    sizes that ``threshold`` allows are of the same length or of neighbouring ones.
    """
    base = math.log(1 / threshold) + 1e-9 if threshold < 1 else 1.0
    placed = members.withColumn("length", F.floor(F.log("n_grams") / base).cast("int"))
    sizes = placed.groupBy("root", "length").agg(F.count("*").alias("n"), F.sum("n_grams").alias("m"))
    sizes = sizes.select("root", "length", F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("m") * 8 / TILE_BYTES)).cast("int").alias("n"))
    near = [sizes.select("root", (F.col("length") - step).alias("length"), F.col("n").alias(name)) for step, name in ((-1, "below"), (1, "above"))]
    around = sizes.join(near[0], ["root", "length"], "left").join(near[1], ["root", "length"], "left")
    around = scratch.table(around, "lengths")  # a table of its own, so that Spark can split a large component in the join
    placed = placed.join(around, ["root", "length"]).withColumn("block", F.pmod(F.xxhash64("c"), F.col("n")).cast("int"))

    def of(count, tile):
        every = F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(every, lambda x: F.struct(*(v.alias(name) for v, name in zip(tile(x), ("lo", "i", "hi", "j")))))

    at, block = F.col("length"), F.col("block")
    own = of(F.col("n"), lambda x: (at, F.least(block, x), at, F.greatest(block, x)))
    up = of(F.col("above"), lambda x: (at, block, at + 1, x))
    down = of(F.col("below"), lambda x: (at - 1, x, at, block))
    return placed.withColumn("tile", F.explode(F.concat(own, up, down))).select(*members.columns, "length", "block", "tile.*")


def linked_pairs(sets: list[np.ndarray], maybe: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index arrays of the pairs of ``maybe`` (row < column) whose sets reach ``threshold``."""
    a, b = np.nonzero(maybe)
    sizes = np.array([len(s) for s in sets])
    able = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
    a, b = a[able], b[able]
    if not len(a):
        return a, b
    if len(a) <= 2 * len(sets):
        common = np.array([len(np.intersect1d(sets[x], sets[y], True)) for x, y in zip(a, b)])
    else:
        flat = np.concatenate(sets)
        _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        row, at = row[times[at] > 1], at[times[at] > 1]
        order = np.argsort(at, kind="stable")
        row, at = row[order], np.unique(at[order], return_inverse=True)[1]
        counts = np.zeros((len(sets), len(sets)), np.float32)
        for first in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):  # a slice of the n-grams at a time
            lo, hi = np.searchsorted(at, [first, first + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[row[lo:hi], at[lo:hi] - first] = 1
            counts += part @ part.T
        common = counts[a, b].astype(np.int64)
    good = common >= threshold * (sizes[a] + sizes[b] - common) - 1e-9
    return a[good], b[good]


def verify(rows: list[dict], threshold: float) -> list[tuple[int, int, int]]:
    """(class, the least class it is tied to here, linked documents) of the classes of one tile."""
    rows = list({r["c"]: r for r in rows}.values())
    if len(rows) < 2:
        return []
    c = np.array([r["c"] for r in rows], np.int64)
    size = np.array([r["size"] for r in rows], np.int64)
    side = np.array([(r["length"], r["block"]) == (r["hi"], r["j"]) for r in rows])
    bands = np.array([r["bands"] for r in rows], np.int64)
    maybe = np.zeros((len(rows), len(rows)), bool)
    for column in bands.T:
        maybe |= column[:, None] == column[None, :]
    if (rows[0]["lo"], rows[0]["i"]) != (rows[0]["hi"], rows[0]["j"]):  # pairs inside a block belong to its own tile
        maybe &= side[:, None] != side[None, :]
    a, b = linked_pairs([np.frombuffer(r["grams"], np.uint64) for r in rows], np.triu(maybe, 1), threshold)
    links = np.bincount(a, size[b], len(rows)) + np.bincount(b, size[a], len(rows))
    root = np.arange(len(rows))
    order = np.argsort(c)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(rows))
    root = rank.copy()
    while len(a):  # smallest label over the links
        was = root.copy()
        np.minimum.at(root, a, was[b])
        np.minimum.at(root, b, was[a])
        root = np.minimum(root, root[order][root])
        if (was == root).all():
            break
    return [(int(c[x]), int(c[order[root[x]]]), int(links[x])) for x in np.nonzero(links)[0]]


def linked_rows(docs: DataFrame, threshold: float, k: int) -> DataFrame:
    """dk, th, c, first, least, n_links of each row of ``docs`` (doc_id, text).

    dk and th know a row by its doc_id and text; c is the number of its class; first and least are
    (dk, th) of the least row of its class and of its component; all null where there are no shingles.
    """
    whole_ids(docs, "doc_id")
    scratch = Scratch(docs.sparkSession, "jaccard")
    sig = scratch.table(signatures(docs, threshold, k), "signatures")
    known = sig.where("c1 is not null")
    classes = known.groupBy("c1", "c2").agg(F.min(F.struct("dk", "th")).alias("first"), F.count("*").alias("size"))
    classes = scratch.table(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    one = known.alias("k").join(classes.select("c", "c1", "c2", "first"), ["c1", "c2"]).where("k.dk = first.dk and k.th = first.th")
    bands = scratch.table(one.select("c", F.explode("bands").alias("band")), "bands")
    shared = bands.groupBy("band").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a <> z").select("band", "a")
    ties = bands.join(shared, "band").groupBy("c").agg(F.min("a").alias("l"), F.collect_set("a").alias("all"))  # as many as bands, at most
    ties = scratch.table(ties, "ties")
    scratch.drop(bands)
    apart = ties.select(F.col("l").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()
    near = ties.join(components(scratch, apart).select(F.col("v").alias("l"), "root"), "l", "left").select("c", F.coalesce("root", "l").alias("root"))
    todo = near.join(classes, "c").select("root", "c", "c1", "c2", "size", "first.dk", "first.th")
    members = docs.select(_dk(), _th(), "text").join(todo, ["dk", "th"])
    count, rows = bands_for(threshold)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, done = WordIds(), set()
        schema = pa.schema([("root", pa.int64()), ("c", pa.int64()), ("size", pa.int64()), ("n_grams", pa.int64()), ("grams", pa.binary()), ("bands", pa.list_(pa.int64()))])
        for b in batches:
            out, held = [], 0
            for at, r in enumerate(b.select(["root", "c", "c1", "c2", "size"]).to_pylist()):
                if r["c"] in done:  # a repeated row
                    continue
                s = np.unique(shingle_hashes(words_of(b.column("text")[at].as_py()), ids, k))
                if len(s) and set_id(s) == (r["c1"], r["c2"]):
                    done.add(r["c"])
                    out.append({"root": r["root"], "c": r["c"], "size": r["size"], "n_grams": len(s), "grams": s.tobytes(), "bands": minhash_bands(s, count, rows).tolist()})
                    held += s.nbytes
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

    sets = members.mapInArrow(lean(grams), "root long, c long, size long, n_grams long, grams binary, bands array<long>")
    sets = scratch.table(sets, "sets")
    scratch.drop(ties)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple[int, int, int]] = []
        at = None
        schema = pa.schema([("c", pa.int64()), ("tie", pa.int64()), ("links", pa.int64())])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3, schema=schema)
        for b in batches:
            for r in b.to_pylist():
                if (key := tuple(r[x] for x in TILE_KEY)) != at:
                    out += verify(held, threshold)
                    held, at = [], key
                held.append(r)
            yield made(out)
            out = []
        yield made(verify(held, threshold))

    dealt = tiles(scratch, sets, threshold).repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)
    links = scratch.table(dealt.mapInArrow(lean(check), "c long, tie long, links long"), "links")
    scratch.drop(sets)
    total = links.groupBy("c").agg(F.sum("links").alias("links"))
    tied = components(scratch, links.select(F.col("c").alias("a"), F.col("tie").alias("b")))
    whole = classes.join(total, "c", "left").join(tied.select(F.col("v").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    firsts = whole.groupBy("root").agg(F.min("first").alias("least"))
    by_class = whole.join(firsts, "root").select("c1", "c2", "c", "first", "least", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return sig.select("dk", "th", "c1", "c2").join(by_class, ["c1", "c2"], "left").select("dk", "th", "c", "first", "least", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def join(docs: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """doc_id, class_id, component_id, n_links of each row of ``docs`` (doc_id, text).

    class_id: least doc_id with the same shingles; component_id: least doc_id reachable by links;
    n_links: other documents at ``threshold`` or more, copies included.
    """
    shown = lambda x: F.when(x != NO_ID, x)
    rows = linked_rows(docs, threshold, k)
    return rows.select(shown(F.col("dk")).alias("doc_id"), shown(F.coalesce("first.dk", "dk")).alias("class_id"), shown(F.coalesce("least.dk", "dk")).alias("component_id"), "n_links")


def representatives(docs: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """The rows of ``docs``, all their columns, that are the first of their component.

    One row of each component stays: least doc_id, null first, then least text hash. Rows without
    shingles are in no component and stay each by itself.
    """
    found = Scratch(docs.sparkSession, "representatives").table(linked_rows(docs, threshold, k).select("dk", "th", "c", "least"), "found")
    first = found.where("c is null or (dk = least.dk and th = least.th)").groupBy("dk", "th")
    first = first.agg(F.when(F.count("c") > 0, F.count("*")).otherwise(1).alias("n"))
    rows = docs.select(_dk(), _th(), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # no column of docs can clash
    kept = rows.join(first, ["dk", "th"])
    if first.where("n > 1").limit(1).count():
        single = kept.where("n = 1")
        kept = single.unionByName(kept.where("n > 1").dropDuplicates(["dk", "th"]))
    return kept.select("row.*")
