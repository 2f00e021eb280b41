"""Suffix-array deduplication of repeated byte strings by a common-prefix-aware distributed merge sort.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. The array is sparse:
every LENGTH-byte string has an anchor, the position in its first SPAN bytes whose 8-byte hash is
least (leftmost on ties), so equal strings have the same anchor at the same offset, and only suffixes
that begin at anchors are sorted.

1. Anchors whose next LENGTH - SPAN + 1 bytes occur once (counted by hash over all documents) can't be
   part of a repeat and are left out; so are repeats of the same suffix with the same surroundings,
   which are counted by digest and sent once.
2. Each task sorts its suffixes, cuts them by splitters sampled from all of them, and sends front-coded
   runs: the length of the prefix shared with the suffix before, then the rest.
3. Each merge task combines its runs with a loser tree that keeps, for each loser, the length of the
   prefix it shares with the winner, and compares only what lies beyond. The shared lengths of
   neighbours come out with the order.
4. Neighbours that share LENGTH - SPAN + 1 bytes are held against each other: with F bytes shared
   after the anchor and B before it, the strings that start o bytes before it repeat for
   LENGTH - F <= o <= B. A few neighbours are compared pair by pair; of more, those that share F bytes
   are runs in the order of the suffixes, and those that share B bytes runs in the order of what comes
   before, so whoever meets another in both runs repeats.

The number of merge tasks follows from the bytes that are sent. Splitters can't cut suffixes that begin
with the same LENGTH - SPAN + 1 bytes: where more than HOT different surroundings do (a licence line in
every document), an exact way of its own takes these, spread by the strings themselves: each string of
LENGTH bytes around such an anchor is counted by its digest, summed within tasks first.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; rows that repeat a doc_id,
with equal text or not, are documents of their own; a null doc_id is kept, ids of any type are; an empty
table gives an empty result; further columns, whatever their names, are ignored. Matches never cross
documents, and strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, held, id_key, lean, parts_for, stored

LENGTH, SPAN = 200, 128  # SPAN is a power of two
SHARED = LENGTH - SPAN + 1
SAMPLE = 8  # suffixes for each splitter, about
HOT = 10_000  # different surroundings of one beginning that a merge task takes
FEW = 12  # neighbours that are compared pair by pair; more go by runs


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first start, last start): each anchor and the strings' starts that it serves."""
    n = len(data) - LENGTH + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 3
    m = n + SPAN - 1
    key = np.ndarray((m,), "<u8", data, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    step = 1
    while step < SPAN:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    return at[first], first, np.concatenate([first[1:] - 1, [n - 1]])


def _keys(docs: DataFrame):
    return id_key(docs).alias("dk"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th")


def _text():
    return F.coalesce(F.col("text"), F.lit("")).alias("text")


def anchor_hashes(docs: DataFrame) -> DataFrame:
    """dk, th, at, hashes: the anchors of each text and hashes of the SHARED bytes after them."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, hashes, counts = [], [], [0]
            for text in b.column("text"):
                data = text.as_py().encode()
                at = anchors(data)[0]
                places.append(at)
                hashes += [xxhash.xxh3_64_intdigest(data[x : x + SHARED]) for x in at.tolist()]
                counts.append(len(at))
            ends = pa.array(np.cumsum(counts), pa.int32())
            at = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places) if places else [], pa.int64()).cast(pa.int32()))
            hs = pa.ListArray.from_arrays(ends, pa.array(np.array(hashes, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("dk"), b.column("th"), at, hs], ["dk", "th", "at", "hashes"])

    return docs.select(*_keys(docs), _text()).mapInArrow(lean(run), "dk long, th long, at array<int>, hashes array<long>")


def surroundings(marked: DataFrame) -> DataFrame:
    """The marked anchors (dk, th, text, at) of each text with their surroundings.

    keys: for each anchor (start, before, least, stop) as int32: the bytes from the first string's
    start to the last one's end, and the most and least bytes from a string's start to the anchor.
    text: these byte ranges, overlapping ones as one, each after its start. digests: 16 bytes an anchor,
    begins: an 8-byte hash of the SHARED bytes after it.
    """
    import xxhash

    schema = pa.schema([("dk", pa.int64()), ("th", pa.int64()), ("keys", pa.binary()), ("text", pa.list_(pa.binary())), ("digests", pa.binary()), ("begins", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for dk, th, text, marks in zip(b.column("dk"), b.column("th"), b.column("text"), b.column("at")):
                data = text.as_py().encode()
                at, first, last = anchors(data)
                pick = np.isin(at, marks.values.to_numpy())
                at, first, last = at[pick], first[pick], last[pick]
                rows = np.stack([first, at - first, at - last, last + LENGTH], 1).astype("<i4")
                digests = b"".join(hashlib.blake2b(data[s : e], digest_size=16, salt=int(a).to_bytes(8, "little") + int(z).to_bytes(8, "little")).digest() for s, a, z, e in rows.tolist())
                segments, end = [], -1
                for s, _, _, e in rows.tolist():
                    if s > end:
                        segments.append([s, e])
                    segments[-1][1] = end = max(end, e)
                out.append({"dk": dk.as_py(), "th": th.as_py(), "keys": rows.tobytes(), "text": [s.to_bytes(4, "little") + data[s:e] for s, e in segments], "digests": digests, "begins": b"".join(xxhash.xxh3_64_digest(data[x : x + SHARED]) for x in at.tolist())})
            yield pa.RecordBatch.from_pylist(out, schema)

    return marked.mapInArrow(lean(run), "dk long, th long, keys binary, text array<binary>, digests binary, begins binary")


def occurrences(segments: DataFrame) -> DataFrame:
    """dk, th, i, start, stop, d1, d2, h of each anchor of ``surroundings``."""
    names = ["dk", "th", "i", "start", "stop", "d1", "d2", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dk, th, keys, digests, begins in zip(*(b.column(c) for c in ("dk", "th", "keys", "digests", "begins"))):
                k = np.frombuffer(keys.as_py(), "<i4").reshape(-1, 4)
                d = np.frombuffer(digests.as_py(), "<i8").reshape(-1, 2)
                n = len(k)
                columns = [np.full(n, dk.as_py(), np.int64), np.full(n, th.as_py(), np.int64), np.arange(n, dtype=np.int32), k[:, 0], k[:, 3], d[:, 0], d[:, 1], np.frombuffer(begins.as_py(), "<i8")]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    return segments.mapInArrow(lean(run), "dk long, th long, i int, start int, stop int, d1 long, d2 long, h long")


def entries(row: dict, chosen: str = "pick") -> Iterator[tuple]:
    """(suffix, what comes before it, least offset, digest) of the chosen anchors of a segments row."""
    keys = np.frombuffer(row["keys"], "<i4").reshape(-1, 4).tolist()
    parts = [(int.from_bytes(t[:4], "little"), t[4:]) for t in row["text"]]
    s = 0
    for i in sorted(row[chosen]):
        start, before, least, stop = keys[i]
        while parts[s][0] + len(parts[s][1]) < stop:
            s += 1
        base, data = parts[s]
        yield data[start - base + before : stop - base], data[start - base : start - base + before], least, row["digests"][16 * i : 16 * i + 16]


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of two strings that agree up to ``at``."""
    n = min(len(a), len(b))
    while at < n:
        x, y = a[at : at + 64], b[at : at + 64]
        if x != y:
            k = min(len(x), len(y))
            d = int.from_bytes(x[:k], "big") ^ int.from_bytes(y[:k], "big")
            return at + k - (d.bit_length() + 7) // 8
        at += 64
    return n


def front_code(sorted_entries: list[tuple]) -> bytes:
    """A sorted run: for each entry the shared length, the lengths of its parts, then its parts."""
    out, last = [], b""
    for suffix, before, least, digest in sorted_entries:
        h = common(last, suffix)
        out.append(np.array([h, len(suffix) - h, len(before), least], "<u2").tobytes() + digest + suffix[h:] + before)
        last = suffix
    return b"".join(out)


def decode(run: bytes) -> Iterator[tuple[int, bytes, bytes, int, bytes]]:
    """(shared length, suffix, before, least, digest) of the entries of a front-coded run."""
    at, last = 0, b""
    while at < len(run):
        h, n, m, least = (int.from_bytes(run[at + k : at + k + 2], "little") for k in (0, 2, 4, 6))
        digest = run[at + 8 : at + 24]
        last = last[:h] + run[at + 24 : at + 24 + n]
        at += 24 + n + m
        yield h, last, run[at - m : at], least, digest


def merge(runs: list[bytes]) -> Iterator[tuple[int, tuple]]:
    """All entries of the runs in order, each with the length it shares with the one before.

    A loser tree whose nodes hold (run, length shared with the winner that beat it). Of two
    challengers, the one that shares more with the last winner is the lesser; only on a tie are bytes
    compared, and from that length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    sources = [decode(r) for r in runs] + [iter(())] * (k - len(runs))
    heads: list = [next(s, None) for s in sources]

    def play(x: tuple[int, int], y: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        (a, ha), (b, hb) = x, y
        if heads[a] is None:
            return y, x
        if heads[b] is None or ha > hb:
            return x, y
        if hb > ha:
            return y, x
        p, q = heads[a][1], heads[b][1]
        h = common(p, q, ha)
        if h == len(p) or (h < len(q) and p[h] < q[h]):
            return x, (b, h)
        return y, (a, h)

    losers: list = [(0, 0)] * k
    level = [(i, 0) for i in range(k)]
    base = k
    while len(level) > 1:
        base //= 2
        nxt = []
        for i in range(0, len(level), 2):
            win, losers[base + i // 2] = play(level[i], level[i + 1])
            nxt.append(win)
        level = nxt
    winner = level[0]
    while heads[winner[0]] is not None:
        r, h = winner
        yield h, heads[r]
        heads[r] = next(sources[r], None)
        winner = (r, heads[r][0] if heads[r] is not None else 0)
        node = (r + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeats(group: list[tuple[int, tuple]], often: set[bytes]) -> Iterator[tuple[bytes, int, int]]:
    """(digest, start, stop) within the surroundings of what repeats, for neighbours that share SHARED bytes.

    ``often``: digests of surroundings that occur more than once; these repeat whole.
    """
    one: dict[bytes, tuple] = {}
    order: list[tuple[int, tuple]] = []
    low = 1 << 30
    for h, e in group:
        low = min(low, h)
        if e[4] not in one:  # further copies of the same surroundings add nothing
            one[e[4]] = e
            order.append((low, e))
            low = 1 << 30
    n = len(order)
    found: dict[int, list[int]] = {}

    def add(i: int, a: int, b: int) -> None:
        if a <= b:
            got = found.setdefault(i, [a, b])
            got[0], got[1] = min(got[0], a), max(got[1], b)

    if n <= FEW:
        for i in range(n):
            shared = 1 << 30
            for j in range(i + 1, n):
                shared = min(shared, order[j][0])
                p, q = order[i][1][2], order[j][1][2]
                a, b = LENGTH - shared, common(p[::-1], q[::-1])
                add(i, a, b)
                add(j, a, b)
    else:
        after = np.array([0] + [h for h, _ in order[1:]])
        turned = [e[2][::-1] for _, e in order]
        by_before = sorted(range(n), key=turned.__getitem__)
        before = np.array([0] + [common(turned[x], turned[y]) for x, y in zip(by_before, by_before[1:])])
        least, most = np.array([e[3] for _, e in order]), np.array([len(e[2]) for _, e in order])
        run = np.empty(n, np.int64)
        for o in range(int(least.min()), int(most.max()) + 1):
            run[by_before] = np.cumsum(before < o)
            able = np.nonzero((least <= o) & (o <= most))[0]
            both = np.cumsum(after < LENGTH - o)[able] * (n + 1) + run[able]
            _, at, times = np.unique(both, return_inverse=True, return_counts=True)
            for i in able[times[at] > 1].tolist():
                add(i, o, o)
    for i, (_, e) in enumerate(order):
        if e[4] in often:
            found[i] = [e[3], len(e[2])]
    for i, (a, b) in found.items():
        e = order[i][1]
        yield e[4], len(e[2]) - b, len(e[2]) - a + LENGTH


def hot_hits(rows: DataFrame) -> DataFrame:
    """d1, d2, from, to of what repeats around the anchors ``hot`` of ``rows``, by the strings themselves."""
    schema = pa.schema([(c, pa.int64()) for c in ("d1", "d2", "s1", "s2")] + [(c, pa.int32()) for c in ("least", "before", "o")])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                often = {r["digests"][16 * i : 16 * i + 16] for i in r["hot_often"]}
                for suffix, before, least, digest in entries(r, "hot"):
                    text, n = before + suffix, len(before)
                    offsets = np.arange(least, n + 1, dtype=np.int32)
                    keys = b"".join(hashlib.blake2b(text[n - o : n - o + LENGTH], digest_size=16).digest() for o in offsets.tolist())
                    s, d = np.frombuffer(keys, "<i8").reshape(-1, 2), np.frombuffer(digest, "<i8")
                    if digest in often:  # repeats whole: each string twice
                        s, offsets = np.repeat(s, 2, 0), np.repeat(offsets, 2)
                    k = len(offsets)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, d[0])), pa.array(np.full(k, d[1])), pa.array(np.ascontiguousarray(s[:, 0])), pa.array(np.ascontiguousarray(s[:, 1])), pa.array(np.full(k, least, np.int32)), pa.array(np.full(k, n, np.int32)), pa.array(offsets)], schema=schema)

    scratch = Scratch(rows.sparkSession, "suffix-hot")
    every = scratch.table(rows.where(F.size("hot") > 0).mapInArrow(lean(strings), "d1 long, d2 long, s1 long, s2 long, least int, before int, o int"), "strings")
    twice = scratch.table(every.groupBy("s1", "s2", "o").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
    found = every.join(twice, ["s1", "s2", "o"]).groupBy("d1", "d2", "before").agg(F.min("o").alias("a"), F.max("o").alias("z"))
    return found.select("d1", "d2", (F.col("before") - F.col("z")).cast("int").alias("from"), (F.col("before") - F.col("a") + LENGTH).cast("int").alias("to"))


def removed_spans(docs: DataFrame) -> DataFrame:
    """dk, th, spans (array of (start, stop) in bytes, not yet merged) of the texts that lose bytes."""
    scratch = Scratch(docs.sparkSession, "suffix")
    marks = scratch.table(anchor_hashes(docs), "anchors")
    # What is joined back is a table of its own each time, so that Spark can split a frequent key.
    hashes = scratch.table(marks.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    placed = marks.select("dk", "th", F.explode(F.arrays_zip("at", "hashes")).alias("x")).select("dk", "th", F.col("x.at").alias("at"), F.col("x.hashes").alias("h"))
    marked = scratch.table(placed.join(hashes, "h").groupBy("dk", "th").agg(F.collect_set("at").alias("at")), "marked")
    scratch.drop(marks)
    scratch.drop(hashes)
    texts = docs.select(*_keys(docs), _text()).join(marked, ["dk", "th"]).select("dk", "th", "text", "at")
    segments = scratch.table(surroundings(texts), "segments")
    scratch.drop(marked)
    places = scratch.table(occurrences(segments), "places")
    owners = scratch.table(places.groupBy("d1", "d2").agg(F.min("dk").alias("owner"), F.count("*").alias("n"), F.min(F.col("stop") - F.col("start")).cast("long").alias("bytes"), F.min("h").alias("h")), "owners")
    hot = scratch.table(owners.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h", F.lit(True).alias("is_hot")), "hot")
    some_hot = bool(hot.limit(1).count())
    own = places.join(owners.select("d1", "d2", "owner", "n"), ["d1", "d2"]).where(F.col("dk") == F.col("owner"))
    own = own.join(hot, "h", "left") if some_hot else own.withColumn("is_hot", F.lit(None).cast("boolean"))
    cold, often = F.col("is_hot").isNull(), F.col("n") > 1
    picked = lambda test: F.collect_set(F.when(test, F.col("i")))
    sent = own.groupBy("dk", "th").agg(picked(cold).alias("pick"), picked(cold & often).alias("often"), picked(~cold).alias("hot"), picked(~cold & often).alias("hot_often"))
    rows = segments.join(sent, ["dk", "th"]).select("keys", "text", "digests", "pick", "often", "hot", "hot_often")
    if some_hot:
        rows = scratch.table(rows, "rows")
    total, size = owners.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = 4 * parts_for(docs.sparkSession, size)  # so small that a few which fall to one task by hash do no harm
    rate = max(1, total // max(8192, SAMPLE * parts))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [e[0][:SHARED] for r in b.to_pylist() for e in entries(r) if int.from_bytes(e[3][:8], "little") % rate == 0]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], ["p"])

    picks = sorted(x.as_py() for x in rows.mapInArrow(lean(sampled), "p binary").toArrow()["p"]) if parts > 1 else []  # 8 a splitter
    splitters_at = scratch.keep(sorted({picks[len(picks) * i // parts] for i in range(1, parts)}) if picks else [], "splitters")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        splitters = held(splitters_at, lambda: stored(splitters_at))
        runs_of: dict[int, list] = defaultdict(list)
        marks: dict[int, list] = defaultdict(list)
        size = 0

        def flush() -> pa.RecordBatch:
            parts_ = sorted(runs_of)
            out = [pa.array(parts_, pa.int32()), pa.array([front_code(sorted(runs_of[p])) for p in parts_], pa.binary()), pa.array([b"".join(marks[p]) for p in parts_], pa.binary())]
            runs_of.clear()
            marks.clear()
            return pa.RecordBatch.from_arrays(out, ["part", "run", "often"])

        for b in batches:
            for r in b.to_pylist():
                often = {r["digests"][16 * i : 16 * i + 16] for i in r["often"]}
                for e in entries(r):
                    p = bisect_right(splitters, e[0][:SHARED])
                    runs_of[p].append(e)
                    size += len(e[0]) + len(e[1])
                    if e[3] in often:
                        marks[p].append(e[3])
                if size > 32 << 20:
                    yield flush()
                    size = 0
        yield flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("from", pa.int32()), ("to", pa.int32())])

        def solve(found: list[bytes], marks: list[bytes]) -> pa.RecordBatch:
            often = {x[i : i + 16] for x in marks for i in range(0, len(x), 16)}
            group, out = [], []
            for h, e in merge(found):
                if h < SHARED and group:
                    out += repeats(group, often)
                    group = []
                group.append((h, e))
            out += repeats(group, often)
            d = np.frombuffer(b"".join(x[0] for x in out), "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], schema=schema)

        part, found, marks = None, [], []
        for b in batches:
            for p, r, o in zip(*(b.column(c).to_pylist() for c in ("part", "run", "often"))):
                if p != part and found:
                    yield solve(found, marks)
                    found, marks = [], []
                part = p
                found.append(r)
                marks.append(o)
        if found:
            yield solve(found, marks)

    dealt = rows.mapInArrow(lean(runs), "part int, run binary, often binary").repartition(parts, "part").sortWithinPartitions("part")
    hits = dealt.mapInArrow(lean(merged), "d1 long, d2 long, from int, to int")
    hits = scratch.table(hits.unionByName(hot_hits(rows)) if some_hot else hits, "hits")
    scratch.drop(segments, owners, hot, *[rows] * some_hot)
    spans = places.join(hits, ["d1", "d2"]).select("dk", "th", F.struct((F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("stop")).alias("s"))
    return spans.groupBy("dk", "th").agg(F.collect_set("s").alias("spans"))


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; ``with_text`` adds kept (binary)."""
    rows = docs.select("doc_id", *_keys(docs), _text()).join(removed_spans(docs), ["dk", "th"], "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(b.column("text"), b.column("spans")):
                data, parts, last, n = text.as_py().encode(), [], 0, 0
                stop = -1
                for s in sorted((s["start"], s["stop"]) for s in spans.as_py() or ()):
                    if s[0] > stop:
                        n += 1
                        parts.append(data[last : s[0]])
                    stop = last = max(stop, s[1])
                kept = b"".join([*parts, data[last:]])
                for column, x in zip(out, (len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, kinds))][: len(names)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
