"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

An item of n words is looked for in all windows of n words of every whole text; a shorter text is
itself the one window of items that it can reach the similarity with. Three steps:

1. A window that reaches the similarity shares most of its five-word shingles with the item, so
   windows with fewer shingles of the benchmark than that are passed over (this loses nothing, and
   needs only the numbers of the benchmark's own words).
2. The SimHash of a window, summed from its shingles with their repeats as weights, is looked up among
   the items of that size. The 64 bits are cut into BLOCKS blocks; two fingerprints within RADIUS
   differ by at most RADIUS // BLOCKS bits in some block, so trying these variants of each block
   finds all items within RADIUS.
3. Candidates are kept if their weighted shingle similarity (sum of least counts over sum of greatest
   counts) reaches the threshold.

RADIUS lies four standard deviations above the distance expected at similarity 0.8. The benchmark is
taken in blocks of bounded size, each shipped to the workers and held against all documents.

Defined cases: items and texts without words match nothing; items shorter than five words have one
shingle, all their words; equal items are all reported; null ids are kept as they are; repeated rows
are reported each by itself; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, WordIds, held, lean, shingle_hashes, stored, words_of

K = 5
THRESHOLD = 0.8
RADIUS = 21
BLOCKS = 8
BENCHMARK_BLOCK = 16 << 20  # most bytes of items shipped at once
MASKS = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(64 // BLOCKS), n)]


def sign_sums(shingles: np.ndarray) -> np.ndarray:
    """Running sums of the +1 / -1 bits of shingle hashes, from which any window's SimHash follows."""
    mixed = shingles * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    return np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def fingerprints(sums: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the windows of ``n`` shingles that begin at ``starts``."""
    return np.packbits(sums[starts + n] - sums[starts] > 0, axis=1, bitorder="little").view("<u8").ravel()


def run_keys(ids: np.ndarray, k: int) -> np.ndarray:
    """64-bit keys of the runs of ``k`` word numbers; equal runs have equal keys."""
    out = ids[: len(ids) - k + 1]
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - k + 1 + j]
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(31))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    least = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return least / (a.total() + b.total() - least)


class Index:
    """The items of one benchmark block, by size."""

    def __init__(self, items: list[tuple], threshold: float = THRESHOLD):
        self.threshold = threshold
        ids = WordIds()
        self.items, self.sizes = [], defaultdict(list)
        self.vocabulary: dict[str, int] = {}
        keys: dict[int, list[np.ndarray]] = defaultdict(list)  # by words in a shingle
        for item_id, text in items:
            words = words_of(text)
            if words:
                s = shingle_hashes(words, ids, K)
                self.sizes[len(words)].append(len(self.items))
                self.items.append((item_id, Counter(s.tolist()), fingerprints(sign_sums(s), np.zeros(1, np.int64), len(s))[0]))
                own = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
                keys[min(K, len(words))].append(run_keys(own, min(K, len(words))))
        # For each size, block and byte: a bit set of the members with a byte within RADIUS // BLOCKS bits.
        self.prints = {size: np.array([self.items[m][2] for m in members], np.uint64) for size, members in self.sizes.items()}
        self.tables = {}
        for size, members in self.sizes.items():
            table = np.zeros((BLOCKS, 256, -(-len(members) // 64)), np.uint64)
            for i, m in enumerate(members):
                for b in range(BLOCKS):
                    own = int(self.items[m][2]) >> (8 * b) & 255
                    table[b, [own ^ mask for mask in MASKS], i // 64] |= np.uint64(1 << i % 64)
            self.tables[size] = table
        self.known = {k: np.unique(np.concatenate(x)) for k, x in keys.items()}
        self.maybe = {k: np.zeros(1 << 22, bool) for k in self.known}
        for k, found in self.known.items():
            self.maybe[k][found >> np.uint64(42)] = True

    def near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, member) of the fingerprints that lie within RADIUS of an item of ``size`` words."""
        table, parts = self.tables[size], prints.view(np.uint8).reshape(-1, BLOCKS)
        able = table[0, parts[:, 0]]
        for b in range(1, BLOCKS):
            able = able | table[b, parts[:, b]]
        w, m = np.nonzero(np.unpackbits(able.view(np.uint8), axis=1, bitorder="little"))
        close = np.bitwise_count(prints[w] ^ self.prints[size][m]) <= RADIUS
        return w[close], m[close]

    def search(self, words: list[str], ids: WordIds) -> dict[int, float]:
        """Best similarity of each item that a window of ``words`` reaches."""
        best: dict[int, float] = {}
        placed = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        for k, known in self.known.items():
            if len(words) < k:
                continue
            keys = run_keys(placed, k)
            at = np.nonzero(self.maybe[k][keys >> np.uint64(42)])[0]
            at = at[known[np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)] == keys[at]]
            if not len(at):
                continue
            hit = np.zeros(len(keys) + 1, np.int32)
            hit[at + 1] = 1
            shared = np.cumsum(hit)
            s = sums = None
            for size in self.sizes:
                n = size - k + 1
                width = min(n, len(keys))
                if min(K, size) != k or width < self.threshold * n - 1e-9:
                    continue
                least = int(np.ceil((n + width) * self.threshold / (1 + self.threshold) - 1e-9))
                if len(at) < least:
                    continue
                starts = np.nonzero(shared[width:] - shared[: len(keys) - width + 1] >= least)[0]
                if not len(starts):
                    continue
                if s is None:
                    s = shingle_hashes(words, ids, k)
                    sums = sign_sums(s)
                found, members = self.near(size, np.ascontiguousarray(fingerprints(sums, starts, width)))
                for start, m in zip(starts[found].tolist(), members.tolist()):
                    m = self.sizes[size][m]
                    if best.get(m, 0.0) < 1.0:
                        got = similarity(Counter(s[start : start + width].tolist()), self.items[m][1])
                        if got >= self.threshold - 1e-12 and got > best.get(m, 0.0):
                            best[m] = got
        return best


def blocks_of(benchmark: DataFrame) -> Iterator[str]:
    """Paths of the benchmark's blocks of about BENCHMARK_BLOCK bytes each, as Arrow tables (item_id, text)."""
    scratch = Scratch(benchmark.sparkSession, "benchmark")
    items = benchmark.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BENCHMARK_BLOCK) or 1
    for i in range(n):
        yield scratch.keep(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).toArrow(), f"block{i}")


def index_at(path: str, threshold: float) -> tuple[Index, pa.ChunkedArray]:
    """A block's index, whose items are known by their rows, and its item ids."""
    table = stored(path)
    return Index(list(enumerate(table["text"].to_pylist())), threshold), table["item_id"]


def hits(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity: a row for each item that a document (doc_id, text) contains."""
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    out = None
    for path in blocks_of(benchmark):

        def run(batches: Iterator[pa.RecordBatch], path=path) -> Iterator[pa.RecordBatch]:
            index, item_ids = held(path, lambda: index_at(path, threshold))
            ids = WordIds()
            for b in batches:
                rows, found, scores = [], [], []
                for at, text in enumerate(b.column("text")):
                    for m, score in index.search(words_of(text.as_py()), ids).items():
                        rows.append(at)
                        found.append(index.items[m][0])
                        scores.append(score)
                items = item_ids.take(pa.array(found, pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items, pa.array(scores, pa.float64())], ["doc_id", "item_id", "similarity"])

        got = docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double")
        out = got if out is None else out.unionByName(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns as they are, that contain no item of ``benchmark``."""
    for path in blocks_of(benchmark):

        def run(batches: Iterator[pa.RecordBatch], path=path) -> Iterator[pa.RecordBatch]:
            index, _ = held(path, lambda: index_at(path, threshold))
            ids = WordIds()
            for b in batches:
                yield b.filter(pa.array([not index.search(words_of(t.as_py()), ids) for t in b.column("text")], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
