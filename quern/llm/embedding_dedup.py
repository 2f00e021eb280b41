"""Embedding near-duplicates by product quantisation with inverted lists and an exact cosine check.

Equal vectors form a class, known by a 128-bit hash and numbered, and are compared once. Unit vectors are
put into the coarse list of their nearest centroid; what is left of them is coded by subspaces.

Probes: the plane half-way between a vector's own centroid and another one parts the two cells. Of two
linked vectors in different cells, which differ by ``reach`` at most, one lies within reach / 2 of the
plane between them. So a vector that probes all lists whose plane is that near, and is looked for
likewise, misses nothing (``exact=True``). By default the limit is what SIGMAS standard deviations of a
difference of length reach take across a plane, if its direction has nothing to do with the plane: far
fewer lists, and a loss below the measured one in the tests. The number of probes has no cap.

1. Look-up: a query is sent to its lists in 8 bits a component, rows as codes. Tables of the distances
   from the query's residual to the subspace centroids give, by look-up, the distance to each code. Each
   side carries the error of its own coding, so a row is passed over only where that distance exceeds the
   threshold's by more than both: within probed lists nothing is lost.
2. Rerank: only vectors with a candidate are sent to that place again, now whole, and all of these are
   compared by cosine in double precision.

A list is cut into blocks of at most about BLOCK rows, its queries likewise, and each pair of blocks
is one unit of work, so a list of any size is spread. A unit returns one row a class: its number of
links and a tie to the least class it is linked to, never the pairs. A pair that both sides find is
counted by the lesser.

Centroids and codebooks are fitted on at most SAMPLE vectors drawn by hash; all vectors are indexed. The
number of lists is the root of the number of vectors, up to MOST_LISTS (reached at 16 million vectors);
from there on lists grow, in more blocks, and nothing else changes.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are their own component; vectors of other dimensions are compared with their own kind, in a
pass of their own; repeated rows are copies of each other; a null vec_id links like any other and is shown
as null, as is a component whose least id it is; ids that aren't whole numbers are refused; an empty
table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import NO_ID, Scratch, components, held, lean, stored, whole_ids

THRESHOLD = 0.9
SAMPLE = 65_536  # vectors that the index is fitted on, at most
SAMPLE_NUMBERS = 1 << 23  # and numbers in them
MOST_LISTS = 4096
SIGMAS = 3.0  # a loss of about 0.1 % of pairs right at the threshold; nearer pairs lose less
SUBSPACES = 8
CODES = 128
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centroids of ``x`` from rows spread over it; an empty centroid stays where it was."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(x, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` nearest centroids of each row, nearest first."""
    out = []
    for k in range(0, len(x), 4096):
        d = (centroids**2).sum(1) - 2 * x[k : k + 4096] @ centroids.T
        part = np.argpartition(d, min(n, d.shape[1]) - 1, 1)[:, :n] if n < d.shape[1] else np.argsort(d, 1)
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), 1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, n), int)


class Index:
    """Coarse centroids and residual codebooks for unit vectors."""

    def __init__(self, sample: np.ndarray, n_rows: int, threshold: float, exact: bool):
        self.dim = sample.shape[1]
        self.centroids = kmeans(sample, lists_for(n_rows, len(sample)))
        self.reach = math.sqrt(max(0.0, 2 - 2 * threshold))
        self.margin = self.reach / 2 * (1.0 if exact else min(1.0, SIGMAS / math.sqrt(self.dim))) + 1e-9
        self.apart = np.sqrt(np.maximum(((self.centroids[:, None] - self.centroids[None]) ** 2).sum(2), 1e-30)) if len(self.centroids) < 256 else None
        self.cuts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        rest = sample - self.centroids[nearest(sample, self.centroids, 1)[:, 0]]
        self.books = [kmeans(rest[:, c], min(CODES, len(sample))) for c in self.cuts]

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(home, probed lists) of each row."""
        home, out = [], []
        norms = (self.centroids**2).sum(1)
        step = max(1, (1 << 21) // len(self.centroids))
        for k in range(0, len(x), step):
            d = norms - 2 * x[k : k + step] @ self.centroids.T
            own = d.argmin(1)
            gap = d - d[np.arange(len(d)), own][:, None]
            if self.apart is not None:
                apart = self.apart[own]
            else:
                apart = np.sqrt(np.maximum(norms[own][:, None] + norms - 2 * self.centroids[own] @ self.centroids.T, 1e-30))
            near = gap <= 2 * self.margin * apart
            near[np.arange(len(d)), own] = True
            home.append(own)
            out += [np.nonzero(row)[0].astype("<i4") for row in near]
        return np.concatenate(home), out

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes in the home list, error of the code) of each row."""
        rest = x - self.centroids[home]
        codes = np.stack([nearest(rest[:, c], b, 1)[:, 0] for c, b in zip(self.cuts, self.books)], 1).astype(np.uint8)
        coded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest - coded) ** 2).sum(1))

    def distances(self, queries: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Distance from each query to each coded row of a list, by table look-up."""
        rest = queries - self.centroids[of]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for i, (c, b) in enumerate(zip(self.cuts, self.books)):
            table = (rest[:, c] ** 2).sum(1)[:, None] - 2 * rest[:, c] @ b.T + (b**2).sum(1)
            total += table.astype(np.float32)[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


def lists_for(n_rows: int, n_sample: int) -> int:
    return max(1, min(MOST_LISTS, int(math.sqrt(n_rows)), n_sample // 4))


def short(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8-bit numbers, their scale, the error made) of unit vectors."""
    scale = np.maximum(np.abs(x).max(1), 1e-30) / 127
    small = np.rint(x / scale[:, None]).astype(np.int8)
    return small, scale, np.sqrt(((small * scale[:, None] - x) ** 2).sum(1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def join(vectors: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding)."""
    whole_ids(vectors, "vec_id")
    scratch = Scratch(vectors.sparkSession, "embedding")
    e = F.transform(F.col("embedding"), lambda x: x.cast("double") + 0.0)  # -0.0 becomes 0.0
    fine = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    number = vectors.schema["embedding"].dataType.elementType.simpleString()
    kept = e if number != "float" else F.transform(e, lambda x: x.cast("float"))
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vk"), F.when(fine, F.xxhash64(e)).alias("c1"), F.when(fine, F.xxhash64(F.lit(1), e)).alias("c2"), kept.alias("e"))
    ids = scratch.table(rows.select("vk", "c1", "c2"), "ids")
    distinct = rows.where("c1 is not null").groupBy("c1", "c2").agg(F.first("e").alias("e"), F.min("vk").alias("first"), F.count("*").alias("size"))
    distinct = scratch.table(distinct.select(F.monotonically_increasing_id().alias("c"), "*", F.size("e").alias("dim")), "vectors")  # written, so the numbers stay
    links, done = None, []
    for dim, n in [(r["dim"], r["count"]) for r in distinct.groupBy("dim").count().orderBy("dim").collect()]:
        part, used = links_of(scratch, distinct.where(F.col("dim") == dim), dim, n, threshold, exact)
        done += used
        links = part if links is None else links.unionByName(part)
    classes = distinct.select("c", "c1", "c2", "first", "size")
    whole = classes.withColumn("root", F.col("c")).withColumn("links", F.lit(0).cast("long"))
    if links is not None:
        links = scratch.table(links, "links")
        scratch.drop(*done)
        total = links.groupBy("c").agg(F.sum("links").alias("links"))
        tied = components(scratch, links.select(F.col("c").alias("a"), F.col("tie").alias("b")))
        whole = classes.join(total, "c", "left").join(tied.select(F.col("v").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = whole.groupBy("root").agg(F.min("first").alias("least"))
    by_class = whole.join(least, "root").select("c1", "c2", "least", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    shown = lambda x: F.when(x != NO_ID, x)
    root = F.coalesce("least", "vk")
    return ids.join(by_class, ["c1", "c2"], "left").select(shown(F.col("vk")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), shown(root).alias("component_id"), (F.col("vk") == root).alias("kept"))


def links_of(scratch: Scratch, vectors: DataFrame, dim: int, n: int, threshold: float, exact: bool) -> tuple[DataFrame, list[DataFrame]]:
    """c, tie, links: rows to be summed by class; and the tables they come from. ``vectors`` (c, c1, e, size) are all of one dimension."""
    most = max(256, min(SAMPLE, max(16_384, 16 * int(math.sqrt(n))), SAMPLE_NUMBERS // dim))
    share = 1.2 * most / n + 100 / n
    drawn = vectors.where(F.pmod("c1", F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000) + 1).orderBy("c1", "c2").limit(most).select("e").toArrow()
    if not len(drawn):
        drawn = vectors.limit(1).select("e").toArrow()
    index_path = scratch.keep(Index(unit(numbers(drawn.column("e").combine_chunks(), dim)), n, threshold, exact), "index")
    index_at = lambda: held(index_path, lambda: stored(index_path))
    kind = "<f4" if vectors.schema["e"].dataType.elementType.simpleString() == "float" else "<f8"
    binary = lambda y: pa.array([v.tobytes() for v in y], pa.binary())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_at()
        for b in batches:
            if not b.num_rows:
                continue
            raw = numbers(b.column("e"), dim)
            x = unit(raw)
            home, probes = index.probes(x)
            codes, error = index.encode(x, home)
            small, scale, lost = short(x)
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("size"), pa.array(home.astype(np.int32)), pa.array(probes, pa.list_(pa.int32())), binary(codes), pa.array(error), binary(small), pa.array(scale), pa.array(lost), binary(raw.astype(kind))], ["c", "size", "home", "probes", "codes", "error", "small", "scale", "lost", "x"])

    coded = scratch.table(vectors.select("c", "size", "e").mapInArrow(lean(encode), "c long, size long, home int, probes array<int>, codes binary, error double, small binary, scale double, lost double, x binary"), "coded")
    rows = coded.groupBy("home").agg(F.count("*").alias("n")).select(F.col("home").alias("of"), F.ceil(F.col("n") / BLOCK).cast("int").alias("rb"))
    asked = coded.select(F.explode("probes").alias("of")).groupBy("of").agg(F.count("*").alias("n")).select("of", F.ceil(F.col("n") / BLOCK).cast("int").alias("qb"))
    grid = rows.join(asked, "of")
    hashed = F.xxhash64("c")
    left = coded.withColumn("of", F.col("home")).join(grid, "of").select("of", F.pmod(hashed, F.col("rb")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("j"), F.lit(0).alias("side"), "c", F.col("codes").alias("data"), F.lit(0.0).alias("scale"), "error")
    right = coded.select("c", "small", "scale", "lost", F.explode("probes").alias("of")).join(grid, "of").select("of", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("i"), F.pmod(hashed, F.col("qb")).cast("int").alias("j"), F.lit(1).alias("side"), "c", F.col("small").alias("data"), "scale", F.col("lost").alias("error"))
    units = left.unionByName(right).repartition("of", "i", "j").sortWithinPartitions("of", "i", "j", "side")

    def candidates(held_: list[tuple], key: tuple) -> pa.RecordBatch:
        """Of one unit's rows (side, c, data, scale, error), those with a candidate on the other side."""
        index = index_at()
        own, asking = ([r for r in held_ if r[0] == s] for s in (0, 1))
        found = np.zeros(len(own), bool), np.zeros(len(asking), bool)
        if own and asking:
            codes = np.frombuffer(b"".join(r[2] for r in own), np.uint8).reshape(len(own), -1)
            c, d = (np.array([r[1] for r in x], np.int64) for x in (own, asking))
            x = np.frombuffer(b"".join(r[2] for r in asking), np.int8).reshape(-1, dim) * np.array([r[3] for r in asking])[:, None]
            slack = np.array([r[4] for r in own]) + index.reach + 1e-4
            lost = np.array([r[4] for r in asking])
            for k in range(0, len(asking), 512):
                q = slice(k, k + 512)
                maybe = (index.distances(x[q], key[0], codes) <= slack + lost[q][:, None]) & (d[q][:, None] != c)
                found[1][q] = maybe.any(1)
                found[0][:] |= maybe.any(0)
        kept = [(side, r[1]) for side, part, hit in ((0, own, found[0]), (1, asking, found[1])) for r, h in zip(part, hit) if h]
        place = [pa.array(np.full(len(kept), v, np.int32)) for v in key]
        return pa.RecordBatch.from_arrays([*place, pa.array([k[0] for k in kept], pa.int32()), pa.array([k[1] for k in kept], pa.int64())], ["of", "i", "j", "side", "c"])

    active = scratch.table(units.mapInArrow(lean(by_unit(("side", "c", "data", "scale", "error"), candidates)), "of int, i int, j int, side int, c long"), "active")
    whole = active.join(coded.select("c", "size", "home", "probes", "x"), "c").withColumn("probes", F.when(F.col("side") == 0, F.col("probes")))

    def solve(held_: list[tuple], key: tuple) -> pa.RecordBatch:
        """(c, tie, links) of the links of one unit's rows (side, c, size, home, probes, x) that count here."""
        own, asking = ([r for r in held_ if r[0] == s] for s in (0, 1))
        none = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["c", "tie", "links"])
        if not own or not asking:
            return none
        c, d = (np.array([r[1] for r in x], np.int64) for x in (own, asking))
        size, asking_size = (np.array([r[2] for r in x], np.int64) for x in (own, asking))
        x, y = (unit(np.frombuffer(b"".join(r[5] for r in part), kind).reshape(-1, dim).astype(float)) for part in (own, asking))
        homes, at = np.unique(np.array([r[3] for r in asking]), return_inverse=True)
        back = np.zeros((len(own), len(homes)), bool)  # whether a row probes a query's home
        for i, r in enumerate(own):
            back[i] = np.isin(homes, r[4], kind="sort")
        pairs = []
        for k in range(0, len(asking), 512):
            near = (y[k : k + 512] @ x.T >= threshold) & (d[k : k + 512, None] != c)
            # Seen from both sides, a pair counts for the lesser; from one side it counts there.
            a, b = np.nonzero(near & (~back.T[at[k : k + 512]] | (d[k : k + 512, None] < c)))
            pairs.append((a + k, b))
        a, b = (np.concatenate(p) for p in zip(*pairs))
        if not len(a):
            return none
        names, place = np.unique(np.concatenate([d[a], c[b]]), return_inverse=True)
        p, q = place[: len(a)], place[len(a) :]
        links = np.bincount(p, size[b], len(names)) + np.bincount(q, asking_size[a], len(names))
        root = np.arange(len(names))
        while True:
            was = root.copy()
            np.minimum.at(root, p, was[q])
            np.minimum.at(root, q, was[p])
            root = root[root]
            if (was == root).all():
                return pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root]), pa.array(links.astype(np.int64))], ["c", "tie", "links"])

    dealt = whole.select("of", "i", "j", "side", "c", "size", "home", "probes", "x").repartition("of", "i", "j").sortWithinPartitions("of", "i", "j", "side")
    return dealt.mapInArrow(lean(by_unit(("side", "c", "size", "home", "probes", "x"), solve)), "c long, tie long, links long"), [coded, active]


def numbers(e: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list array of equal lengths, in double precision."""
    return e.values.to_numpy()[e.offsets[0].as_py() : e.offsets[-1].as_py()].reshape(-1, dim).astype(float)


def by_unit(columns: tuple, solve):
    """A function for mapInArrow that hands each run of rows of one (of, i, j) to ``solve``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in ("of", "i", "j")))
            for key, r in zip(keys, zip(*(b.column(k).to_pylist() for k in columns))):
                if key != at:
                    if rows:
                        yield solve(rows, at)
                    at, rows = key, []
                rows.append(r)
        if rows:
            yield solve(rows, at)

    return run
