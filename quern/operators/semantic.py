"""Vectors: passages, embedding by callables, cosine ranking with max-pooling, approximate search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T

DIM = 256
ANSWER_FLOOR = 0.6
GRAPH_FLOOR = 0.5
MOST_NODES, MOST_NEIGHBOURS = 1500, 16
# The 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(text: str) -> int:
    h = FNV_OFFSET
    for b in text.encode():
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def hash_embedder(dim: int = DIM, stemmed: bool = True) -> Callable[[pd.Series], pd.Series]:
    """The built-in embedder: terms are hashed to signed buckets, then the vector is normalised."""
    from quern.plans.queryparse import places

    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}
        out = []
        for text in texts:
            v = np.zeros(dim)
            for term, _ in places(text or "", stemmed):
                if term not in known:
                    h = fnv1a(term)
                    known[term] = h % dim, -1.0 if h >> 63 else 1.0
                i, sign = known[term]
                v[i] += sign
            n = np.sqrt((v * v).sum())
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return embed


def passages(docs: DataFrame, words_per: int = 150, most: int = 6, overlap: int = 0) -> DataFrame:
    """doc_id, passage_idx, title, text."""
    return docs.select("doc_id", "title", F.posexplode_outer(T.passages(F.col("text"), words_per, most, overlap)).alias("passage_idx", "text")).where("text is not null")


def embedded(passages_: DataFrame, embedder: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """doc_id, passage_idx, text, embedding; the prompt is the title and the passage."""
    run = F.pandas_udf(embedder, "array<float>")
    return passages_.select("doc_id", "passage_idx", "text", run(F.concat_ws(". ", "title", "text")).alias("embedding"))


def embed_missing(passages_: DataFrame, have: DataFrame, embedder: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """``have`` and the vectors of the passages that it lacks."""
    new = passages_.join(have.select("doc_id", "passage_idx"), ["doc_id", "passage_idx"], "left_anti")
    return have.unionByName(embedded(new, embedder))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; 0 for empty or unequal lengths."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), product).otherwise(0.0)


def similarities(query_vectors: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, doc_id, passage_idx, sim of query_vectors (query_id, qv) against all vectors.

    Exact search is a product by nature: a stated set of queries against all passages, scanned once.
    """
    pairs = vectors.select("doc_id", "passage_idx", "embedding").crossJoin(query_vectors.select("query_id", "qv"))
    return pairs.select("query_id", "doc_id", "passage_idx", dot(F.col("embedding"), F.col("qv")).alias("sim"))


MOST_SHIPPED = 8 << 20  # numbers in the query matrix that is sent to the workers
MOST_PAIRS = 2 << 20  # pairs of a query and a vector that a worker holds at a time
TILE = 256  # queries that a worker compares at a time
SPARE = 5  # beyond k: hits that tasks send on, should two ways of rounding place them otherwise


def _query_matrix(query_vectors: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors, a row each; None where there are none, too many to be sent, or several lengths."""
    size = query_vectors.agg(F.sum(F.size("qv").cast("long")), F.max(F.size("qv")), F.min(F.size("qv"))).first()
    if not size[0] or size[0] > MOST_SHIPPED or size[1] != size[2]:
        return None
    rows = query_vectors.select("query_id", "qv").collect()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def _ids_are_long(query_vectors: DataFrame, vectors: DataFrame) -> bool:
    return all(t.schema[c].dataType.simpleString() in ("bigint", "int") for t, c in ((query_vectors, "query_id"), (vectors, "doc_id")))


def pooled(query_vectors: DataFrame, vectors: DataFrame, floor: float = 0.0, most: int | None = None) -> DataFrame:
    """``max_pooled`` of the similarities above ``floor`` (0 or more), by matrix products.

    The query matrix is sent to the workers if it holds MOST_SHIPPED numbers at most, and vectors
    stream past it, MOST_PAIRS pairs at a time; a document's passages are pooled where they meet. Larger
    query sets are joined. With ``most`` only documents that may be among a query's best ``most`` leave a
    batch: as a document's best passage is in some batch, the best ``most`` of all are among them, ties
    included. Vectors of other lengths than the query's have no similarity.
    """
    sent = _query_matrix(query_vectors) if _ids_are_long(query_vectors, vectors) else None
    if sent is None:
        return max_pooled(similarities(query_vectors, vectors)).where(F.col("score") > floor)
    ids, matrix = sent

    def run(batches):
        for b in batches:
            b = b[b["embedding"].map(len) == matrix.shape[1]]
            if not len(b):
                continue
            b = b.sort_values(["doc_id", "passage_idx"], kind="stable")
            doc, first = np.unique(b["doc_id"].to_numpy(), return_index=True)
            ends, places = [*first[1:], len(b)], b["passage_idx"].to_numpy()
            unit = np.stack(b["embedding"].to_numpy()).astype(np.float64)
            step = max(1, MOST_PAIRS // len(b))
            for at in range(0, len(ids), step):
                sims = unit @ matrix[at : at + step].T
                best = np.maximum.reduceat(sims, first, axis=0)
                above = best > floor
                if most is not None and len(best) > most:
                    above &= best >= np.partition(best, len(best) - most, axis=0)[len(best) - most]
                d, q = np.nonzero(above)
                last = np.empty(best.shape, np.int64)
                for i, (lo, hi) in enumerate(zip(first, ends)):
                    last[i] = places[hi - 1 - np.argmax(sims[lo:hi][::-1], axis=0)]
                yield pd.DataFrame({"query_id": ids[at + q], "doc_id": doc[d], "sim": best[d, q], "passage_idx": last[d, q]})

    parts = vectors.select("doc_id", "passage_idx", "embedding").mapInPandas(run, "query_id long, doc_id long, sim double, passage_idx long")
    return max_pooled(parts)


def _first_of(held: tuple, k: int, pool: bool) -> tuple:
    """Of columns (query, shown, sim, id) each query's first ``k`` by shown, then id; with ``pool`` an id counts once."""
    if pool:
        query, shown, _, ids = held
        order = np.lexsort((-shown, ids, query))
        query, ids = query[order], ids[order]
        held = tuple(c[order[np.append(True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]))[: len(order)]]] for c in held)
    query, shown, _, ids = held
    order = np.lexsort((ids, -shown, query))
    query = query[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return tuple(c[order[place < k]] for c in held)


def _nearest_in(batches, ids: np.ndarray, matrix: np.ndarray, k: int, digits: int, directions: np.ndarray | None):
    """query_id, doc_id, score of what may be among the ``k`` nearest of a task's vectors, tile by tile.

    With ``directions`` vectors count that share a hashed bucket with the query, and a document once; without,
    vectors of other lengths have the similarity 0, as in ``dot``.
    """
    k, pool = k + SPARE, directions is not None
    tiles = [slice(i, min(i + TILE, len(ids))) for i in range(0, len(ids), TILE)]
    none = (np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0, np.int64))
    held = [none] * len(tiles)
    asked = codes(matrix, directions) if pool else None

    def found(t: int, sims: np.ndarray, docs: np.ndarray) -> None:
        """Take what may come in among those held of a tile; ``sims`` has a row a query."""
        shown, most = np.round(sims, digits), np.bincount(held[t][0], minlength=len(sims))
        kth = np.full(len(sims), -np.inf)
        full = np.flatnonzero(most == k)
        kth[full] = held[t][1][np.cumsum(most)[full] - 1]
        if shown.shape[1] > k and len(full) < len(sims):
            kth = np.maximum(kth, np.partition(shown, shown.shape[1] - k, axis=1)[:, shown.shape[1] - k])
        q, d = np.nonzero((shown >= kth[:, None]) & (shown > -np.inf))
        if len(q):
            held[t] = _first_of(tuple(np.concatenate(c) for c in zip(held[t], (q, shown[q, d], sims[q, d], docs[d]))), k, pool)

    for b in batches:
        fits = (b["embedding"].map(len) == matrix.shape[1]).to_numpy()
        far = np.sort(b["doc_id"].to_numpy()[~fits])[:k]
        if len(far) and not pool:
            for t, tile in enumerate(tiles):
                found(t, np.zeros((tile.stop - tile.start, len(far))), far)
        b = b[fits].sort_values("doc_id", kind="stable")
        for at in range(0, len(b), MOST_PAIRS // TILE):
            part = b.iloc[at : at + MOST_PAIRS // TILE]
            unit, docs = np.stack(part["embedding"].to_numpy()).astype(np.float64), part["doc_id"].to_numpy()
            if pool:
                placed, (docs, first) = codes(unit, directions), np.unique(docs, return_index=True)
            for t, tile in enumerate(tiles):
                sims = matrix[tile] @ unit.T
                if pool:
                    meets = np.zeros(sims.shape, bool)
                    for own, theirs in zip(asked[tile].T, placed.T):
                        meets |= own[:, None] == theirs
                    sims[~meets] = -np.inf
                    sims = sims if len(first) == len(part) else np.maximum.reduceat(sims, first, axis=1)
                found(t, sims, docs)
    for tile, (q, _, sims, docs) in zip(tiles, held):
        yield pd.DataFrame({"query_id": ids[tile][q], "doc_id": docs, "score": sims})


def _spread(vectors: DataFrame) -> DataFrame:
    """``vectors`` in as many parts as tasks can run at once: each is compared with all queries."""
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    return vectors.repartition(tasks) if vectors.rdd.getNumPartitions() < tasks else vectors


def nearest(query_vectors: DataFrame, vectors: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """query_id, doc_id, score, rank: the ``k`` nearest vectors (doc_id, embedding) of each query, exactly.

    Ordered by the score rounded to ``digits``, then doc_id. A task holds each query's best and a tile of
    similarities, however many queries and vectors there are; there is no product of them in the plan.
    """
    from quern.operators.rank import top

    sent = _query_matrix(query_vectors) if _ids_are_long(query_vectors, vectors) else None
    if sent is None:
        found = similarities(query_vectors, vectors.withColumn("passage_idx", F.lit(0))).select("query_id", "doc_id", F.col("sim").alias("score"))
    else:
        found = _spread(vectors.select("doc_id", "embedding")).mapInPandas(lambda batches: _nearest_in(batches, *sent, k, digits, None), "query_id long, doc_id long, score double")
    return top(found, k, [F.desc(F.round("score", digits)), F.asc("doc_id")])


def max_pooled(sims: DataFrame) -> DataFrame:
    """query_id, doc_id, score (best passage), passage_idx; the last of equal passages."""
    best = sims.groupBy("query_id", "doc_id").agg(F.max(F.struct("sim", "passage_idx")).alias("x"))
    return best.select("query_id", "doc_id", F.col("x.sim").alias("score"), F.col("x.passage_idx").alias("passage_idx"))


def normalized(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def planes(dim: int, tables: int, bits: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables, bits, dim))


def codes(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The bucket of each vector in each table; bytes where they hold it."""
    tables, bits, dim = directions.shape
    signs = (x @ directions.reshape(-1, dim).T > 0).reshape(-1, tables, bits)
    return (signs * (1 << np.arange(bits))).sum(2).astype(np.uint8 if bits <= 8 else np.int32)


def buckets(vectors: DataFrame, dim: int, tables: int = 12, bits: int = 10) -> DataFrame:
    """``vectors`` once for each of the hash tables they fall into: columns table and bucket."""
    directions = planes(dim, tables, bits)

    @F.pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(e, float) for e in v]) if len(v) else np.empty((0, dim))
        return pd.Series(list(codes(x, directions).astype(np.int32)))

    return vectors.select("*", F.posexplode(run("embedding")).alias("table", "bucket"))


def approximate(query_vectors: DataFrame, vectors: DataFrame, dim: int, k: int, tables: int = 12, bits: int = 10, digits: int = 9) -> DataFrame:
    """query_id, doc_id, score, rank: the k nearest among vectors that share a bucket with the query.

    Codes are compared beside the similarities, tile by tile as in ``nearest``: short codes meet much of a table,
    so a join on buckets would make nearly every pair several times. Larger query sets are joined. What is
    found is scored exactly and ordered by the score rounded to ``digits``, then doc_id.
    """
    from quern.operators.rank import top

    asked = query_vectors.where(F.size("qv") == dim)
    sent = _query_matrix(asked) if _ids_are_long(asked, vectors) else None
    if sent is None:
        best = approximate_pooled(asked, vectors, dim, tables, bits)
    else:
        directions = planes(dim, tables, bits)
        parts = _spread(vectors.where(F.size("embedding") == dim).select("doc_id", "embedding"))
        found = parts.mapInPandas(lambda batches: _nearest_in(batches, *sent, k, digits, directions), "query_id long, doc_id long, score double")
        best = found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return top(best, k, [F.desc(F.round("score", digits)), F.asc("doc_id")]).select("query_id", "doc_id", "score", "rank")


def approximate_pooled(query_vectors: DataFrame, vectors: DataFrame, dim: int, tables: int = 12, bits: int = 10, placed: DataFrame | None = None) -> DataFrame:
    """``max_pooled`` of the vectors that share a bucket with the query; ``placed``: stored buckets of ``save_ann``.

    Ids alone are joined by bucket, each pair once; vectors are fetched for what is left.
    """
    fits = vectors.where(F.size("embedding") == dim)
    if placed is None:
        placed = buckets(fits.select("doc_id", "passage_idx", "embedding"), dim, tables, bits)
    asked = query_vectors.where(F.size("qv") == dim)
    q = buckets(asked.select("query_id", F.col("qv").alias("embedding")), dim, tables, bits).select("query_id", "table", "bucket")
    found = placed.select("doc_id", "passage_idx", "table", "bucket").join(q, ["table", "bucket"]).select("query_id", "doc_id", "passage_idx").distinct()
    pairs = found.join(fits.select("doc_id", "passage_idx", "embedding"), ["doc_id", "passage_idx"]).join(asked.select("query_id", "qv"), "query_id")
    return max_pooled(pairs.select("query_id", "doc_id", "passage_idx", dot(F.col("embedding"), F.col("qv")).alias("sim")))


def save_ann(vectors: DataFrame, root: str, dim: int, tables: int = 12, bits: int = 10) -> str:
    """Write vectors (doc_id, passage_idx, text, embedding) and their buckets beside each other, as a version under ``root``."""
    from quern.sources.sinks import save_tables

    placed = buckets(vectors.where(F.size("embedding") == dim).select("doc_id", "passage_idx", "embedding"), dim, tables, bits).drop("embedding")
    return save_tables({"vectors": vectors, "buckets": placed.repartition("table", "bucket").sortWithinPartitions("table", "bucket")}, root)


def load_ann(spark, root: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, buckets) of the current version under ``root``."""
    from quern.sources.sinks import load_tables

    found = load_tables(spark, root)
    return found["vectors"], found["buckets"]


def similarity_graph(vectors: DataFrame, most: int = 300, k: int = 4, floor: float = GRAPH_FLOOR) -> DataFrame:
    """a, b, sim (a < b): each node's k best neighbours of at least ``floor`` among the ``most`` of highest rank.

    vectors: doc_id, embedding, rank. The bounds (MOST_NODES, MOST_NEIGHBOURS) are the feature's own: a graph to look at.
    """
    most, k = max(1, min(MOST_NODES, most)), max(1, min(MOST_NEIGHBOURS, k))
    nodes = vectors.orderBy(F.desc("rank"), "doc_id").limit(most).select("doc_id", "embedding")
    left, right = nodes.toDF("a", "ea"), nodes.toDF("b", "eb")
    pairs = left.crossJoin(right).where("a <> b").select("a", "b", dot(F.col("ea"), F.col("eb")).alias("sim")).where(F.col("sim") >= floor)
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    near = pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim"))
