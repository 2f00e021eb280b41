"""Helpers that several training-data operators share: scratch tables, workers' memory, components, shingles.

Scratch tables live in the folder that ``spark.checkpoint.dir`` names (see ``session.shared_dir``), so
that they outlive any executor.
"""

from __future__ import annotations

import ctypes
import gc
import pickle
import re
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import shared_dir

NO_ID = -(2**63)  # stands for a null doc_id inside join keys
WORD = re.compile(r"\w+")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again with the same schema."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``table()`` that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


    def keep(self, value: object, name: str) -> str:
        """``value`` pickled into the shared folder; the path, which workers hand to ``held``."""
        fs, place = pa.fs.FileSystem.from_uri(self.path(name))
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(place) as out:
            pickle.dump(value, out, 5)
        return f"{self.root}/{self.n}-{name}"


PART_BYTES, LEAST_PART_BYTES = 64 << 20, 4 << 20


def parts_for(spark: SparkSession, size: int) -> int:
    """Partitions for ``size`` bytes: of PART_BYTES at most, but as many as shuffles have if each gets LEAST_PART_BYTES."""
    return max(1, -(-size // PART_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_PART_BYTES)))


_HELD: list = []  # what this worker process holds between tasks: (key, value) of the last operator only


def held(key: str, make: Callable[[], object]):
    """``make()``, kept by this worker process until another key is asked for."""
    if not _HELD or _HELD[0][0] != key:
        _HELD.clear()
        release()
        _HELD.append((key, make()))
    return _HELD[0][1]


def stored(path: str):
    """What ``Scratch.keep`` has put at ``path``."""
    fs, place = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_file(place) as f:
        return pickle.load(f)


def release() -> None:
    """Give free memory back to the system, as a reused worker would otherwise keep its highest use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, which gives free memory back when a task ends."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def whole_ids(df: DataFrame, name: str) -> None:
    """Ids that are compared and returned must be whole numbers; other types are refused here, plainly."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{name} must be a whole number, not {kind.simpleString()}")


def id_key(df: DataFrame, name: str = "doc_id") -> Column:
    """A long that stands for an id of any type in join keys: the number itself, or a hash of it."""
    whole = isinstance(df.schema[name].dataType, (T.IntegralType, T.NullType))
    column = F.col(f"`{name}`")
    return F.coalesce(column.cast("long") if whole else F.when(column.isNotNull(), F.xxhash64(column)), F.lit(NO_ID))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(v, root) for each vertex of ``edges`` (a, b): root is the smallest vertex of its component.

    Contraction: each vertex takes the label of the least vertex next to it, itself included, in an
    order drawn anew each round; edges are relabelled, and those between different labels go on, each
    once. A constant share of the vertices falls away each round, chains and stars alike, so all
    rounds together handle a small multiple of the edges. Labels are then resolved from the last round
    to the first. Each round is written to the shared folder. Empty edges give an empty table.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = scratch.table(edges.where("a <> b").select(*ordered("a", "b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while links.limit(1).count():
        rank = lambda c, n=len(rounds): F.xxhash64(c, F.lit(n))
        ends = links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select("b", "a"))
        near = ends.groupBy("v").agg(F.min(rank("u")).alias("low"), F.min_by("u", rank("u")).alias("u"))
        labels = scratch.table(near.select("v", F.when(F.col("low") < rank("v"), F.col("u")).otherwise(F.col("v")).alias("l")), "labels")
        rounds.append(labels)
        first = links.join(labels.select(F.col("v").alias("a"), F.col("l").alias("x")), "a")
        both = first.join(labels.select(F.col("v").alias("b"), F.col("l").alias("y")), "b")
        fewer = scratch.table(both.where("x <> y").select(*ordered("x", "y")).distinct(), "links")
        scratch.drop(links)
        links = fewer
    if not rounds:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    scratch.drop(links)
    top = rounds.pop()
    while rounds:
        own = rounds.pop()
        up = own.join(top.select(F.col("v").alias("l"), F.col("l").alias("up")), "l", "left").select("v", F.coalesce("up", "l").alias("l"))
        done = scratch.table(up, "labels")
        scratch.drop(own)
        scratch.drop(top)
        top = done
    least = top.groupBy("l").agg(F.min("v").alias("root"))
    return top.join(least, "l").select("v", "root")


class WordIds(dict):
    """A 64-bit id for each word, made on first use and forgotten when too many are held."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of word characters of the whole text; none for null."""
    return WORD.findall(text.lower()) if text else []


def shingle_hashes(words: list[str], ids: WordIds, k: int = 5) -> np.ndarray:
    """64-bit hashes of the runs of ``k`` words, in text order.

    A text of 1 to k-1 words has one shingle, all its words; a text without words has none.
    """
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        out = (out ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out
