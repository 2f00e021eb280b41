"""Token-ID output: fixed-width bit-packed files with block offsets, written and read in parallel.

File layout (little-endian): ``MAGIC``; blocks of BLOCK ids, each packed in the fewest bits that hold
any id of the vocabulary; then the footer: doc_ids (int64), the first id of each document (uint64,
one more than documents), byte offsets of the blocks (uint64, one more than blocks); then the counts
of documents, blocks and bits (uint64 x 3) and ``MAGIC`` again. A block is unpacked alone, so any id
range is read without the rest; numpy unpacks a block at once.

Documents are in ascending doc_id order across files (null first, rows that repeat a doc_id by a
hash of their text), each ended by ``end_id``. The range exchange goes by both, so rows of one doc_id
or of none are spread too. Its parts follow from the bytes of the texts, and a part's file is closed for
the next one at a bounded number of ids or documents, so neither a file nor a writer's memory grows with
the input. The table of files stays in the shared folder; where each file begins is summed over groups
of parts.

Null text counts as empty: only the end id. An empty table gives no file and an empty result. Ids that
aren't whole numbers are refused, as files hold 64-bit ids. Files go to the shared folder under names
that a repeated task replaces whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import NO_ID, Scratch, held, lean, parts_for, whole_ids

MAGIC = b"QTOK0001"
BLOCK = 1 << 16
END_ID = 2
CACHED = 400_000  # words whose ids a worker remembers, in each of two generations
LONGEST = 48  # longer ones are not remembered
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 20  # a file is closed at the document that reaches either
GROUP = 1024  # parts whose files are summed together
META = "part int, piece int, path string, n_docs long, n_tokens long"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(wide.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The ``n`` ids of a packed block as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """One file; ids are packed as blocks fill, so memory holds a block and the document table."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.stream.write(MAGIC)
        self.at, self.n = len(MAGIC), 0
        self.docs, self.firsts, self.blocks, self.open = [], [0], [len(MAGIC)], []
        self.held = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.n += len(ids)
        self.firsts.append(self.n)
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            full = np.concatenate(self.open)
            whole = self.held // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(full[k : k + BLOCK])
            self.open, self.held = [full[whole:]], self.held - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.stream.write(data)
        self.at += len(data)
        self.blocks.append(self.at)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.open))
        for values, kind in ((self.docs, "<i8"), (self.firsts, "<u8"), (self.blocks, "<u8"), ((len(self.docs), len(self.blocks) - 1, self.bits), "<u8")):
            self.stream.write(np.array(values, kind).tobytes())
        self.stream.write(MAGIC)
        self.stream.close()


class Reader:
    """Random access to one file."""

    def __init__(self, path: str):
        fs, place = pa.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(32, size - 32)
        if tail[24:] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        n_docs, n_blocks, self.bits = (int(x) for x in np.frombuffer(tail[:24], "<u8"))
        length = 8 * (n_docs + n_docs + 1 + n_blocks + 1)
        foot = self.file.read_at(length, size - 32 - length)
        self.docs = np.frombuffer(foot, "<i8", n_docs)
        self.firsts = np.frombuffer(foot, "<u8", n_docs + 1, 8 * n_docs).astype(np.int64)
        self.blocks = np.frombuffer(foot, "<u8", n_blocks + 1, 16 * n_docs + 8).astype(np.int64)
        self.n = int(self.firsts[-1])
        self.last: tuple[int, np.ndarray] | None = None

    def block(self, k: int) -> np.ndarray:
        if self.last is None or self.last[0] != k:
            data = self.file.read_at(int(self.blocks[k + 1] - self.blocks[k]), int(self.blocks[k]))
            self.last = k, unpack(data, min(BLOCK, self.n - k * BLOCK), self.bits)
        return self.last[1]

    def ids(self, first: int, stop: int) -> np.ndarray:
        """The ids from ``first`` to before ``stop``."""
        parts = []
        while first < stop:
            k, at = divmod(first, BLOCK)
            n = min(BLOCK - at, stop - first)
            parts.append(self.block(k)[at : at + n])
            first += n
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.firsts[i]), int(self.firsts[i + 1]))


# The tokenizer's own word pattern, here over the letters of PLAIN texts alone.
OWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "a-zß-öø-ÿ"
PLAIN_WORDS = re.compile(OWN_PATTERN.replace(r"\p{L}", LETTERS).replace(r"\p{N}", "0-9"))
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")  # no other letters, digits, blanks or combining marks
WORD_END = "</w>"


class Encoder:
    """The tokenizer's ids, with the ids of words that a worker has met before kept at hand.

    Texts of PLAIN characters are cut into words as the tokenizer cuts them; unknown words are encoded
    together, and as each word's last token ends with WORD_END, their ids are told apart. All other
    texts, those with special tokens' strings, and tokenizers of another pattern are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        form = json.loads(self.tokenizer.to_str())
        cut = [x["pattern"].get("Regex") for x in (form["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        kinds = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])]
        self.by_word = cut == [OWN_PATTERN] and kinds == ["NFC", "Replace", "Lowercase"] and form["model"].get("end_of_word_suffix") == WORD_END
        self.special = [x["content"] for x in form["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        # Words are cut and in lower case already: a tokenizer of the same model without these steps encodes them.
        bare = form | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *(form["pre_tokenizer"] or {}).get("pretokenizers", [])[1:]]}}
        self.bare = Tokenizer.from_str(json.dumps(bare)) if self.by_word else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.batch([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words."""
        run = getattr(self.bare, "encode_batch_fast", self.bare.encode_batch)
        ids = np.array(run([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.nonzero(self.ends[ids])[0] + 1
        if len(stops) != len(words) or (len(ids) and stops[-1] != len(ids)):
            return {w: self.whole(w).tobytes() for w in words}
        data, at = ids.tobytes(), [0, *(stops * 4).tolist()]
        return {w: data[at[i] : at[i + 1]] for i, w in enumerate(words)}

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not self.by_word or not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text).tobytes()
        words = PLAIN_WORDS.findall(text.lower())
        got = list(map(self.known.get, words))
        if None in got:
            made = {w: self.older.get(w) for w, g in zip(words, got) if g is None}
            made |= self.learn([w for w, g in made.items() if g is None])
            got = [made[w] if g is None else g for w, g in zip(words, got)]
            self.known.update((w, g) for w, g in made.items() if len(w) <= LONGEST)
            if len(self.known) > CACHED:
                self.known, self.older = {}, self.known
        return b"".join(got)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token files in ``folder``; the table of files (META)."""
    whole_ids(docs, "doc_id")
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = parts_for(spark, size)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("dk")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(key, F.xxhash64(text).alias("th"), text.alias("text")).repartitionByRange(n, "dk", "th").sortWithinPartitions("dk", "th").drop("th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(tokenizer, lambda: Encoder(tokenizer))
        end = np.array([end_id], "<u4")
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, place = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(place, recursive=True)
        out, piece = None, 0

        def closed() -> pa.RecordBatch:
            out.close()
            fs.move(draft, f"{place}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (piece, pa.int32()), (f"{folder}/{name}", pa.string()), (len(out.docs), pa.int64()), (out.n, pa.int64()))], ["part", "piece", "path", "n_docs", "n_tokens"])

        for b in batches:
            for dk, text in zip(b.column("dk"), b.column("text")):
                if out is None:
                    name = f"part-{part:06d}-{piece:05d}.qtok"
                    draft = f"{place}/.{name}-{attempt}"
                    out = Writer(fs.open_output_stream(draft), encoder.bits)
                out.add(dk.as_py(), np.concatenate([np.frombuffer(encoder.encode(text.as_py()), "<u4"), end]))
                if out.n >= FILE_IDS or len(out.docs) >= FILE_DOCS:
                    yield closed()
                    out, piece = None, piece + 1
        if out is not None:
            yield closed()

    return scratch.table(rows.mapInArrow(lean(run), META), "files")


def placed(files: DataFrame) -> DataFrame:
    """path, base: each file with the number of ids in all files before it."""
    group = F.floor(F.col("part") / GROUP).alias("of")
    sums = files.groupBy(group).agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for GROUP parts
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("of").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("of", group).join(sums.select("of", before.alias("before")), "of").select("path", (F.col("before") + inside).alias("base"))


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files that ``write`` returned."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                source = Reader(path)
                for k in range(0, len(source.docs), 20_000):
                    span = range(k, min(k + 20_000, len(source.docs)))
                    sums = [zlib.crc32(source.document(d).tobytes()) for d in span]
                    ids = [None if x == NO_ID else int(x) for x in source.docs[k : k + 20_000]]
                    firsts = source.firsts[k : k + len(span) + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(firsts[:-1] + base), pa.array(np.diff(firsts)), pa.array(sums, pa.int64())], schema=schema)

    todo = Scratch(files.sparkSession, "token-files").table(placed(files), "placed")
    return todo.repartition(max(1, min(todo.count(), 65_536))).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write token files to the shared folder and read the documents' table back from them."""
    return read(write(docs, tokenizer, Scratch(docs.sparkSession, "token-files").path("ids"), end_id))
