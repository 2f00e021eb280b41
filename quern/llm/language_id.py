"""Language ID: known words first, shorter and shorter character n-grams for unseen words.

Model: for each language, the log frequency of words and of the character n-grams (5 to 1, with word
boundaries) inside words. A word of the model is scored by its own log frequencies; an unseen word
by the mean over those of its longest n-grams that the model knows. The text's score is the sum over
all its words. Text is used whole.

The model holds every language, word and n-gram of the labelled sample. It is a table in the shared
folder that workers read, as counts by language where there are any, so languages cost no memory for
words they don't have. Its size follows from the sample, which MAX_TRAIN_DOCS bounds.

Defined cases: null text, or text without a letter: ``und``, score 0. No labelled row to learn from:
``und``, score 0. A text none of whose n-grams is known: the language with most labelled rows, score
1 / number of languages. Repeated rows are scored each by itself and learned from once; a null doc_id is
not held out and not learned from; rows with null lang or text are not learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, held, lean

LETTERS = re.compile(r"[^\W\d_]+")
MAX_TRAIN_DOCS = 10_000  # bound of the labelled sample, the least by a hash of doc_id and text
SIZES = (5, 4, 3, 2, 1)
UNSEEN = 0.05  # count of a word or n-gram that a language doesn't have
EVIDENCE_WORDS = 30  # words of evidence at which the score saturates
CACHE = 60_000  # unseen words that a worker remembers


def letters_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between boundary marks; single letters without the marks."""
    if n == 1:
        return list(word)
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, gram, n) of a partition; size 0 marks words, -1 rows. Flushed before it grows large."""
    counts: dict[str, Counter] = {}
    docs: Counter = Counter()

    def made(lang: str, size: int, found: Counter) -> pa.RecordBatch:
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, size, np.int32)), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "size", "gram", "n"])

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            yield made(lang, 0, words)
            for k in SIZES:
                by: Counter = Counter()
                for w, n in words.items():
                    for g in grams(w, k):
                        by[g] += n
                yield made(lang, k, by)
        for lang, n in docs.items():
            yield made(lang, -1, Counter({"": n}))
        counts.clear()
        docs.clear()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            counts.setdefault(lang, Counter()).update(letters_of(text.as_py()))
            docs[lang] += 1
            if sum(map(len, counts.values())) > 100_000:
                yield from flush()
    yield from flush()


def fit(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> str:
    """Learn from the labelled rows of ``docs`` (doc_id, text, lang) that are not held out; the model's path.

    At most ``max_train_docs`` of them are counted, those with the least hash; nothing of the model
    comes to the driver.
    """
    scratch = Scratch(docs.sparkSession, "language-id")
    labelled = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    labelled = labelled.withColumn("place", F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(1 << 40)))
    total = labelled.count()
    likely = labelled.where(F.col("place") < int((1 << 40) * min(1.0, 1.1 * max_train_docs / max(total, 1) + 100 / max(total, 1))))
    places = likely.select("place").distinct().orderBy("place").limit(max_train_docs)
    last = places.agg(F.max("place")).first()[0]
    sample = likely.where(F.col("place") <= F.lit(-1 if last is None else last)).dropDuplicates(["place"]).select("lang", "text")
    counted = sample.mapInArrow(lean(count_partition), "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    return scratch.table(counted, "model")._scratch_path


class Scorer:
    """A model's tables, and what its unseen words back off to."""

    def __init__(self, path: str):
        fs, place = pa.fs.FileSystem.from_uri(path)
        rows = pa.parquet.read_table(place, filesystem=fs)
        sizes, n = rows["size"].to_numpy(), rows["n"].to_numpy()
        self.langs = sorted(set(rows["lang"].unique().to_pylist()))
        lang = np.zeros(len(rows), np.int64) if not self.langs else np.searchsorted(np.array(self.langs, object), rows["lang"].to_numpy(zero_copy_only=False))
        docs = np.zeros(max(1, len(self.langs)), np.int64)
        docs[lang[sizes == -1]] = n[sizes == -1]
        self.common = int(np.argmax(docs))
        self.parts: dict[int, dict[str, int]] = {}
        self.absent = np.zeros((max(SIZES) + 1, len(docs)))  # by size: the log frequency of what a language doesn't have
        lengths, langs, gains = [], [], []
        at = 0
        for size in (0, *SIZES):
            own = np.nonzero(sizes == size)[0]
            names = rows["gram"].take(pa.array(own)).combine_chunks().dictionary_encode()
            code = names.indices.to_numpy()
            order = np.lexsort((lang[own], code))
            known = len(names.dictionary)
            self.parts[size] = {g: at + i for i, g in enumerate(names.dictionary.to_pylist())}
            totals = np.bincount(lang[own], n[own], len(docs)) + UNSEEN * (known + 1)
            self.absent[size] = np.log(UNSEEN / totals)
            langs.append(lang[own][order])
            gains.append(np.log((n[own][order] + UNSEEN) / UNSEEN))  # over what is absent
            lengths.append(np.bincount(code, minlength=known))
            at += known
        self.lang, self.gain, self.length = (np.concatenate(x) for x in (langs, gains, lengths))
        self.first = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.words = self.parts[0]
        self.unseen: dict[str, tuple[int, list[int]]] = {}

    def back_off(self, word: str) -> tuple[int, list[int]]:
        """(size, rows) of the longest n-grams of an unseen word that the model knows."""
        for k in SIZES:
            if found := [i for i in map(self.parts[k].get, grams(word, k)) if i is not None]:
                return k, found
        return 0, []

    def sums(self, words: list[tuple[str, int]]) -> np.ndarray:
        """The log frequencies of the words, times their counts, by language."""
        rows, weights = [], []
        by_size = [0.0] * len(self.absent)
        known, unseen = self.words.get, self.unseen
        for w, n in words:
            i = known(w)
            if i is not None:
                rows.append(i)
                weights.append(n)
                by_size[0] += n
                continue
            got = unseen.get(w)
            if got is None:
                if len(unseen) >= CACHE:
                    unseen.clear()
                got = unseen[w] = self.back_off(w)
            size, found = got
            if found:
                rows += found
                weights += [n / len(found)] * len(found)
                by_size[size] += n
        rows = np.array(rows, np.int64)
        length = self.length[rows]
        at = np.arange(int(length.sum())) + np.repeat(self.first[rows] - np.cumsum(length) + length, length)
        return np.array(by_size) @ self.absent + np.bincount(self.lang[at], self.gain[at] * np.repeat(np.array(weights, np.float64), length), self.absent.shape[1])

    def score(self, text: str | None) -> tuple[str, float]:
        words = Counter(letters_of(text))
        for w in [w for w in words if not w.isalpha() and not any(c.isalpha() for c in w)]:
            del words[w]
        if not words or not self.langs:
            return "und", 0.0
        items = list(words.items())
        total = sum(self.sums(items[k : k + 50_000]) for k in range(0, len(items), 50_000))
        n = words.total()
        mean = total / n * min(n, EVIDENCE_WORDS)
        best = int(np.argmax(mean))
        if mean[self.common] >= mean[best]:
            best = self.common
        p = np.exp(mean - mean.max())
        return self.langs[best], float(p[best] / p.sum())


def predict(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs`` (doc_id, text), by the model of ``fit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(model, lambda: Scorer(model))
        for b in batches:
            got = [scorer.score(t.as_py()) for t in b.column("text")]
            columns = [b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """Fit on the labelled rows that are not held out, then predict every row."""
    return predict(docs, fit(docs, max_train_docs))


MIN_SCORE = 0.5  # below it no language is likelier than all others together


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE, max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs``, all their columns as they are, whose text has a recognised language.

    Rows without letters and rows whose best language scores below ``min_score`` go. Where nothing
    is labelled there is no model to judge by, and all rows with a letter stay.
    """
    model = fit(docs, max_train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(model, lambda: Scorer(model))
        for b in batches:
            texts = (t.as_py() for t in b.column("text"))
            if not scorer.langs:
                keep = [any(map(str.isalpha, t or "")) for t in texts]
            else:
                keep = [lang != "und" and score >= min_score for lang, score in map(scorer.score, texts)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
